import random

import pytest

from mnemora.llm.tokens import BoundaryEncoder, token_ids


def test_equal_to_the_whole_encoding():
    e = BoundaryEncoder(remembered=50)
    r = random.Random(3)
    alphabet = [*"ab 'srt\n\t12.,|llt", *map(chr, (0xE9, 0x20AC, 0xA0, 0x65E5, 0x3000, 0x1F600, 1, 0x1C, 0x2028, 0x85))]
    for _ in range(300):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))).encode() for _ in range(8)]
        import numpy as np

        counts, flat = e.batch(np.array([len(t) for t in texts]), b"".join(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [e._whole.encode_ordinary(t.decode()) for t in texts]


def test_table(spark):
    long_ = "The quick <|endoftext|> brown fox. " * 20_000
    rows = [(1, None, "x"), (2, "", "y"), (3, long_, "z"), (3, long_, "z"), (None, "a b", "q")]
    got = token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    e = BoundaryEncoder()
    want = {None: e._whole.encode_ordinary("a b"), 1: [], 2: [], 3: e._whole.encode_ordinary(long_)}
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None"]
    assert all(r.ids == want[r.doc_id] for r in got)
    assert token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("text", ["don't'", "a\n\n b", "x  \x01", "€'s", "  ", "\r\n"])
def test_word_splits_survive(text):
    import numpy as np

    e = BoundaryEncoder()
    data = text.encode()
    assert e.batch(np.array([len(data)]), data)[1].tolist() == e._whole.encode_ordinary(text)
