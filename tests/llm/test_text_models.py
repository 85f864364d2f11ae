import random

from mnemora.llm.examples import SENTENCES, Filler
from mnemora.llm.personal import Detector, personal_data, train
from mnemora.llm.subjects import subjects
from mnemora.llm.truncation import cut_texts

PEOPLE = [("Alda", "Brookwell"), ("Corin", "Danesby"), ("Elvira", "Fenwick"), ("Garron", "Hollis"), ("Ines", "Jarrow"), ("Kelda", "Lindqvist")]


def test_personal_data_on_held_out_lines():
    """Half of the table's lines teach the model, the others are looked for; half of the names are put together anew."""
    detector = Detector(*train(PEOPLE, lines=SENTENCES[::2]))
    filler = Filler(PEOPLE, seed=99)
    made = [filler.sentence(line) for line in SENTENCES[1::2] for _ in range(6)]
    want = {(k, kind, a) for k, (_, spans) in enumerate(made) for a, _, kind in spans}
    got = {(k, kind, a) for k, kind, a, _ in detector.batch([t for t, _ in made])}
    for kind in ("email", "phone", "id_number", "address", "name"):
        w, g = {x for x in want if x[1] == kind}, {x for x in got if x[1] == kind}
        print(kind, len(w), round(len(w & g) / len(w), 3), round(len(w & g) / len(g), 3))
        assert len(w & g) >= 0.8 * len(w) and len(w & g) >= 0.8 * len(g)


def test_personal_data_table(spark):
    text = "Thanks to Alda Brookwell for finding the lock order bug in kor_cache. Call 212-555-0134 or alda.b@mail.example when dor-queue is down."
    long_ = "Decided to keep dor-queue on the old format. " * 3_000 + text
    rows = [("a", text, None, "m"), ("b", "", "", "m"), ("c", None, "no one", "m"), ("a", text, None, "m"), ("l", long_, text, "m")]
    df = spark.createDataFrame(rows, "id string, content string, gist string, mentions string")
    people = spark.createDataFrame([*PEOPLE, (None, "X"), (" ", "Y")], "given_name string, family_name string")
    got = {r.id: r for r in personal_data(df, people).collect()}
    assert [(m.field, m.kind, m.start_pos) for m in got["a"].mentions] == [("content", "name", 10), ("content", "phone", text.index("212")), ("content", "email", text.index("alda.b"))]
    assert got["a"].content == text.replace("Alda Brookwell", "[NAME]").replace("212-555-0134", "[PHONE]").replace("alda.b@mail.example", "[EMAIL]")
    assert got["b"].content == "" and got["c"].content is None and got["c"].gist == "no one"
    assert len(got["l"].mentions) == 6 and got["l"].content.startswith("Decided to keep dor-queue on the old format. Decided")
    assert personal_data(df.filter("false"), people).count() == 0


def _notes(n, seed):
    r = random.Random(seed)
    ends = ["because two teams depend on it", "after the second rollback this month", "so that reviewers can follow the change", "since nobody owned the old setting"]
    out = []
    for k in range(n):
        out.append(" ".join(f"We moved the {r.choice(['cache', 'schema', 'cursor logic', 'retry budget'])} of {r.choice('abcdefgh')}{r.choice(['lor', 'min', 'tek'])}-{r.choice(['store', 'queue', 'proxy'])} {r.choice(ends)}." for _ in range(r.randint(1, 4))))
    return out


def test_cut_texts(spark):
    whole = _notes(1500, 1)
    whole = [t[:-1] if k % 5 == 0 else t for k, t in enumerate(whole)]
    cut = [t[:120] for t in _notes(400, 2) if len(t) > 150 and t[118:122].isalpha()]
    rows = [(f"w{k}", t, "rpc") for k, t in enumerate(whole)] + [(f"c{k}", t, "hook") for k, t in enumerate(cut)] + [(f"h{k}", t, "hook") for k, t in enumerate(_notes(300, 3))]
    rows += [("n", None, None), ("e", "", "hook"), ("s", "ok", "hook"), ("l", "We moved it. " * 20_000, None)]
    df = spark.createDataFrame([(*x, 0.0) for x in rows], "id string, text string, source string, odds double")
    got = {r.id: r for r in cut_texts(df).collect()}
    assert len(got) == len(rows) and got["n"].odds == got["e"].odds == 0
    hits = sum(got[f"c{k}"].cut for k in range(len(cut)))
    wrong = sum(r.cut for k, r in got.items() if k[0] != "c")
    assert hits >= 0.9 * len(cut) and wrong <= 0.02 * len(whole)
    assert cut_texts(df.filter("false")).count() == 0


def test_every_value_takes_part_in_the_cut_model(spark):
    """No sample: each distinct value is a row of its half's fit, and shards of a half are one model."""
    import numpy as np
    import pyarrow as pa

    from mnemora.llm.truncation import CUT, FEATURE_BITS, STORED, _distinct, _slot, fit_shard

    n = 13_000  # more than were drawn of a table once
    x = np.arange(2 * n, dtype=np.int32).reshape(-1, 1) % 5
    bias = np.full((2 * n, 1), _slot("bias", FEATURE_BITS), np.int32)
    feats = np.hstack([x, bias])
    kind = np.tile(np.array([STORED, CUT], np.int32), n)
    place, nth = np.repeat(np.arange(n), 2), np.tile(np.array([0, 1], np.int32), n)
    rows = np.repeat(np.arange(2 * n), 2)  # every value delivered twice
    table = pa.table({"place": place[rows], "nth": nth[rows], "kind": kind[rows], "x": [feats[r].tobytes() for r in rows]})
    got, kinds = _distinct(table)
    assert len(got) == 2 * n and (kinds == CUT).sum() == n
    w, count = fit_shard(got, kinds, None, 0.0)
    assert count[_slot("bias", FEATURE_BITS)] == 2 * n
    judge = np.zeros(1 << FEATURE_BITS, np.float32)
    judge[0] = 3.0  # the other half holds what has feature 0 to be cut
    _, count = fit_shard(got, kinds, judge, 1.0)
    assert count[_slot("bias", FEATURE_BITS)] == 2 * n - ((kinds == STORED) & (got[:, 0] == 0)).sum()

    whole = _notes(900, 5)
    cut = [t[:120] for t in _notes(400, 6) if len(t) > 150 and t[118:122].isalpha()]
    df = spark.createDataFrame([(f"w{k}", t, "rpc") for k, t in enumerate(whole)] + [(f"c{k}", t, "rpc") for k, t in enumerate(cut)], "id string, text string, source string")
    one = {r.id: r for r in cut_texts(df, shard=250).collect()}
    other = {r.id: r for r in cut_texts(df.repartition(5), shard=250).collect()}
    assert len(one) == len(whole) + len(cut) and {k: r.odds for k, r in one.items()} == {k: r.odds for k, r in other.items()}
    assert sum(one[f"c{k}"].cut for k in range(len(cut))) >= 0.9 * len(cut)
    assert sum(r.cut for k, r in one.items() if k[0] == "w") <= 0.02 * len(whole)


def test_subjects(spark):
    r = random.Random(5)
    terms = {s: [f"{s}{chr(97 + k)}term" for k in range(12)] for s in ("food", *(f"area{chr(97 + k)}" for k in range(19)))}
    common = [f"frame{chr(97 + k)}" for k in range(20)]
    docs, labels, truth = [], [], {}
    for d in range(3000):
        own = r.sample(sorted(terms), 2 if d % 6 == 0 else 1)
        truth[d] = set(own)
        words = [r.choice(terms[r.choice(own)]) if r.random() < 0.4 else r.choice(common) for _ in range(120)]
        docs.append((d, " ".join(words), "x"))
        if d % 3 == 0:
            labels += [(d, s, "y") for s in own]
    docs += [(10000, None, ""), (10001, "", ""), (10002, "page 3 missing", ""), (None, "foodaterm " * 40, "")]
    labels += [(50000, "food", ""), (3, "unknown", ""), (None, "food", "")]
    areas = spark.createDataFrame([(s, "t") for s in (*terms, "empty")], "subject_id string, title string")
    d, a = spark.createDataFrame(docs, "doc_id bigint, text string, slots string"), spark.createDataFrame(labels, "doc_id bigint, subject_id string, share string")
    got = {}
    for x in subjects(d, a, areas).collect():
        got.setdefault(x.doc_id, set()).add(x.subject_id)
    assert set(got) == set(truth)
    assert sum(got[k] == truth[k] for k in truth) >= 0.9 * len(truth)
    assert subjects(d, a.filter("false"), areas).count() == 0
    assert subjects(d.filter("false"), a, areas).count() == 0
