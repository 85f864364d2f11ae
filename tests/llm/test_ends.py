import random
import time
import zlib

import numpy as np
import pyarrow as pa

from mnemora.llm import truncation as t

LIMITS = {"rpc": [120], "hook": [64, 100]}
ODD = ["", "...", "…", " … ", "_ _", "İstanbul ΣΑΣ. ΟΔΟΣ tree (x", "a\n\n  \nb. \nc", "foo [cut] [CUT]", "foo <snip>  \n", "tail ...…", "tail …...", "a ..", "hello. )", "x" * 100 + " " + "y" * 300 + ". " + "z" * 70 + "-" + "q" * 200 + " end", "```py\ncode = 1\n```", "a.b.c/d-e:f@g " * 9, "ab. cd\x85ef. gh_"]


def _name(token, counts):
    joined = any(c in token for c in "-._/")
    if t._plain(token):
        return t._plain(token)
    if not token[0].isalnum():
        return token
    if counts[t._slot(token, t.WORD_BITS)] < 3:
        return "<?+>" if joined else "<?>"
    return "<c>" if joined else token


def _plainly(text, source, counts):
    """The features of one text, string by string."""
    mark = t.MARK.search(text)
    body = text[: mark.start()] if mark else text.rstrip()
    tokens = t._TOKEN.findall(t._SENTENCE.split(body)[-1].lower())
    w = ["^"] * (5 - len(tokens[-5:])) + [_name(x, counts) for x in tokens[-5:]]
    start = " ".join(_name(x, counts) for x in tokens[:2])
    final = tokens[-1] if tokens else ""
    known = int(counts[t._slot(final, t.WORD_BITS)])
    bucket = str(min(8, known.bit_length()) if final[:1].isalnum() and not t._plain(final) else -1)
    end, m, line = body[-1:], "m" if mark else "-", body.rsplit("\n", 1)[-1].lstrip()[:1]
    end = end if not end.isalnum() else ("0" if end.isdigit() else "a")
    head = line if not line.isalpha() else ("A" if line.isupper() else "a")
    open_ = "".join(a for a, b in ("()", "[]", "{}", "“”", "«»") if body.count(a) > body.count(b)) + "".join(q for q in '"`' if body.count(q) % 2)
    limit = ""
    for at in LIMITS.get(source, ()):
        if 0 <= at - len(text) <= 16:
            limit = str(min(3, (at - len(text)) // 4)) if at != len(text) else "="
    kind = ("`" if "```" in body[:8] else body[:1] if body[:1] in "{[<#*>|-" else "") + ("n" if "\n" in body else "")
    before = [x for x in body.split("\n")[:-1] if x.strip()]
    closed = sum(x.rstrip().rstrip("'\")]”»*`").endswith((".", "!", "?")) for x in before)
    stopped = body.rstrip("'\")]”»*`").endswith((".", "!", "?"))
    style = f"{min(4, len(t._STOP.findall(body)))}{'-' if not before else 'a' if closed == len(before) else 's' if closed else 'n'}{'.' if stopped else end}{m}"
    said = ["p " + style, "q " + style + bucket, "r " + style + w[4], f"v {style}{min(3, body.count(','))}{kind}", f"w {style} {start} {min(len(tokens), 12)}", "end " + end + m, "1 " + w[4] + end + m]
    said += [f"{k} " + " ".join(w[-k:]) for k in (2, 3, 4, 5)]
    said += [f"s {start} {w[4]}", f"t {start} {w[3]} {w[4]}", f"u {start} {min(len(tokens), 24)}", "k " + bucket + end, "K " + bucket + w[3], "o " + open_, "l " + limit + end, "h " + head + end + kind, "c " + final[-3:] + end + m]
    said += [f"n {min(12, len(body) // 16)}{end}", "m " + m + kind, "z " + (body.lower() if len(body) <= 24 else ""), "bias"]
    return [t._slot(x, t.FEATURE_BITS) for x in said]


def _texts(n, seed):
    r = random.Random(seed)
    words = ["cache", "schema", "Retry", "budget", "dor-queue", "v2.1", "12", "req-88", "(see", "notes)", "after,", "rollback"] + ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    return [r.choice(["", "- ", "{"]) + " ".join(r.choice(words) + r.choice(["", "", "", ".", "!", "\n", ": "]) for _ in range(r.randint(1, 60))) + r.choice([".", "", "…", " [...]", "  "]) for _ in range(n)]


def _made(texts):
    places = [(s, at) for s, x in sorted(LIMITS.items()) for at in x]
    return [[(x, "rpc"), *[m[1:] for m in t._made(x, "rpc", places, random.Random(k))]] if x.strip() else [(x, "rpc")] for k, x in enumerate(texts)]


def _counts(texts):
    counts = np.zeros(1 << t.WORD_BITS, np.int64)
    for b in t._count_words(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return counts


def _read(texts, made, counts):
    reader = t.Reader(counts, LIMITS)
    return reader.features([reader.row(value, x, s) for value, own in zip(map(t.Value, texts), made) for x, s in own])


def test_features_are_hashes_of_their_strings():
    r = random.Random(4)
    texts = ODD + _texts(400, 1) + ["".join(r.choices("ab. ,\n…[](){}\"'`»«”“!?-_/:@0 9ΣİéA", k=r.randint(0, 120))) for _ in range(1500)]
    made, counts = _made(texts), _counts(texts * 2)
    got = _read(texts, made, counts)
    assert got.tolist() == [_plainly(x, s, counts) for own in made for x, s in own]


def test_words_are_counted_as_they_stand():
    texts = ODD + _texts(300, 2)
    want = np.zeros(1 << t.WORD_BITS, np.int64)
    for text in texts:
        for token in t._TOKEN.findall(text.lower())[:-1]:
            if token[0].isalnum() and not t._plain(token):
                want[zlib.crc32(token.encode()) & ((1 << t.WORD_BITS) - 1)] += 1
    assert (_counts(texts) == want).all()


def test_reading_ends_takes_less_than_string_by_string():
    texts = _texts(1500, 3)
    made, counts = _made(texts), _counts(texts)

    def took(f):
        best = []
        for _ in range(3):
            began = time.process_time()
            f()
            best.append(time.process_time() - began)
        return min(best)

    plainly = took(lambda: [_plainly(x, s, counts) for own in made for x, s in own])
    assert took(lambda: _read(texts, made, counts)) < 0.7 * plainly


def test_the_same_weights_as_over_the_whole_table():
    """Only the weights in use are gone through; each has the value it would have among all."""
    g = np.random.default_rng(1)
    x, y, c = g.integers(0, 1 << t.FEATURE_BITS, (3000, 4)), g.integers(0, 2, 3000).astype(float), np.ones(3000)
    x[:, 0] = 7
    w, squares = np.zeros(1 << t.FEATURE_BITS), np.full(1 << t.FEATURE_BITS, 1e-4)
    order = np.random.default_rng(5)
    for _ in range(2):
        for part in np.array_split(order.permutation(len(x)), len(x) // 1024):
            p = 1 / (1 + np.exp(-w[x[part]].sum(1)))
            d = np.bincount(x[part].ravel(), np.repeat(c[part] * (p - y[part]), 4), minlength=len(w)) / len(part)
            touched = np.flatnonzero(d)
            d = d[touched] + 2e-6 * w[touched]
            squares[touched] += d * d
            w[touched] -= 0.15 * d / np.sqrt(squares[touched])
    assert (t._regress(x, y, c, 2, 5) == w).all()
