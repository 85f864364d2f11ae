from mnemora.llm.history import NoteHistory
from mnemora.sources.shared import new_path

A = "Moved the cache out of alpha-store into beta_queue because support kept getting question 17."
SCHEMA = "id string, at bigint, content string, class string"


def found(history, rows, spark):
    return {r.id for r in history.merge(spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)).collect()}


def test_repeats_in_and_across_batches(spark):
    h = NoteHistory(spark, new_path(spark, "test"))
    first = [
        ("a", 1, A),
        ("a", 1, A),  # delivered again
        ("b", 2, "> " + A.upper()),
        ("c", 3, A.replace("17", "18")),  # another number
        ("d", 4, A.replace("alpha-store", "gamma-store")),  # another component
        ("e", 5, "ok"),
        ("f", 6, "ok"),
        ("g", 7, None),
        (None, 8, A),
        ("h", None, A),
        ("i", 9, ""),
        ("z", 0, "FYI: " + A.replace("support", "supprot")),  # the earliest of all
    ]
    assert found(h, first, spark) == {"a", "b"}
    second = [("a", 1, A), ("j", 20, A.replace("kept", "really kept")), ("k", 21, "Nothing like it was ever said about delta-loader 99 before."), ("l", 22, A.replace("17", "19"))]
    assert found(h, second, spark) == {"j"}
    third = [("m", 30, "re " + second[2][2]), ("n", 31, "Nothing like it was evr said about delta-loader 99 befroe.")]
    assert found(h, third, spark) == {"m", "n"}


def test_empty_batches(spark):
    h = NoteHistory(spark, new_path(spark, "test"))
    assert found(h, [], spark) == set()
    assert found(h, [("a", 1, A)], spark) == set()
    assert found(h, [], spark) == set()
    assert found(h, [("b", 2, A)], spark) == {"b"}


def test_many_near_copies_and_long_notes(spark):
    words = ["word%s" % chr(97 + k) for k in range(20)]
    rows = []
    for k in range(200):  # each with another slip; one hot group of fingerprints
        own = list(words)
        own[k % 20] = own[k % 20] + "x" * (k // 20 + 1)
        rows.append((f"n{k:03}", k, "Note on alpha-store 17 and beta-store 18: " + " ".join(own)))
    long_ = "A long tale of gamma-store 4 and delta-store 5. " + "so it goes " * 30_000
    rows += [("x", 1000, long_), ("y", 1001, long_ + " again")]
    h = NoteHistory(spark, new_path(spark, "test"), bucket=50, classes=20)
    assert found(h, rows, spark) == {f"n{k:03}" for k in range(1, 200)} | {"y"}


def test_what_is_a_repeat(spark):
    h = NoteHistory(spark, new_path(spark, "test"))
    tag = "<a href='https://files.example/" + "x" * 200 + "'>"
    words = "we moved the old cache and the new index to another rack before lunch".split()
    rows = [
        ("a", 1, A),
        ("b", 2, tag + A + "</a>"),  # a long tag is markup as well
        ("c", 3, " ".join(reversed(A.split()))),  # the same words in another order
        ("d", 4, "please water the plants today"),
        ("e", 5, "please wter the plants todya"),  # two slips in a short note
        ("f", 6, "please feed the cats tomorrow"),
        ("g", 7, " ".join(words)),
        ("h", 8, " ".join(words).replace("cache", "cahce").replace("rack", "rakc")),
        ("i", 9, "The reload of kappa-store needs 17 rows and ends in BUG-713"),
        ("j", 10, "The reload of kappa-store needs 17 rows and ends in BUG-71383"),  # both may have lost an end
        ("k", 11, "The reload of kappa-store needs 18 rows and ends in BUG-71383"),
    ]
    assert found(h, rows, spark) == {"b", "e", "h", "j"}


def test_a_stored_content_that_comes_again(spark):
    h = NoteHistory(spark, new_path(spark, "test"))
    assert found(h, [("a", 1, A)], spark) == set()
    # near the stored one, though before it came again
    assert found(h, [("b", 5, A.replace("kept", "kpet")), ("c", 9, A)], spark) == {"b", "c"}


def test_only_touched_buckets_are_read(spark):
    h = NoteHistory(spark, new_path(spark, "test"), bucket=20, classes=10)
    assert found(h, [(f"n{k:03}", k, f"Wrote {k} rows to store-{k} and {k + 7} to queue-{k}.") for k in range(200)], spark) == set()
    read = []
    load = h._buckets
    h._buckets = lambda kind, schema, touched: read.append((kind, len(touched))) or load(kind, schema, touched)
    assert found(h, [("x", 900, "Wrote 5 rows to store-5 and 12 to queue-5!")], spark) == {"x"}
    kept = h.manifest.read()[1]["versions"][0]
    assert kept["buckets"] >= 20 and all(n <= 4 for _, n in read)
