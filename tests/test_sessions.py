import random

from pyspark.sql import functions as F

from mnemora.operators.sessions import GAP_MS, SessionTable, clean_key
from mnemora.sources.shared import new_path

SCHEMA = "key string, at bigint, id string, cell string, slice int"


def brute(rows):
    by = {}
    for k, t, i in rows:
        if k is not None and t is not None and i is not None:
            by.setdefault(k, set()).add((t, i))
    out = set()
    for k, own in by.items():
        run = []
        for t, _ in sorted(own):
            if run and t - run[-1] >= GAP_MS:
                out.add((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.add((k, run[0], run[-1], len(run)))
    return out


def test_batches_in_any_order_equal_one_pass(spark):
    r = random.Random(1)
    t, rows = 1_700_000_000_000, []
    for k in range(600):
        t += r.choice([60_000, 300_000, GAP_MS - 1, GAP_MS, GAP_MS + 1, 5 * GAP_MS, 90 * 86_400_000 if k % 150 == 0 else 1000])
        rows.append((r.choice(["hot", "hot", "hot", "b"]), t, f"i{k}"))
    rows += [("hot", rows[5][1], "tie"), rows[7], (None, t, "x"), ("b", None, "y"), ("b", t, None)]
    r.shuffle(rows)
    table = SessionTable(spark, new_path(spark, "test"))
    for a in range(0, len(rows), 160):
        table.merge(spark.createDataFrame([(*x, "c", 1) for x in rows[a : a + 160] + rows[:15]], SCHEMA))
    got = {(x.key, x.started_at, x.ended_at, x.events) for x in table.sessions().collect()}
    assert got == brute(rows)


def test_batches_far_apart_in_one_slice(spark):
    table = SessionTable(spark, new_path(spark, "test"))
    rows = [("k", (800 << 31) + hours * 3_600_000, f"i{hours}") for hours in (1, 2, 200, 201, 100)]
    for row in rows:
        table.merge(spark.createDataFrame([(*row, "c", 1)], SCHEMA))
    assert {(x.key, x.started_at, x.ended_at, x.events) for x in table.sessions().collect()} == brute(rows)


def test_an_id_counts_once(spark):
    table = SessionTable(spark, new_path(spark, "test"))
    table.merge(spark.createDataFrame([("k", 5, "x", "c", 1), ("b", 5, "x", "c", 1)], SCHEMA))
    table.merge(spark.createDataFrame([("k2", 5, "x", "c", 1), ("k2", 9, "x", "c", 1)], SCHEMA))
    assert {(x.key, x.started_at, x.events) for x in table.sessions().collect()} == {("b", 5, 1)}


def test_only_touched_parts_are_rewritten(spark):
    table = SessionTable(spark, new_path(spark, "test"), key_parts=8)
    day = 86_400_000
    table.merge(spark.createDataFrame([(f"k{k}", (800 << 31) + d * day, f"{k}/{d}", "c", 1) for k in range(20) for d in range(0, 200, 20)], SCHEMA))
    before = table.manifest.read()[1]["sessions"]
    table.merge(spark.createDataFrame([("k3", (800 << 31) + 1, "late", "c", 1), ("k3", (800 << 31) + 190 * day, "new", "c", 1)], SCHEMA))
    after = table.manifest.read()[1]["sessions"]
    assert {k for k in after if after[k] != before[k]} and sum(after[k] != before[k] for k in after) <= 3 and len(after) > 40
    assert table.sessions().count() == 201


def test_empty(spark):
    table = SessionTable(spark, new_path(spark, "test"))
    assert table.sessions().count() == 0
    table.merge(spark.createDataFrame([], SCHEMA))
    assert table.sessions().count() == 0


def test_keys(spark):
    rows = [("  Ab ",), (" x　",), (" ",), ("",), (None,), ("a b",)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string").select(clean_key(F.col("k"))).collect()]
    assert got == ["ab", "x", None, None, None, "a b"]
