import math
import random

import pytest
from pyspark.sql import functions as F

from mnemora.config import CORE, SERVER
from mnemora.operators.retrieval import context_with_visuals, retrieve_batch, retrieve_server, retrieve_visual
from mnemora.operators.similarity import recent_matches, top_matches

M = "id bigint, v array<double>, b double, emotion double, strength double, probe string, rank int"
EDGES = "src bigint, dst bigint, w double, bw double"


def _cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


def _table(spark, n=120, seed=4):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 1) for _ in range(3)], r.uniform(-12, 1), r.random(), r.random(), "x", 0) for k in range(n)]
    rows[7] = (7, rows[3][1], rows[3][2], rows[3][3], 0.5, "x", 0)  # a tie
    bad = [(200, None, 0.0, 0.5, 0.5, "x", 0), (201, [0.0, 0.0, 0.0], 0.0, 0.5, 0.5, "x", 0), (202, [1.0], 0.0, 0.5, 0.5, "x", 0), (203, [float("nan"), 1.0, 1.0], 0.0, 0.5, 0.5, "x", 0), (None, [1.0, 1.0, 1.0], 0.0, 0.5, 0.5, "x", 0)]
    return rows, spark.createDataFrame(rows + bad, M)


def test_worked_example_for_two_probes(spark):
    rows = [(0, [1.0, 0.0, 0.0], 0.0, 0.5), (1, [0.5, 0.5, 0.0], -0.202733, 0.5), (2, [0.0, 1.0, 0.0], -0.320927, 0.5)]
    m = spark.createDataFrame(rows, "id bigint, v array<double>, b double, emotion double")
    p = spark.createDataFrame([("a", [0.9, 0.1, 0.0]), ("b", [0.9, 0.1, 0.0])], "id string, v array<double>")
    e = spark.createDataFrame([(0, 1, 0.8, 0.3), (1, 2, 0.6, 0.2)], EDGES)
    for probe in "ab":
        plain = {r.id: r.total for r in retrieve_batch(p, m).collect() if r.probe == probe}
        assert plain == {0: pytest.approx(1.963526, abs=1e-5), 1: pytest.approx(0.942626, abs=1e-5)}
    more = {(r.probe, r.id): (r.total, r.probability) for r in retrieve_batch(p, m, e).collect()}
    assert more["b", 0][0] == pytest.approx(4.065619, abs=1e-5) and more["b", 1][0] == pytest.approx(3.023626, abs=1e-5)
    assert more["a", 2] == (pytest.approx(0.398553, abs=1e-5), pytest.approx(0.728205, abs=1e-5))
    assert retrieve_batch(p, m.filter("false"), e).count() == 0 and retrieve_batch(p.filter("false"), m, e).count() == 0


def test_top_matches_against_brute_force(spark):
    rows, m = _table(spark)
    q = m.filter("id in (3, 7, 20) or id >= 200").select("id", "v")
    for k, others in ((1, True), (5, False), (500, True)):
        got = {}
        for r in top_matches(q, m, k, others, block_bytes=30).collect():
            got.setdefault(r.query, []).append((r.rank, r.id))
        for i in (3, 7, 20):
            want = sorted((-round(_cos(rows[i][1], x[1]), 12), x[0]) for x in rows if not (others and x[0] == i))[:k]
            assert [x for _, x in sorted(got[i])] == [x for _, x in want]
        assert set(got) - {202} == {3, 7, 20} and got.get(202, [(1, 202)]) == [(1, 202)]  # the only vector of its length


def test_recent_matches_against_brute_force(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["p", "q"]), r.randrange(4000), [r.gauss(0, 1) for _ in range(3)]) for k in range(200)] + [(900, "p", None, [1.0, 1.0, 1.0]), (901, None, 5, [1.0, 1.0, 1.0]), (902, "p", 5, None)]
    df = spark.createDataFrame(rows, "id bigint, key string, at bigint, v array<double>")
    got = {}
    for x in recent_matches(df, 500, 0.4, 3, chunk=7).collect():
        got.setdefault(x.src, set()).add(x.dst)
    for i, key, at, v in rows[:200]:
        near = sorted((-_cos(v, y[3]), y[0]) for y in rows[:200] if y[1] == key and 0 < at - y[2] < 500 and _cos(v, y[3]) >= 0.4)[:3]
        assert got.get(i, set()) == {j for _, j in near}
    assert recent_matches(df.filter("false"), 500, 0.4, 3).count() == 0


def test_server_refines(spark):
    rows, m = _table(spark)
    p = spark.createDataFrame([("x", rows[3][1])], "id string, v array<double>")
    no_edges, no_pairs = spark.createDataFrame([], EDGES), spark.createDataFrame([], "src bigint, dst bigint, forward double, backward double")
    nobody = spark.createDataFrame([], "id bigint")
    plain = retrieve_server(p, m, no_edges, no_pairs, nobody, 5).orderBy("rank").collect()
    first, last = plain[0], plain[-1]
    assert [r.id for r in plain] == [r.id for r in retrieve_batch(p, m, config=SERVER).orderBy("rank").limit(5).collect()]
    strength = {x[0]: x[4] for x in rows}
    assert first.probability == pytest.approx(1 / (1 + math.exp(-first.score / (0.25 * (2 - strength[first.id])))))
    pairs = spark.createDataFrame([(first.id, last.id, 0.5, 0.3)], "src bigint, dst bigint, forward double, backward double")
    session = spark.createDataFrame([(last.id,), (last.id,)], "id bigint")
    got = {r.id: r.score for r in retrieve_server(p, m, no_edges, pairs, session, 5).collect()}
    boost = max(first.score * 0.5 * 1.2, last.score)  # the last is a seed itself and keeps its own
    assert got[last.id] == pytest.approx((last.score + boost) * 1.5) and got[first.id] == pytest.approx(first.score * 2)


def test_visual_ranking(spark):
    rows, m = _table(spark)
    v = m.select("id", "v", "b", (F.col("emotion") + 0.5).alias("weight"), F.when(F.col("id") != 3, F.col("strength")).alias("significance"))
    p = spark.createDataFrame([("x", rows[3][1])], "id string, v array<double>")

    def total(x):
        w, s = x[3] + 0.5, 0.5 if x[0] == 3 else x[4]
        recency = min(max((x[2] + 10) / 10, 0), 1)
        return min(_cos(rows[3][1], x[1]), 1) ** 3 * (0.5 + w) * (1 + recency) + 0.2 * s + (0.3 * (w - 0.7) if w > 0.7 else 0)

    want = sorted(((-total(x), x[0]) for x in rows))[:10]
    got = retrieve_visual(p, v).orderBy("rank").collect()
    assert [r.id for r in got] == [i for _, i in want] and got[0].total == pytest.approx(-want[0][0])
    e = spark.createDataFrame([(want[0][1], 50, 0.9, 0.4)], EDGES)
    assert retrieve_visual(p, v, e).count() == 10


def test_context_budget_is_split(spark):
    t = spark.createDataFrame([("x", 1, 0.9, 1, 100), ("x", 2, 0.2, 2, 5), ("x", 3, 0.8, 3, 100), ("x", 4, 0.8, 4, 60), ("x", 5, 0.8, 5, 1)], "probe string, id bigint, similarity double, rank int, tokens int")
    v = spark.createDataFrame([("x", "a", 0.9, 1, 90), ("x", "b", 0.9, 2, 1)], "probe string, id string, similarity double, rank int, tokens int")
    got = {(r.what, r.id): r.running for r in context_with_visuals(t, v).collect()}
    assert got == {("text", "1"): 100, ("text", "3"): 200, ("visual", "a"): 90}


def test_presets():
    assert (CORE.threshold, CORE.noise, SERVER.threshold, SERVER.noise) == (0.3, 0.1, 0.0, 0.25)


def test_blocks_of_queries_find_what_blocks_of_rows_find(spark, monkeypatch):
    from mnemora.operators import similarity

    monkeypatch.setattr(similarity, "_FILE_ROWS", 16)
    monkeypatch.setattr(similarity, "_FILES", 3)
    monkeypatch.setattr(similarity, "_BLOCK", 40)
    rows, m = _table(spark)
    own = m.filter("id is not null")
    for k, others, score, extra in ((5, False, similarity.activation_score, ("b", "emotion")), (3, True, None, ()), (500, False, None, ())):
        few = {(r.query, r.rank): (r.id, r.s) for r in top_matches(own.select("id", "v"), m, k, others, score, extra).collect()}
        many = {(r.query, r.rank): (r.id, r.s) for r in top_matches(own.select("id", "v"), m, k, others, score, extra, many=1).collect()}
        assert few.keys() == many.keys() and all(few[x][0] == many[x][0] and few[x][1] == pytest.approx(many[x][1], abs=2e-12) for x in few)
