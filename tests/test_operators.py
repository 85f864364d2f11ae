import pytest
from pyspark.sql import functions as F

from mnemora.config import RetrievalConfig
from mnemora.engine import Engine
from mnemora.operators.coaccess import co_access_by_task, co_access_by_time, co_access_strength, locations
from mnemora.operators.episodes import episodes, links
from mnemora.operators.frames import even_frames, select_frames
from mnemora.operators.graph import pagerank, shortest_path, spread
from mnemora.operators.retrieval import retrieve
from mnemora.operators.similarity import best_match
from mnemora.sources.shared import new_path
from mnemora.sources.versions import Manifest

EDGES = "src bigint, dst bigint, w double, bw double"


def test_worked_retrieval(spark):
    rows = [(0, 0.993884, 0.0, 0.5), (1, 0.780869, -0.202733, 0.5), (2, 0.110432, -0.320927, 0.5)]
    m = spark.createDataFrame(rows, "id bigint, s double, b double, emotion double")
    plain = {r.id: r for r in retrieve(m).collect()}
    assert set(plain) == {0, 1} and plain[0].total == pytest.approx(1.963526, abs=1e-4) and plain[1].total == pytest.approx(0.942626, abs=1e-3)
    e = spark.createDataFrame([(0, 1, 0.8, 0.3), (1, 2, 0.6, 0.2), (1, 9, 1.0, 1.0)], EDGES)
    more = {r.id: r for r in retrieve(m, e).collect()}
    assert more[0].spread == pytest.approx(2.102092, abs=1e-3) and more[1].spread == pytest.approx(2.080999, abs=1e-3) and more[2].spread == pytest.approx(0.395903, abs=1e-3)
    assert retrieve(m.filter("false"), e).count() == 0
    assert retrieve(m, e, RetrievalConfig(depth=0)).count() == 2


def test_fan_and_chain(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 1.0, 0.0), (None, 3, 1.0, 0.0)], EDGES)
    seeds = spark.createDataFrame([(0, 1.0)], "id bigint, a double")
    a = {r.id: r.a for r in spread(seeds, e, 1).collect()}
    assert a[0] == 1.0 and all(a[k] == pytest.approx(0.7 / 3) for k in (1, 2, 3))
    chain = spark.createDataFrame([(k, k + 1, 0.8, 0.4) for k in range(4)], EDGES)
    b = {r.id: r.a for r in spread(seeds, chain, 3).collect()}
    assert b[1] > b[2] > b[3] and 4 not in b
    assert spread(seeds.filter("false"), chain, 3).count() == 0


def test_rank_and_path(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 0.0), (1, 2, 1.0, 0.0), (0, 2, 1.0, 0.0), (2, 7, 1.0, 0.0)], EDGES)
    nodes = spark.createDataFrame([(0,), (1,), (2,), (2,)], "id bigint")
    r = {x.id: x.rank for x in pagerank(nodes, e, 60).collect()}
    assert sum(r.values()) == pytest.approx(1.0) and r[2] > r[1] > r[0]
    assert pagerank(nodes.filter("false"), e, 2).count() == 0
    assert [tuple(x) for x in shortest_path(e, 0, 7, 3).collect()] == [(2, "0>2>7")]
    assert shortest_path(e, 7, 0, 3).count() == 0


def test_episodes_and_links(spark):
    ev = spark.createDataFrame([("k", n, n * 1000, "x") for n in range(7)] + [("k", 50, 10_000_000, "x"), (None, 1, 1, "x"), ("k", 2, None, "x")], "key string, id bigint, at bigint, run string")
    ep = episodes(ev, 5_000, 4)
    assert sorted((r.run, r.part, r.position, r.id) for r in ep.collect()) == [(1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 3), (1, 1, 0, 4), (1, 1, 1, 5), (1, 1, 2, 6), (2, 0, 0, 50)]
    assert links(ep).count() == 6 + 3 and links(ep, 1).count() == 3 + 2


def test_locations(spark):
    a = spark.createDataFrame([("p", "x", True, "first", 1), ("p", "x", False, "later", 2), (None, "y", None, None, 3), ("p", None, True, "c", 4)], "project string, path string, direct boolean, context string, at bigint")
    got = {(r.project, r.path): r for r in locations(a).collect()}
    assert got["p", "x"].accesses == 2 and got["p", "x"].saved == 1 and got["p", "x"].description == "first" and got["", "y"].saved == 0
    t = spark.createDataFrame([("p", 1, "x", "r", 1, 1), ("p", 1, "y", "r", 2, 2), ("p", 2, "x", "w", 3, 3), ("p", 2, "z", "r", 4, 4), ("p", 3, "y", "r", 5, 5), ("p", 3, "x", "r", 6, 6), (None, 3, "x", "r", 7, 7), ("p", None, "x", "r", 8, 8)], "project string, task int, path string, activity string, at bigint, id bigint")
    s = {(r.a, r.b): (r.n, r["count"], r.strength) for r in co_access_strength(co_access_by_task(t)).collect()}
    # the first of two co-accesses counts 1, the second its weight of 5
    assert s == {("x", "y"): (2, 6.0, pytest.approx(0.375)), ("x", "z"): (1, 1.0, pytest.approx(1 - 1 / 1.3))}
    many = spark.createDataFrame([("p", 1, f"f{k}", "r", k, k) for k in range(6)], "project string, task int, path string, activity string, at bigint, id bigint")
    assert co_access_by_task(many, reach=2).count() == 5 + 4
    h = 3_600_000
    n = spark.createDataFrame([("p", "x", h - 1, 1, "s"), ("p", "y", h, 2, "s"), ("p", "z", 2 * h - 1, 3, "s"), ("p", "y", 2 * h, 4, None), ("p", "x", h - 1, 5, "s")], "project string, path string, at bigint, id bigint, session string")
    got = {(r.a, r.b): (r.n, r["count"]) for r in co_access_strength(co_access_by_time(n)).collect()}
    assert got == {("x", "y"): (2, 2.5), ("y", "z"): (2, 2.0)}
    assert co_access_by_time(n, reach=1).count() == 3 and co_access_by_time(n.filter("false")).count() == 0


def test_frames(spark):
    rows = [("v", k, 1.0 if k in (5, 6, 40) else 0.1) for k in range(50)] + [("w", 3, 0.5)]
    got = {}
    for r in select_frames(spark.createDataFrame(rows, "video_id string, frame_number int, score double"), 5).collect():
        got.setdefault(r.video_id, []).append(r.frame_number)
    assert got["w"] == [3] and got["v"][0] == 0 and got["v"][-1] == 49 and 5 in got["v"] and 6 not in got["v"] and 40 in got["v"] and len(got["v"]) == 5
    even = even_frames(spark.createDataFrame([("v", k) for k in range(20)], "video_id string, frame_number int"), 4)
    assert sorted(r.frame_number for r in even.collect()) == [0, 5, 10, 19]


def test_best_match_in_blocks(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 30)] + [(90, None)], "id bigint, v array<double>")
    q = rows.filter("id <= 3").withColumn("id", F.col("id") + 100)
    got = {r.id: r.match for r in best_match(q, rows, block_bytes=16).collect()}
    assert got == {101: 1, 102: 2, 103: 3}


def test_engine(spark):
    e = Engine(spark, new_path(spark, "engine"))
    now = 1_700_000_000_000
    notes = [("a", "the parser drops tokens"), ("b", "lunch was late today"), ("c", None)]
    e.ingest(spark.createDataFrame(notes, "id string, content string"), now)
    best = e.query("parser drops tokens", now + 5000).collect()
    assert best[0].id == "a" and best[0].probability > 0.9
    assert [r.line for r in e.context("parser drops tokens", now + 5000).collect()] == ["- [learning] the parser drops tokens"]
    e.consolidate(now + 2 * 86_400_000)
    assert {r.consolidation_state for r in e.store.read("memories").collect()} == {"consolidated"}
    e.forget(spark.createDataFrame([("a",)], "id string"))
    assert sorted(r.id for r in e.store.read("memories").collect()) == ["b", "c"] and e.store.read("access_history").count() == 2 and e.store.read("embeddings").count() == 1
    e.store.backup(new_path(spark, "backup"))


def test_manifest(spark):
    m = Manifest(spark, new_path(spark, "manifest"))
    assert m.read() == (0, {})
    m.commit(1, {"a": 1})
    with pytest.raises(RuntimeError):
        m.commit(1, {"a": 2})
    assert m.read() == (1, {"a": 1})
