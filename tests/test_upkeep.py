import random
import time

import pytest
from pyspark.sql import functions as F

from mnemora.engine import Engine
from mnemora.functions.location import activity
from mnemora.functions.registry import register
from mnemora.functions.text import gist_of, sentences, tokens
from mnemora.operators.cells import numbered
from mnemora.operators.consolidation import decay_associations, primed, working_memory
from mnemora.operators.episodes import merge_links, narrative
from mnemora.operators.frames import frame_plan, in_speech, text_within
from mnemora.sources.shared import new_path
from mnemora.sources.store import MemoryStore
from mnemora.streaming.streams import every


def test_numbering_in_cells(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), at, n, "z") for n, at in enumerate(sorted(r.randrange(2000) for _ in range(300)))]
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, _cell string").drop("_cell")
    got = {x.id: x for x in numbered(df, ["key"], ["at", "id"], F.shiftright("at", 6), lambda b, t: t("at") - b("at") > 20, prev=["id"]).collect()}
    for key in ("a", "b", None):
        run, before = 0, None
        for k, (_, at, n, _) in enumerate([x for x in rows if x[0] == key]):
            run += before is None or at - before[1] > 20
            assert (got[n].run, got[n].row, got[n].prev_id) == (run, k + 1, before[2] if before else None)
            before = (key, at, n)
    assert numbered(df.filter("false"), ["key"], ["at", "id"], F.shiftright("at", 6)).count() == 0


def test_priming(spark):
    r = random.Random(3)
    rows = [(f"m{k:03d}", r.randrange(300_000_000), r.choice([None, 0.1, 0.69, 0.7, 0.75, 0.9, 1.0]), 0.0) for k in range(200)] + [("n", None, 1.0, 0.0)]
    got = {x.id: x.boost for x in primed(spark.createDataFrame(rows, "id string, at bigint, importance double, boost double")).collect()}
    strength, since = 0.0, 0
    for i, at, importance, _ in sorted(rows[:-1], key=lambda x: (x[1], x[0])):  # as the state of a single store goes
        now = strength * 0.5 ** ((at - since) / 5_400_000)
        now = now if now >= 0.01 else 0.0
        assert got[i] == pytest.approx(now, abs=1e-9)
        new = min(((importance or 0) - 0.7) * 1.67, 0.5)
        if importance is not None and importance >= 0.7 and now <= new:
            strength, since = new, at
    assert "n" not in got


def test_working_memory(spark):
    rows = [("p", f"m{k}", 1000 * k) for k in range(30)] + [("p", "m28", 30_000), ("p", None, 31_000), ("q", "x", 5), ("q", "y", 5)]
    got = [(r.by, r.id, r.at, r.k) for r in working_memory(spark.createDataFrame(rows, "by string, id string, at bigint"), ["by"]).orderBy("by", "k").collect()]
    assert [x[1] for x in got if x[0] == "p"] == ["m28", "m29", "m27", "m26", "m25", "m24", "m23"] and [x[1] for x in got if x[0] == "q"] == ["x", "y"]


def test_association_decay(spark):
    h = 3_600_000
    df = spark.createDataFrame([("a", 0.9, 0), ("b", 0.9, None), ("c", 0.5, h), ("d", 0.2, 0), ("e", 0.9, 5 * h)], "id string, strength double, last_reinforced bigint")
    got = {r.id: r.strength for r in decay_associations(df, h).collect()}
    assert got == {"a": pytest.approx(0.9 / 2.718281828), "b": 0.9, "c": 0.5, "e": 0.9}


def test_links_and_narrative(spark):
    rows = spark.createDataFrame([("x", "y", 0, 1, 0.8), ("y", "x", 1, 0, 0.6), ("x", "y", 0, 1, 0.5), ("z", "z", 2, 2, 1.0), ("y", "z", 1, 2, 0.3)], "src string, dst string, src_position int, dst_position int, strength double")
    assert {(r.a, r.b): (r.forward, r.backward) for r in merge_links(rows).collect()} == {("x", "y"): (0.8, 0.6), ("y", "z"): (0.3, 0.0)}
    pairs = spark.createDataFrame([(1, 2, 1, 0.7, 0.5), (1, 3, 2, 0.5, 0.4), (2, 3, 1, 0.7, 0.5)], "src bigint, dst bigint, distance int, forward double, backward double")
    members = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "event bigint, memory string")
    anchors = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, place int")
    assert {(r.id, r.score) for r in narrative(anchors, members, pairs).collect()} == {("b", 0.5), ("a", 0.4)}
    assert {r.id for r in narrative(anchors, members, pairs, "after").collect()} == {"b", "c"}
    assert narrative(anchors.filter("false"), members, pairs).count() == 0


def test_transcripts(spark):
    f = spark.createDataFrame([("v", 0, 1.0), ("v", 1, 25.0), ("v", 2, None), ("w", 0, 1.0)], "video_id string, frame_number int, timestamp_seconds double")
    s = spark.createDataFrame([("v", 0.5, 40.0, "long"), ("v", 1.0, 1.0, "point"), ("v", 24.0, 26.0, "late"), ("v", 9.0, 3.0, "wrong")], "video_id string, start_s double, end_s double, text string")
    assert {(r.frame_number, r.text) for r in in_speech(f, s).collect()} == {(0, "long"), (1, "long")}
    assert [r.text for r in text_within(s, F.lit(1.0), F.lit(30.0)).collect()] == ["point late"]
    v = spark.createDataFrame([("a", 2.5), ("b", 400.0), ("c", None), ("d", 0.0)], "video_id string, duration double")
    got = [(r.video_id, r.i, r.timestamp_seconds) for r in frame_plan(v).collect()]
    assert [x[2] for x in got if x[0] == "a"] == pytest.approx([0, 2.5 / 3, 5 / 3]) and sum(x[0] == "b" for x in got) == 100 and {x[0] for x in got} == {"a", "b"}


def test_texts(spark):
    df = spark.createDataFrame([("One. Two? 00", "fix it", "unknown"), ("\U0001f600" * 4, None, "writing"), ("", "", None)], "t string, c string, e string")
    got = df.select(sentences(F.col("t")).alias("s"), tokens(F.col("t")).alias("n"), activity(F.col("c"), None, F.col("e")).alias("a")).collect()
    assert got[0].s == ["One.", "Two?", "00"] and [r.n for r in got] == [3, 2, 0] and [r.a.activity for r in got] == ["debugging", "writing", "unknown"]
    long_ = "The parser drops every token. " + "Scanner tokens and scanner buffers overflow when the scanner reads. " * 3
    assert gist_of(long_) == "The parser drops every token. [scanner, tokens, buffers]"
    assert gist_of(None) is None and gist_of("  a \n b ") == "a b" and gist_of("x" * 200) == "..."


def test_functions_for_sql(spark):
    assert "mem_zone" in register(spark)
    r = spark.sql("select mem_zone(0.3D, 0.1D, 0.55D) z, mem_encoding(1D, 1D, 20) e, mem_boost(-1D) b, mem_session_decay(60000D) d").first()
    assert (r.z, r.e, r.b, r.d) == ("reconsolidate", 1.0, 1.0, 0.3)


def test_store_touches_only_buckets_of_its_keys(spark):
    s = MemoryStore(spark, new_path(spark, "store"), buckets=4)
    assert s.read("projects").count() == 0 and s.lookup("projects", id="a").count() == 0
    s.upsert("projects", spark.createDataFrame([(f"p{k}", f"/x/{k}") for k in range(20)] + [(None, "/no")], "id string, path string"))
    before = s._manifest("projects").read()[1]["buckets"]
    s.upsert("projects", spark.createDataFrame([("p3", None, "three"), ("p3", None, "three")], "id string, path string, name string"))
    after = s._manifest("projects").read()[1]["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert [(r.path, r.name, r.context) for r in s.lookup("projects", id="p3").collect()] == [("/x/3", "three", "{}")] and s.read("projects").count() == 20
    assert [r.id for r in s.lookup("projects", path="/x/7").collect()] == ["p7"]
    log = spark.createDataFrame([("m", 1), ("m", 2)], "memory_id string, accessed_at bigint")
    s.append("access_history", log)
    s.append("access_history", log.limit(1))
    assert s.read("access_history").count() == 3
    pair = spark.createDataFrame([("a", "b", 0.6, "semantic")], "source_id string, target_id string, strength double, type string")
    s.associate(pair, 5)
    s.associate(pair.withColumn("strength", F.lit(0.05)), 6)
    assert [(r.strength, r.co_access_count, r.last_reinforced) for r in s.read("associations").collect()] == [(0.05, 2, 6)]
    s.prune_associations()
    assert s.read("associations").count() == 0


def test_engine_pipeline(spark):
    e = Engine(spark, new_path(spark, "engine"))
    now, minute = 1_700_000_000_000, 60_000
    schema = "id string, content string, created_at bigint, emotional_weight double, project_id string"
    e.ingest(spark.createDataFrame([("a", "the parser drops tokens of long lines", now, 1.0, "p"), ("b", "lunch was late today again", now + minute, 0.5, "p")], schema), now)
    routes = {r.id: (r.match, r.zone) for r in e.ingest(spark.createDataFrame([("c", "the parser drops tokens of long lines", now + 2 * minute, 0.5, "p"), ("d", "the parser keeps tokens of short lines", now + 2 * minute, 0.5, "p"), ("e", "nothing of the kind", now + 2 * minute, 0.5, "q")], schema), now + 2 * minute).collect()}
    assert routes["c"] == ("a", "reinforce") and routes["d"][0] == "a" and routes["e"] == (None, "new_trace")
    m = {r.id: r for r in e.store.read("memories").collect()}
    assert set(m) == {"a", "b", "d", "e"} and routes["d"][1] == "new_trace" and m["a"].access_count == 2 and m["b"].encoding_strength > m["a"].encoding_strength - 0.5
    assert {r.id for r in e.store.read("projects").collect()} == {"p", "q"}
    assert {(r.memory_id, r.position) for r in e.store.read("episode_events").collect()} == {("a", 0), ("b", 1), ("d", 2), ("e", 0)} and e.store.read("episode_temporal_links").count() == 6
    assert e.query(["parser tokens", "lunch today"], now + 5000, kind="learning").filter("rank = 1").orderBy("probe").select("id").collect()[1].id == "b"
    assert e.query_server(["parser tokens"], now + 5000).count() >= 1
    e.store_visuals(spark.createDataFrame([("v", "a parser in a dim room")], "id string, description string"), now)
    e.process_pending()
    assert e.query_visual(["parser room"], now + 5000).first().id == "v" and e.store.read("visual_memories").first().emotional_arousal == 0.5
    assert {r.what for r in e.context_with_visuals(["the parser drops tokens in a dim room"], now + 5000).collect()} == {"text", "visual"}
    e.record_files(spark.createDataFrame([("p", "x", True, "fix", now, 1), ("p", "y", False, "fix", now + 1, 1)], "project string, path string, direct boolean, context string, at bigint, task int").withColumn("task", F.col("task").cast("string")))
    assert e.store.read("location_intuitions").count() == 2 and e.store.read("location_associations").count() == 2
    e.record_access(spark.createDataFrame([("b",), ("b",), ("none",)], "id string"), now + 9)
    assert e.store.lookup("memories", id="b").first().access_count == 3
    e.consolidate(now + 10 * minute)
    e.migrate("other")
    assert e.store.read("embeddings").count() == 0
    e.forget(spark.createDataFrame([("a",)], "id string"))
    assert e.store.read("episode_temporal_links").count() == 2 and e.store.read("episode_events").count() == 3


def test_maintenance_by_the_clock(spark):
    seen = []
    query = every(spark, "1 second", seen.append)
    for _ in range(60):
        if seen:
            break
        time.sleep(0.5)
    query.stop()
    assert seen
