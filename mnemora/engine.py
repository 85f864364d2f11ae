"""The operations of the memory store as one object: ingest, retrieve, context, forget, maintain."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.config import CORE, DAY_MS, EPISODE, RetrievalConfig
from mnemora.functions import activation as act
from mnemora.functions import visual as vis
from mnemora.functions.text import gist, tokens
from mnemora.functions.vector import cosine
from mnemora.operators.coaccess import co_access_by_task, co_access_by_time, co_access_strength, locations
from mnemora.operators.consolidation import decay_associations, next_state, primed, strengthened
from mnemora.operators.episodes import episodes, links
from mnemora.operators.retrieval import context_with_visuals, retrieve_batch, retrieve_server, retrieve_visual, within_budget
from mnemora.operators.similarity import best_match, recent_matches
from mnemora.sources.embed import backfill, hashed_embedder
from mnemora.sources.shared import materialize
from mnemora.sources.store import MemoryStore

MODEL = "hashed-256"
ASSOCIATE_MS, ASSOCIATE_LEAST, ASSOCIATE_MOST, SIMILAR = 1_800_000, 0.4, 5, 0.4


def route(best: DataFrame) -> DataFrame:
    """id, match, zone of new notes: what becomes of each, by the surprise that its most similar note leaves.

    ``best`` has id, s, match, and of the match accesses, idle_days (since its last use) and strength; without a match
    that is similar enough a note is a new one.
    """
    low, high = act.thresholds(F.col("accesses"), F.col("idle_days"))
    error = act.surprise(F.col("s"), F.col("idle_days"), F.col("strength"))
    zone = F.when(F.col("match").isNull() | (F.col("s") < SIMILAR), "new_trace").otherwise(act.error_zone(error, low, high))
    return best.select("id", F.when(F.col("s") >= SIMILAR, F.col("match")).alias("match"), zone.alias("zone"))


class Engine:
    """A store and what is asked of it.  Reading changes nothing; :meth:`record_access` is a step of its own."""

    def __init__(self, spark: SparkSession, folder: str, config: RetrievalConfig = CORE):
        self.spark, self.store, self.config = spark, MemoryStore(spark, folder), config
        self.embed = hashed_embedder(256)

    def ingest(self, notes: DataFrame, now: int) -> DataFrame:
        """Store notes (id, content, and any other column of memories) and return id, match and zone of each.

        A batch meets the store as it was before.  A note like a stored one only reinforces it; one that differs by a
        little takes its place and is reconsolidated; the others are new: they are encoded with the boost of important
        ones before them, embedded, associated with similar ones of the last 30 minutes and put into episodes.
        """
        have = set(notes.columns)
        given = lambda c, v: F.coalesce(c, v) if c in have else v
        made = notes.withColumn("gist", given("gist", gist(F.col("content")))).withColumn("created_at", given("created_at", F.lit(now).cast("bigint"))).withColumn("emotional_weight", given("emotional_weight", F.lit(0.5)))
        if "project_id" not in have:
            made = made.withColumn("project_id", F.lit(None).cast("string"))
        made = made.withColumn("vector", self.embed(F.coalesce("content", F.lit("")))).filter("id is not null").dropDuplicates(["id"])
        made = materialize(made, "notes")
        stored = self.store.read("embeddings")
        best = made.select("id", F.col("vector").alias("v")).join(best_match(made.select("id", F.col("vector").alias("v")), stored.select(F.col("memory_id").alias("id"), F.col("vector").alias("v")), others=True), "id", "left")
        old = self.store.read("memories").select(F.col("id").alias("match"), F.col("access_count").alias("accesses"), ((F.lit(now) - F.coalesce("last_accessed", "created_at")) / DAY_MS).alias("idle_days"), F.col("encoding_strength").alias("strength"))
        routes = materialize(route(best.join(old, "match", "left")), "routes")
        new = materialize(made.join(routes.filter("zone = 'new_trace'").select("id"), "id", "left_semi"), "new")
        self._change(made, routes, now)
        # new ones: encoding strength with the boost of earlier important memories, stored and new
        log = self.store.read("memories").select("id", F.col("created_at").alias("at"), F.col("emotional_weight").alias("importance")).unionByName(new.select("id", F.col("created_at").alias("at"), F.col("emotional_weight").alias("importance")))
        boost = primed(log.filter(F.col("at") >= F.lit(now) - DAY_MS))
        fresh = new.join(boost, "id", "left").withColumn("encoding_strength", F.least(act.encoding_strength(F.lit(0.5), F.col("emotional_weight"), F.lit(1)) + F.coalesce("boost", F.lit(0.0)), F.lit(1.0)))
        fresh = materialize(fresh.withColumn("consolidation_state", F.lit("fresh")).withColumn("access_count", F.lit(1)).withColumn("last_accessed", F.lit(now).cast("bigint")), "fresh")
        self.store.upsert("memories", fresh)
        self.store.append("access_history", fresh.select(F.col("id").alias("memory_id"), F.lit(now).alias("accessed_at")))
        self.store.upsert("embeddings", fresh.filter("vector is not null").select(F.col("id").alias("memory_id"), "vector", F.lit(MODEL).alias("model")))
        self.roll_up(fresh, now)
        vectors = self.store.read("memories").join(self.store.read("embeddings").withColumnRenamed("memory_id", "id"), "id").filter(F.col("created_at") >= F.lit(now) - 2 * ASSOCIATE_MS)
        near = recent_matches(vectors.select(F.coalesce("project_id", F.lit("")).alias("key"), "id", F.col("created_at").alias("at"), F.col("vector").alias("v")), ASSOCIATE_MS, ASSOCIATE_LEAST, ASSOCIATE_MOST)
        near = near.join(fresh.select(F.col("id").alias("src")), "src", "left_semi")
        self.store.associate(near.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("s").alias("strength"), F.lit("temporal").alias("type")), now)
        self.build_episodes(fresh.select("project_id"))
        return routes

    def _change(self, made: DataFrame, routes: DataFrame, now: int) -> None:
        """What notes do to the stored ones that they match: reinforce them, or take their place."""
        hit = routes.filter("zone <> 'new_trace'")
        last = hit.groupBy("match").agg(F.max_by(F.struct("id", "zone"), "id").alias("x"), F.count("*").alias("n")).select(F.col("match"), F.col("x.id").alias("by"), F.col("x.zone").alias("zone"), "n")
        text = made.select(F.col("id").alias("by"), F.col("content").alias("new_content"), F.col("gist").alias("new_gist"), F.col("vector").alias("new_vector"))
        m = materialize(self.store.read("memories").join(last.join(text, "by"), F.col("id") == F.col("match")), "changed")
        again = F.col("zone") == "reconsolidate"
        m2 = m.withColumn("content", F.when(again, F.col("new_content")).otherwise(F.col("content"))).withColumn("gist", F.when(again, F.col("new_gist")).otherwise(F.col("gist")))
        m2 = m2.withColumn("consolidation_state", F.when(again, "reconsolidating").otherwise(F.col("consolidation_state"))).withColumn("last_consolidated", F.when(again, F.lit(now)).otherwise(F.col("last_consolidated")))
        m2 = m2.withColumn("encoding_strength", F.when(again, F.col("encoding_strength")).otherwise(F.least(F.col("encoding_strength") + 0.05, F.lit(1.0)))).withColumn("access_count", F.col("access_count") + F.col("n")).withColumn("last_accessed", F.lit(now))
        self.store.upsert("memories", m2)
        self.store.upsert("embeddings", m.filter(again & F.col("new_vector").isNotNull()).select(F.col("match").alias("memory_id"), F.col("new_vector").alias("vector"), F.lit(MODEL).alias("model")))
        self.store.append("access_history", m.select(F.col("match").alias("memory_id"), F.lit(now).alias("accessed_at")))

    def roll_up(self, notes: DataFrame, now: int) -> None:
        """Touch the projects of new notes; those that the table lacks are made."""
        p = notes.filter("project_id is not null").groupBy(F.col("project_id").alias("id")).agg(F.lit(now).alias("last_active"))
        self.store.upsert("projects", p)

    def build_episodes(self, projects: DataFrame) -> None:
        """Episodes, their events and links out of the stored memories of these projects."""
        touched = projects.select(F.coalesce("project_id", F.lit("")).alias("key")).distinct()
        m = self.store.read("memories").select(F.coalesce("project_id", F.lit("")).alias("key"), "id", F.col("created_at").alias("at")).join(touched, "key", "left_semi")
        e = episodes(m).withColumn("episode_id", F.concat_ws("/", "key", "run", "part"))
        e = materialize(e, "episodes")
        bounds = e.groupBy("episode_id", F.col("key").alias("project_id"), "part").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"))
        self.store.upsert("episodes", bounds.select(F.col("episode_id").alias("id"), "project_id", "started_at", "ended_at", F.when(F.col("part") > 0, "max_events").otherwise("time_gap").alias("boundary_type"), F.col("started_at").alias("created_at")))
        self.store.upsert("episode_events", e.select("id", "episode_id", F.col("id").alias("memory_id"), "position", F.col("at").alias("created_at")))
        p = links(e).withColumn("episode_id", F.concat_ws("/", "key", "run", "part"))
        rows = p.select("episode_id", F.col("src").alias("source_event_id"), F.col("dst").alias("target_event_id"), F.col("forward").alias("strength"), F.lit("forward").alias("direction")).unionByName(p.select("episode_id", F.col("dst").alias("source_event_id"), F.col("src").alias("target_event_id"), F.col("backward").alias("strength"), F.lit("backward").alias("direction")))
        self.store.upsert("episode_temporal_links", rows.withColumn("id", F.concat_ws(">", "source_event_id", "target_event_id")))

    def store_visuals(self, pictures: DataFrame, now: int) -> None:
        """Store pictures with the defaults of what they lack, their first access, and vectors where ``vector`` is given."""
        p = pictures.withColumn("received_at", F.coalesce("received_at", F.lit(now)) if "received_at" in pictures.columns else F.lit(now)).withColumn("created_at", F.lit(now)).withColumn("last_accessed", F.lit(now)).withColumn("access_count", F.lit(1))
        self.store.upsert("visual_memories", p)
        self.store.append("visual_access_history", p.select(F.col("id").alias("visual_memory_id"), F.lit(now).alias("accessed_at")))
        if "vector" in pictures.columns:
            self.store.upsert("visual_embeddings", p.filter("vector is not null").select(F.col("id").alias("visual_memory_id"), "vector", F.lit(MODEL).alias("model")))

    def process_pending(self) -> None:
        """Vectors for what has none: memories by their content, pictures by their description."""
        self.store.upsert("embeddings", backfill(self.store.read("memories"), self.store.read("embeddings"), self.embed, MODEL))
        v = self.store.read("visual_memories").select("id", F.col("description").alias("content"))
        missing = backfill(v, self.store.read("visual_embeddings").withColumnRenamed("visual_memory_id", "memory_id"), self.embed, MODEL)
        self.store.upsert("visual_embeddings", missing.withColumnRenamed("memory_id", "visual_memory_id"))

    def migrate(self, model: str = MODEL) -> None:
        """Drop the vectors of other models, so that they are made anew by :meth:`process_pending`."""
        for table in ("embeddings", "visual_embeddings"):
            self.store._replace(table, self.store.read(table).filter(F.col("model") == model))

    def record_access(self, ids: DataFrame, now: int) -> None:
        """One more access of each memory: in the log, and in its count and last access."""
        n = ids.select("id").filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
        n = materialize(n.join(self.store.read("memories").select("id", "access_count"), "id"), "accessed")
        self.store.append("access_history", n.select(F.col("id").alias("memory_id"), F.lit(now).alias("accessed_at")))
        self.store.upsert("memories", n.select("id", (F.col("access_count") + F.col("n")).alias("access_count"), F.lit(now).alias("last_accessed")))

    def record_files(self, accesses: DataFrame) -> None:
        """File accesses (project, path, direct, context, at, id, task, activity, session): the log, places and pairs.

        Places and pairs are taken from the whole log, as their counts are.
        """
        names = {"project_id": "project", "path": "path", "context_description": "context", "was_direct_access": "direct", "task_context": "task", "activity_type": "activity", "accessed_at": "at", "session_id": "session"}
        self.store.append("location_access_contexts", accesses.select(*[F.col(v).alias(k) for k, v in names.items() if v in accesses.columns]))
        log = self.store.read("location_access_contexts").select(*[F.col(k).alias(v) for k, v in names.items()]).withColumn("id", F.xxhash64("project", "path", "at", "task"))
        x = locations(log)
        self.store.upsert("location_intuitions", x.select(F.col("project").alias("project_id"), "path", "description", "familiarity", F.col("accesses").alias("access_count"), F.col("saved").alias("searches_saved"), F.col("last").alias("last_accessed")))
        s = co_access_strength(co_access_by_task(log).unionByName(co_access_by_time(log)))
        both = s.select("project", F.col("a").alias("source_id"), F.col("b").alias("target_id"), "count", "strength").unionByName(s.select("project", F.col("b").alias("source_id"), F.col("a").alias("target_id"), "count", "strength"))
        self.store.upsert("location_associations", both.select(F.coalesce("project", F.lit("")).alias("project_id"), "source_id", "target_id", "strength", F.col("count").alias("co_access_count")))

    def _probes(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", self.embed("text").alias("v"))

    def vectors(self, now: int, kind: str | None = None) -> DataFrame:
        """Memories with vector, base level, emotion and strength; of one type only, if ``kind`` is given."""
        history = self.store.read("access_history").filter(F.col("accessed_at") <= now).groupBy(F.col("memory_id").alias("id")).agg(act.base_level(F.lit(now) - F.col("accessed_at"), self.config.decay).alias("b"))
        m = self.store.read("memories") if kind is None else self.store.read("memories").filter(F.col("type") == kind)
        m = m.join(self.store.read("embeddings").select(F.col("memory_id").alias("id"), F.col("vector").alias("v")), "id").join(history, "id", "left")
        return m.select("id", "type", "gist", "content", "v", "b", F.col("emotional_weight").alias("emotion"), F.col("encoding_strength").alias("strength"))

    def edges(self) -> DataFrame:
        a = self.store.read("associations")
        return a.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("strength").alias("w"), (self.config.backward * F.col("strength")).alias("bw"))

    def query(self, texts: str | list[str], now: int, kind: str | None = None) -> DataFrame:
        """The ranking of one text or of many; ``probe`` is a text's place in the list."""
        return retrieve_batch(self._probes([texts] if isinstance(texts, str) else texts), self.vectors(now, kind), self.edges(), self.config)

    def query_server(self, texts: list[str], now: int, limit: int = 10) -> DataFrame:
        """The same as a server refines it, the session being the last half hour's accesses."""
        p = self.store.read("episode_temporal_links")
        pairs = p.filter("direction = 'forward'").select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"), F.col("strength").alias("forward"))
        pairs = pairs.join(p.filter("direction = 'backward'").select(F.col("target_event_id").alias("src"), F.col("source_event_id").alias("dst"), F.col("strength").alias("backward")), ["src", "dst"])
        session = self.store.read("access_history").filter(F.col("accessed_at") >= now - EPISODE["gap_ms"] * 6).select(F.col("memory_id").alias("id"))
        return retrieve_server(self._probes(texts), self.vectors(now), self.edges(), pairs, session, limit)

    def visuals(self, now: int) -> DataFrame:
        history = self.store.read("visual_access_history").filter(F.col("accessed_at") <= now).groupBy(F.col("visual_memory_id").alias("id")).agg(act.base_level(F.lit(now) - F.col("accessed_at"), self.config.decay).alias("b"))
        v = self.store.read("visual_memories").join(self.store.read("visual_embeddings").select(F.col("visual_memory_id").alias("id"), F.col("vector").alias("v")), "id").join(history, "id", "left")
        return v.select("id", "v", "b", vis.emotional_weight(F.col("emotional_arousal")).alias("weight"), "significance", "description")

    def query_visual(self, texts: list[str], now: int, limit: int = 10) -> DataFrame:
        return retrieve_visual(self._probes(texts), self.visuals(now), config=replace(self.config, limit=limit))

    def _similar(self, texts: list[str], now: int) -> DataFrame:
        """Ranked memories with their similarity, the line that shows them and its tokens."""
        m = self.vectors(now).select("id", "v", "type", F.coalesce("gist", "content", F.lit("")).alias("line"))
        p = self._probes(texts).select(F.col("id").alias("probe"), F.col("v").alias("pv"))
        best = retrieve_batch(self._probes(texts), self.vectors(now), config=self.config).join(m, "id").join(p, "probe")
        return best.select("probe", "id", "total", "rank", "type", "line", cosine(F.col("v"), F.col("pv")).alias("similarity"), tokens(F.col("line")).alias("tokens"))

    def context(self, text: str, now: int, budget: int = 300, least: float = 0.3) -> DataFrame:
        """Lines of the best memories that are similar enough, as many as fit in the budget."""
        best = within_budget(self._similar([text], now).filter(F.col("similarity") >= least), budget, [F.col("rank")])
        return best.select("id", F.format_string("- [%s] %s", F.coalesce("type", F.lit("learning")), "line").alias("line"), "tokens")

    def context_with_visuals(self, texts: list[str], now: int, budget: int = 300) -> DataFrame:
        v = self.query_visual(texts, now, 5).join(self.visuals(now).select("id", "description"), "id")
        return context_with_visuals(self._similar(texts, now), v.withColumn("tokens", tokens(F.coalesce("description", F.lit("")))), budget)

    def forget(self, ids: DataFrame) -> None:
        self.store.forget(ids)

    def consolidate(self, now: int) -> None:
        """One pass of strengthening, decay and change of state; associations decay, and weak ones go."""
        m = self.store.read("memories")
        idle = F.lit(now) - F.coalesce("last_accessed", "created_at")
        changed = m.withColumn("encoding_strength", strengthened(F.col("encoding_strength"), idle)).withColumn("consolidation_state", next_state(F.col("consolidation_state"), F.lit(now) - F.col("created_at"), F.lit(now) - F.col("last_consolidated")))
        self.store._replace("memories", changed)
        self.store._replace("associations", decay_associations(self.store.read("associations"), now))
