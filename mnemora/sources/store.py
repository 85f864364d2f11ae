"""The memory store: versioned Parquet tables with upserts and cascading deletes.

Tables with a key are kept in buckets by a hash of the key, and an upsert rewrites only the buckets that it touches.
Logs only grow: a batch of accesses is one more folder, and nothing stored is read or written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.sources.versions import Manifest

#: Buckets of a keyed table; chosen when a store is made, as its files depend on it.
BUCKETS = 32
#: Columns of the stored tables (fixed by the data model), their key, and the value of a column that a row lacks.
TABLES: dict[str, tuple[str, list[str], dict[str, object]]] = {
    "memories": ("id string, type string, content string, gist string, created_at bigint, last_accessed bigint, access_count int, emotional_weight double, project_id string, tags string, encoding_strength double, encoding_context string, consolidation_state string, last_consolidated bigint", ["id"], {"type": "learning", "access_count": 0, "emotional_weight": 0.5, "tags": "[]", "encoding_strength": 0.5, "encoding_context": "{}", "consolidation_state": "fresh"}),
    "embeddings": ("memory_id string, vector array<float>, model string", ["memory_id"], {}),
    "associations": ("source_id string, target_id string, strength double, type string, last_reinforced bigint, co_access_count int", ["source_id", "target_id"], {"strength": 0.5, "type": "semantic", "co_access_count": 1}),
    "projects": ("id string, path string, name string, last_active bigint, context string", ["id"], {"context": "{}"}),
    "location_intuitions": ("project_id string, path string, description string, purpose string, familiarity double, access_count bigint, searches_saved bigint, last_accessed bigint, created_at bigint, updated_at bigint, context_limit int, pinned boolean", ["project_id", "path"], {"familiarity": 0.1, "access_count": 0, "searches_saved": 0, "context_limit": 50, "pinned": False}),
    "location_associations": ("project_id string, source_id string, target_id string, strength double, co_access_count double, last_co_access bigint, created_at bigint", ["project_id", "source_id", "target_id"], {"strength": 0.1, "co_access_count": 1.0}),
    "visual_memories": ("id string, description string, original_path string, media_type string, objects string, emotional_valence double, emotional_arousal double, significance double, shared_by string, source string, received_at bigint, last_accessed bigint, access_count int, created_at bigint, project_id string", ["id"], {"objects": "[]", "emotional_valence": 0.0, "emotional_arousal": 0.5, "significance": 0.5, "source": "direct", "access_count": 0}),
    "visual_embeddings": ("visual_memory_id string, vector array<float>, model string", ["visual_memory_id"], {}),
    "sessions": ("id string, started_at bigint, ended_at bigint, project_id string, last_active_at bigint, metadata string", ["id"], {"metadata": "{}"}),
    "episodes": ("id string, project_id string, started_at bigint, ended_at bigint, boundary_type string, encoding_context string, encoding_strength double, created_at bigint", ["id"], {"boundary_type": "time_gap", "encoding_context": "{}", "encoding_strength": 0.5}),
    "episode_events": ("id string, episode_id string, memory_id string, position int, created_at bigint", ["id"], {}),
    "episode_temporal_links": ("id string, episode_id string, source_event_id string, target_event_id string, strength double, direction string, created_at bigint", ["id"], {}),
}
#: Tables that only grow.
LOGS = {
    "access_history": "memory_id string, accessed_at bigint",
    "visual_access_history": "visual_memory_id string, accessed_at bigint",
    "location_access_contexts": "project_id string, path string, context_description string, was_direct_access boolean, task_context string, activity_type string, activity_source string, is_summary boolean, accessed_at bigint, session_id string",
}
#: Tables that lose their rows with a row of another, by the column that names it.
CHILDREN = {
    "memories": {"embeddings": ["memory_id"], "access_history": ["memory_id"], "associations": ["source_id", "target_id"], "episode_events": ["memory_id"]},
    "visual_memories": {"visual_embeddings": ["visual_memory_id"], "visual_access_history": ["visual_memory_id"]},
}


class MemoryStore:
    """Tables in ``folder``.  A write makes a new version of its table; readers of the old one aren't disturbed.

    Defined results: rows with a null in a key column aren't stored; of several new rows with one key the last by its
    columns' order counts; columns that ``rows`` lacks, and nulls, keep their old value or take the default.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _manifest(self, table: str) -> Manifest:
        return Manifest(self.spark, f"{self.folder}/{table}")

    def read(self, table: str) -> DataFrame:
        """The current version; a new table is empty, and a column that its files lack has its default."""
        schema, _, defaults = TABLES[table] if table in TABLES else (LOGS[table], [], {})
        _, content = self._manifest(table).read()
        paths = content.get("parts", [])
        if not paths and not content.get("buckets"):
            return self.spark.createDataFrame([], schema)
        paths = paths or [f"v{v}/bucket={b}" for b, v in content["buckets"].items()]
        df = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table}/{p}" for p in paths])
        return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})

    def lookup(self, table: str, **equal: object) -> DataFrame:
        """The rows with these values; a whole key reads the one bucket that may hold it."""
        df = self.read(table)
        for c, v in equal.items():
            df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
        key = TABLES[table][1] if table in TABLES else []
        _, content = self._manifest(table).read()
        if key and set(key) <= set(equal) and content.get("buckets"):
            one = self.spark.range(1).select(self._bucket([F.lit(equal[k]) for k in key]).alias("b")).first()["b"]
            if str(one) not in content["buckets"]:
                return df.filter("false")
            path = f"{self.folder}/{table}/v{content['buckets'][str(one)]}/bucket={one}"
            df = self.spark.read.schema(TABLES[table][0]).parquet(path).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in TABLES[table][2].items()})
            for c, v in equal.items():
                df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
        return df

    def _bucket(self, key: list):
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets))

    def _write(self, table: str, df: DataFrame, touched: list[int] | None, content: dict, version: int) -> None:
        """Replace the ``touched`` buckets (all, if None) by those of ``df`` in one atomic step."""
        schema, key, _ = TABLES[table]
        names = [f.split()[0] for f in schema.split(", ")]
        path = f"{self.folder}/{table}/v{version}"
        out = df.select(*names, self._bucket(key).alias("bucket"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        made = {str(r[0]): version for r in out.select("bucket").distinct().collect()}  # one row for each bucket at most
        kept = {} if touched is None else {b: v for b, v in content.get("buckets", {}).items() if int(b) not in touched}
        self._manifest(table).commit(version, {"buckets": kept | made})

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows take the place of those with their key; only the buckets of these keys are read and written."""
        schema, key, _ = TABLES[table]
        kinds = dict(f.split(" ", 1) for f in schema.split(", "))
        version, content = self._manifest(table).read()
        new = rows.select(*[F.col(n).cast(k).alias(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]).na.drop(subset=key)
        rest = [n for n in kinds if n not in key]
        new = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("x")).select(*key, *[F.col(f"x.{n}").alias(n) for n in rest])
        touched = [r[0] for r in new.select(self._bucket(key).alias("b")).distinct().collect()]  # one row for each bucket at most
        old = {b: v for b, v in content.get("buckets", {}).items() if int(b) in touched}
        stored = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table}/v{v}/bucket={b}" for b, v in old.items()]) if old else self.spark.createDataFrame([], schema)
        merged = new.alias("n").join(stored.alias("o"), key, "full").select(*key, *[F.coalesce(f"n.{n}", f"o.{n}").alias(n) for n in rest])
        self._write(table, merged, touched, content, version + 1)

    def append(self, log: str, rows: DataFrame) -> None:
        """One more folder of a log."""
        kinds = dict(f.split(" ", 1) for f in LOGS[log].split(", "))
        version, content = self._manifest(log).read()
        path = f"p{version + 1}"
        rows.select(*[F.col(n).cast(k).alias(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]).write.mode("overwrite").parquet(f"{self.folder}/{log}/{path}")
        self._manifest(log).commit(version + 1, {"parts": [*content.get("parts", []), path]})

    def _replace(self, table: str, df: DataFrame) -> None:
        version, content = self._manifest(table).read()
        if table in LOGS:
            df.write.mode("overwrite").parquet(f"{self.folder}/{table}/p{version + 1}")
            self._manifest(table).commit(version + 1, {"parts": [f"p{version + 1}"]})
        elif content.get("buckets"):
            self._write(table, df, None, content, version + 1)

    def forget(self, ids: DataFrame, table: str = "memories") -> None:
        """Delete the rows with these ``id`` and what hangs on them; children first, so that none is left behind.

        With events go the links of these events.
        """
        gone = ids.select("id").distinct()
        if table == "memories":
            events = self.read("episode_events").join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi").select("id")
            links = self.read("episode_temporal_links")
            for c in ("source_event_id", "target_event_id"):
                links = links.join(events.withColumnRenamed("id", c), c, "left_anti")
            self._replace("episode_temporal_links", links)
        for child, columns in CHILDREN[table].items():
            df = self.read(child)
            for c in columns:
                df = df.join(gone.withColumnRenamed("id", c), c, "left_anti")
            self._replace(child, df)
        self._replace(table, self.read(table).join(gone, "id", "left_anti"))

    def associate(self, pairs: DataFrame, now: int) -> None:
        """Upsert associations (source_id, target_id, strength, type): a stored pair takes the new strength, its count grows."""
        a = self.read("associations").select("source_id", "target_id", F.col("co_access_count").alias("seen"))
        new = pairs.join(a, ["source_id", "target_id"], "left").withColumn("co_access_count", F.coalesce(F.col("seen") + 1, F.lit(1))).withColumn("last_reinforced", F.lit(now))
        self.upsert("associations", new.drop("seen"))

    def dissociate(self, pairs: DataFrame) -> None:
        self._replace("associations", self.read("associations").join(pairs, ["source_id", "target_id"], "left_anti"))

    def prune_associations(self, threshold: float = 0.1) -> None:
        self._replace("associations", self.read("associations").filter(F.col("strength") >= threshold))

    def backup(self, folder: str) -> None:
        """A copy of all tables as plain Parquet."""
        for table in [*TABLES, *LOGS]:
            self.read(table).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{table}")
