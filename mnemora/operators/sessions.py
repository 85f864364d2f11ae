"""Sessions by inactivity gaps, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.runs import merge_runs
from mnemora.sources.versions import Manifest

GAP_MS = 30 * 60 * 1000
#: A cell of the fold is 2**27 ms (37 hours), of the next level 2**36 (two years); a slice of the table 2**31 (25 days).
CELL_BITS = 27
LEVEL_BITS = 36
SLICE_BITS = 31
#: Parts of a slice by key; a batch rewrites the parts that its keys and times touch.
KEY_PARTS = 4

_SPACE = r"[\s\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_BLANK = f"^{_SPACE}|{_SPACE}$"


def clean_key(c: Column) -> Column:
    """Lower case without white space around it; null where nothing is left."""
    key = F.lower(F.regexp_replace(c, _BLANK, ""))
    return F.when(key != "", key)


def _fold(pieces: DataFrame, gap_ms: int) -> DataFrame:
    return merge_runs(
        pieces,
        ["key"],
        "started_at",
        [CELL_BITS, LEVEL_BITS, None],
        lambda _, greatest: F.col("started_at") - greatest("ended_at") < gap_ms,
        head=[],
        tail=[],
        total=["events"],
        high=["ended_at"],
    )


class SessionTable:
    """The sessions of all batches so far, in ``path``.

    A batch has columns ``key`` (string), ``at`` (bigint ms) and ``id`` (string).  A gap of ``gap_ms`` or more between
    two events of a key starts a new session.  :meth:`merge` folds the batch's events into local sessions, takes the
    stored sessions of the parts (a slice of time and a share of the keys) within a gap of the batch's events, merges
    what a batch's session bridges, and replaces the affected parts in one atomic step; others aren't read.

    Defined results: rows with a null in key, at or id are in no session; an id counts once, with its first (time,
    key), in whatever batch and under whatever key it comes again within a slice of time; events at the same time are
    one place; an empty batch changes nothing; other columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, gap_ms: int = GAP_MS, key_parts: int = KEY_PARTS):
        self.spark, self.path, self.gap, self.key_parts = spark, path.rstrip("/"), gap_ms, key_parts
        self.manifest = Manifest(spark, self.path)

    def _read(self, kind: str, parts: dict, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/v{x['version']}/{x['at']}" for x in parts.values()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _part(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.key_parts)).cast("int")

    def sessions(self) -> DataFrame:
        """key, started_at, ended_at, duration_ms, events."""
        _, content = self.manifest.read()
        table = self._read("sessions", content.get("sessions", {}), "key string, started_at bigint, ended_at bigint, events bigint")
        return table.select("key", "started_at", "ended_at", (F.col("ended_at") - F.col("started_at")).alias("duration_ms"), "events")

    def merge(self, batch: DataFrame) -> None:
        version, content = self.manifest.read()
        stored, members = content.get("sessions", {}), content.get("ids", {})
        slice_ = F.shiftright("at", SLICE_BITS)
        events = batch.select("key", "at", "id").filter("key is not null and at is not null and id is not null")
        events = events.groupBy("id").agg(F.min(F.struct("at", "key")).alias("x")).select("x.key", "x.at", "id")
        version += 1
        # the batch's new members first: they are read again below, and kept for later batches
        if members:
            touched = {r[0] for r in events.select(slice_).distinct().collect()}  # one row for each 25 days
            seen = self._read("ids", {k: x for k, x in members.items() if x["slice"] in touched}, "id string")
            events = events.join(seen, "id", "left_anti")
        ids_path = f"{self.path}/ids/v{version}"
        events.withColumn("slice", slice_).write.mode("overwrite").partitionBy("slice").parquet(ids_path)
        fresh = self.spark.read.schema("key string, at bigint, id string, slice bigint").parquet(ids_path)
        bounds = fresh.groupBy("slice", self._part().alias("part")).agg(F.min("at").alias("low"), F.max("at").alias("high")).collect()  # one row for each part
        if not bounds:
            return
        # affected: what a session of the batch may touch, and what shares a part with one
        own = {f"{r['slice']}/{r['part']}" for r in bounds}
        near = {k: x for k, x in stored.items() if k in own or any(x["part"] == r["part"] and x["ended"] >= r["low"] - self.gap and x["started"] <= r["high"] + self.gap for r in bounds)}
        old = self._read("sessions", near, "key string, started_at bigint, ended_at bigint, events bigint")
        # a stored session is cut at the edges of the cells, so that what it covers meets it in its own cell
        cells = F.explode(F.sequence(F.shiftright("started_at", CELL_BITS), F.shiftright("ended_at", CELL_BITS)))
        old = old.select("*", cells.alias("cell")).select(
            "key",
            F.greatest("started_at", F.shiftleft("cell", CELL_BITS)).alias("from"),
            F.least("ended_at", F.shiftleft(F.col("cell") + 1, CELL_BITS) - 1).alias("ended_at"),
            F.when(F.shiftleft("cell", CELL_BITS) <= F.col("started_at"), F.col("events")).otherwise(0).alias("events"),
        )
        new = fresh.select("key", F.col("at").alias("from"), F.col("at").alias("ended_at"), F.lit(1).cast("bigint").alias("events"))
        cell = F.shiftright("from", CELL_BITS).alias("cell")
        pieces = new.unionByName(old).select("*", cell).repartition("key", "cell")
        pieces = pieces.groupBy("key", "cell", F.col("from").alias("started_at")).agg(F.max("ended_at").alias("ended_at"), F.sum("events").alias("events"))
        result = _fold(pieces, self.gap).withColumn("slice", F.shiftright("started_at", SLICE_BITS)).withColumn("part", self._part())
        path = f"{self.path}/sessions/v{version}"
        result.write.mode("overwrite").partitionBy("slice", "part").parquet(path)
        made = self.spark.read.schema("key string, started_at bigint, ended_at bigint, events bigint, slice bigint, part int").parquet(path)
        spans = made.groupBy("slice", "part").agg(F.min("started_at").alias("started"), F.max("ended_at").alias("ended")).collect()  # one row for each part
        sessions = {k: x for k, x in stored.items() if k not in near}
        sessions |= {f"{r['slice']}/{r['part']}": {"version": version, "at": f"slice={r['slice']}/part={r['part']}", "part": r["part"], "started": r["started"], "ended": r["ended"]} for r in spans}
        ids = members | {f"{k}/{version}": {"version": version, "at": f"slice={k}", "slice": k} for k in sorted({r["slice"] for r in bounds})}
        self.manifest.commit(version, {"sessions": sessions, "ids": ids})
