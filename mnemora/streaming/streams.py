"""Structured Streaming forms of the continuous operators; each run takes what is there and ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemora.config import EPISODE, PRIMING, WORKING_MEMORY
from mnemora.functions.location import familiarity
from mnemora.operators.cells import numbered
from mnemora.operators.episodes import CELL_BITS
from mnemora.operators.sessions import SessionTable
from mnemora.sources.shared import materialize, new_path
from mnemora.sources.versions import Manifest


def read_stream(spark: SparkSession, folder: str, table: str, files: int | None = None) -> DataFrame:
    """New files of a Parquet table, be it one file in ``folder`` or a folder of its own; ``files`` for each batch at most."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(f"{folder}/{table}.parquet*")


def run(df: DataFrame, mode: str, sink: Any) -> None:
    """Run ``sink(batch, number)`` on all that the stream has; its progress is kept in the shared folder."""
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()


def every(spark: SparkSession, interval: str, step: Callable[[int], None]) -> StreamingQuery:
    """Run ``step(now in ms)`` once in each ``interval`` ('5 minutes') until the query is stopped: maintenance by the clock.

    The times come from a rate source and are kept in the shared folder, so a restarted driver goes on where it was.
    """

    def sink(batch: DataFrame, _: int) -> None:
        at = batch.agg(F.max(F.unix_millis("timestamp"))).first()[0]
        if at is not None:
            step(at)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(sink).option("checkpointLocation", new_path(spark, "progress")).trigger(processingTime=interval).start()


def _latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    _, content = Manifest(spark, path).read()
    return spark.read.schema(schema).parquet(f"{path}/{content['state']}") if content.get("state") else spark.createDataFrame([], schema)


def familiarity_stream(accesses: DataFrame, path: str) -> None:
    """Keep project, path, accesses, last, familiarity of every location in ``path``.

    The state is Spark's own; a batch's changed locations replace theirs in the table, which is one version at a time.
    """
    counts = accesses.groupBy("project", "path").agg(F.count("*").alias("accesses"), F.max("at").alias("last"))
    schema = "project string, path string, accesses bigint, last bigint, familiarity double"

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = batch.withColumn("familiarity", familiarity(F.col("accesses"))).select("project", "path", "accesses", "last", "familiarity")
        kept = _latest(spark, path, schema)
        same = kept["project"].eqNullSafe(changed["project"]) & kept["path"].eqNullSafe(changed["path"])
        kept.join(changed, same, "left_anti").unionByName(changed).write.mode("overwrite").parquet(f"{path}/v{number + 1}")
        manifest = Manifest(spark, path)
        manifest.commit(manifest.read()[0] + 1, {"state": f"v{number + 1}"})

    run(counts, "update", sink)


def latest_familiarity(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every location."""
    return _latest(spark, path, "project string, path string, accesses bigint, last bigint, familiarity double")


def session_stream(events: DataFrame, table: SessionTable) -> None:
    """Merge each batch of key, at and id into the session table."""
    run(events, "append", lambda batch, _: table.merge(batch))


def episode_stream(events: DataFrame, path: str, gap_ms: int = EPISODE["gap_ms"], most: int = EPISODE["most_events"]) -> None:
    """Write key, episode, position, id, at of every event to ``path/events``, and each key's open episode to ``path/open``.

    Events of a key must come in order from batch to batch; within a batch they are put in order.  A batch's events are
    numbered in cells of time, as in the batch operator, and its first run of a key goes on with the key's open
    episode if it begins within the gap; an event earlier than the open episode's last one joins it.
    """
    state = "key bigint, last bigint, episode bigint, position bigint"

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        e = numbered(batch.select("key", "id", "at").filter("key is not null and at is not null"), ["key"], ["at", "id"], F.shiftright("at", CELL_BITS), lambda before, this: this("at") - before("at") > gap_ms)
        e = materialize(e, "episodes")
        runs = e.groupBy("key", "run").agg(F.min("row").alias("from"), F.min("at").alias("begins"), F.count("*").alias("n"))
        before = _latest(spark, path, state)
        runs = runs.join(before, "key", "left")
        goes_on = (F.col("run") == 1) & F.col("last").isNotNull() & (F.col("begins") - F.col("last") <= gap_ms)
        runs = runs.withColumn("offset", F.when(goes_on, F.col("position") + 1).otherwise(0))
        # a run of n events from a position on fills so many episodes anew
        runs = runs.withColumn("parts", F.floor((F.col("offset") + F.col("n") - 1) / most))
        earlier = F.sum(F.col("parts") + F.when(goes_on, 0).otherwise(1)).over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.withColumn("first", F.coalesce(F.col("episode"), F.lit(0)) + F.coalesce(earlier, F.lit(0)) + F.when(goes_on, 0).otherwise(1))
        place = F.col("offset") + F.col("row") - F.col("from")
        out = e.join(runs.select("key", "run", "from", "offset", "first"), ["key", "run"])
        out = out.select("key", (F.col("first") + F.floor(place / most)).alias("episode"), (place % most).alias("position"), "id", "at")
        out.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        written = spark.read.parquet(f"{path}/events/batch={number}")
        last = written.groupBy("key").agg(F.max(F.struct("episode", "position")).alias("x"), F.max("at").alias("last")).select("key", "last", "x.episode", "x.position")
        old = before.join(last, "key", "left_anti")
        newer = last.join(before.select("key", F.col("last").alias("was")), "key", "left").select("key", F.greatest("last", "was").alias("last"), "episode", "position")
        newer.unionByName(old.select("key", "last", "episode", "position")).write.mode("overwrite").parquet(f"{path}/open-{number}")
        manifest = Manifest(spark, path)
        manifest.commit(manifest.read()[0] + 1, {"state": f"open-{number}"})

    run(events, "append", sink)


def working_memory_stream(accesses: DataFrame, path: str) -> None:
    """Keep key, id, at: what each key used last, seven memories at most, none 20 seconds older than the last one.

    The state of a key is these few rows; of a batch's rows only as many are held at a time as Arrow delivers.
    """
    most, live = WORKING_MEMORY["capacity"], WORKING_MEMORY["expiry_ms"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, ats = state.get if state.exists else ([], [])
        held = dict(zip(ids, ats))
        for pdf in batches:
            for i, at in pdf.groupby("id")["at"].max().items():
                held[i] = max(held.get(i, at), at)
            top = max(held.values())
            held = dict(sorted(((i, at) for i, at in held.items() if top - at <= live), key=lambda x: (-x[1], x[0]))[:most])
        state.update((list(held), [int(x) for x in held.values()]))
        yield pd.DataFrame({"key": key[0], "id": list(held), "at": list(held.values())})

    out = accesses.groupBy("key").applyInPandasWithState(step, "key string, id string, at bigint", "ids array<string>, ats array<bigint>", "update", GroupStateTimeout.NoTimeout)

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "key string, id string, at bigint"
        batch = materialize(batch, "working")
        kept = _latest(spark, path, schema).join(batch.select("key").distinct(), "key", "left_anti")
        kept.unionByName(batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        manifest = Manifest(spark, path)
        manifest.commit(manifest.read()[0] + 1, {"state": f"v{number}"})

    run(out, "update", sink)


def latest_working_memory(spark: SparkSession, path: str) -> DataFrame:
    return _latest(spark, path, "key string, id string, at bigint")


def priming_stream(memories: DataFrame, path: str) -> None:
    """Keep in ``path`` the one number that says how strongly important memories (at, importance) prime the next one.

    A boost halves in a fixed time, so boosts compare as their logarithm plus their time in half-lives, and the state
    is a maximum, which Spark keeps and merges in any order.
    """
    given = F.least((F.col("importance") - PRIMING["threshold"]) * PRIMING["slope"], F.lit(PRIMING["most"]))
    place = F.when((F.col("importance") >= PRIMING["threshold"]) & (given > 0), F.log2(given) + F.col("at") / PRIMING["half_life_ms"])
    top = memories.agg(F.max(place).alias("place"), F.max("at").alias("at"))
    run(top, "complete", lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/v"))


def priming_at(spark: SparkSession, path: str, now: int | None = None) -> DataFrame:
    """boost: what is left at ``now`` (the last memory's time, if None)."""
    at = F.col("at") if now is None else F.lit(now)
    boost = F.pow(F.lit(2.0), F.col("place") - at / PRIMING["half_life_ms"])
    return spark.read.parquet(f"{path}/v").select(F.when(boost >= PRIMING["least"], boost).otherwise(0.0).alias("boost"))


def base_level_stream(accesses: DataFrame, path: str, now: int) -> None:
    """Keep memory_id, n, b at the fixed time ``now``: counts and decayed sums grow by what comes, the log isn't read again.

    At a fixed time the sum of decayed accesses is additive, so the state is Spark's own sum for each memory.
    """
    sums = accesses.filter(F.col("accessed_at") <= now).groupBy("memory_id").agg(F.count("*").alias("n"), F.sum(F.pow(F.greatest((F.lit(now) - F.col("accessed_at")) / 1000.0, F.lit(1.0)), F.lit(-0.5))).alias("sum"))
    schema = "memory_id string, n bigint, b double"

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = batch.select("memory_id", "n", F.ln("sum").alias("b"))
        kept = _latest(spark, path, schema).join(changed, "memory_id", "left_anti")
        kept.unionByName(changed).write.mode("overwrite").parquet(f"{path}/v{number}")
        manifest = Manifest(spark, path)
        manifest.commit(manifest.read()[0] + 1, {"state": f"v{number}"})

    run(sums, "update", sink)


def latest_base_level(spark: SparkSession, path: str) -> DataFrame:
    return _latest(spark, path, "memory_id string, n bigint, b double")


def hourly_stream(events: DataFrame, path: str, late: str = "10 minutes") -> None:
    """Append hour, kind, n of each hour that is over: what comes later than ``late`` behind the newest event is dropped.

    ``events`` has ts (timestamp) and kind.
    """
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "kind", "n")
    run(counts, "append", lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
