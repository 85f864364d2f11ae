"""Locations from file accesses: familiarity, co-access, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.location import association_strength, familiarity, multiplier
from mnemora.operators.cells import numbered

#: Earlier accesses of a task, and of all projects together, that a new access is held against.
TASK_REACH, TIME_REACH = 100, 500
_CELL_BITS = 25


def locations(accesses: DataFrame) -> DataFrame:
    """project, path, accesses, saved, last, description, familiarity of each location.

    ``accesses`` has project, path, direct (boolean), context and at.  Nulls in project count as ``''``; rows without
    a path are left out; the first context (by time) describes a location.
    """
    a = accesses.filter("path is not null").withColumn("project", F.coalesce("project", F.lit("")))
    out = a.groupBy("project", "path").agg(F.count("*").alias("accesses"), F.count_if("direct").alias("saved"), F.max("at").alias("last"), F.min_by("context", F.struct("at", "context")).alias("description"))
    return out.withColumn("familiarity", familiarity(F.col("accesses")))


def _within(a: DataFrame, on: list[str], reach: int) -> DataFrame:
    """Pairs of rows of the same ``on`` whose places (``row``) are at most ``reach`` apart, earlier one first.

    Rows meet in blocks of ``reach`` places, each earlier row in its own block and the next, so a block has a bounded
    number of rows however hot its key is.
    """
    block = F.floor(F.col("row") / reach)
    early = a.select(*on, *[F.col(c).alias(f"e_{c}") for c in a.columns if c not in on], F.explode(F.array(block, block + 1)).alias("block"))
    later = a.select(*on, *[F.col(c).alias(f"l_{c}") for c in a.columns if c not in on], block.alias("block"))
    return early.join(later, [*on, "block"]).filter((F.col("e_row") < F.col("l_row")) & (F.col("l_row") - F.col("e_row") <= reach))


def co_access_by_task(accesses: DataFrame, reach: int = TASK_REACH) -> DataFrame:
    """project, a, b, at, place, other, first, more: each co-access (a < b) of two locations by one task.

    ``accesses`` has project, task, path, activity, at and id.  An access meets the ``reach`` accesses of its task
    before it; ``first`` is the strength's weight if this is the pair's first co-access, ``more`` else.  Rows without
    a task or path are left out; ties in time go by id.
    """
    a = accesses.select("project", "task", "path", "activity", "at", "id").filter("task is not null and path is not null and at is not null")
    a = numbered(a, ["project", "task"], ["at", "id"], F.shiftright("at", _CELL_BITS)).drop("run")
    pairs = _within(a, ["project", "task"], reach).filter("e_path <> l_path")
    m = multiplier(F.lit(True), F.coalesce(F.col("e_activity") == F.col("l_activity"), F.lit(False)))
    return _co_accesses(pairs, m, m)


def co_access_by_time(accesses: DataFrame, within_ms: int = 3_600_000, reach: int = TIME_REACH) -> DataFrame:
    """The same of locations of one project accessed less than ``within_ms`` apart, but not by one task.

    ``accesses`` may have activity, task and session besides.  An access meets the ``reach`` accesses of all projects
    before it.  A shared session makes later co-accesses count one and a half times, the first one not.
    """
    a = accesses.select("project", "path", "at", "id", *[F.col(c) if c in accesses.columns else F.lit(None).cast("string").alias(c) for c in ("activity", "task", "session")]).filter("path is not null and at is not null")
    a = numbered(a.withColumn("all", F.lit(0)), ["all"], ["at", "id"], F.shiftright("at", _CELL_BITS)).drop("run", "all")
    pairs = _within(a, ["project"], reach).filter((F.col("e_path") != F.col("l_path")) & (F.col("l_at") - F.col("e_at") < within_ms) & ~F.coalesce(F.col("e_task") == F.col("l_task"), F.lit(False)))
    first = multiplier(F.lit(False), F.coalesce(F.col("e_activity") == F.col("l_activity"), F.lit(False)))
    return _co_accesses(pairs, first, first * F.when(F.col("e_session") == F.col("l_session"), 1.5).otherwise(1.0))


def _co_accesses(pairs: DataFrame, first, more) -> DataFrame:
    return pairs.select("project", F.least("e_path", "l_path").alias("a"), F.greatest("e_path", "l_path").alias("b"), F.col("l_at").alias("at"), F.col("l_id").alias("place"), F.col("e_row").alias("other"), first.alias("first"), more.alias("more"))


def co_access_strength(co_accesses: DataFrame) -> DataFrame:
    """project, a, b, n, count, strength of each pair of locations.

    A pair's first co-access stores a count of 1 whatever its weight, and a strength by that weight; each later one
    adds its weight to the count and sets the strength by the count.  So the strength may fall at the second.
    """
    order = F.struct("at", "place", "other")
    g = co_accesses.groupBy("project", "a", "b").agg(F.count("*").alias("n"), F.sum("more").alias("sum"), F.min_by("first", order).alias("first"), F.min_by("more", order).alias("dropped"))
    count = F.lit(1.0) + F.col("sum") - F.col("dropped")
    return g.select("project", "a", "b", "n", count.alias("count"), F.when(F.col("n") == 1, association_strength(F.col("first"))).otherwise(association_strength(count)).alias("strength"))


def newest_contexts(accesses: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` accesses of each location; ties go to the smaller id."""
    k = F.row_number().over(Window.partitionBy("project", "path").orderBy(F.desc("at"), "id"))
    return accesses.withColumn("k", k).filter(F.col("k") <= limit)
