"""Merging of ordered pieces by a tree of bounded windows.

A *piece* is a stretch of consecutive rows of one key: frames of a video, events of a project.  Two neighbouring
pieces join if a rule holds between the last row of the one and the first row of the other.  Folding all pieces of a
key in one window would put a hot key into one task; here the pieces are folded in cells of a fixed width along the
order axis first, and only the pieces that touch an edge of their cell go on to the next, wider level.  The fold is
associative, so the result doesn't depend on the widths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.sources.shared import materialize


def merge_runs(
    pieces: DataFrame,
    key: Sequence[str],
    order: str,
    shifts: Sequence[int | None],
    linked: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    head: Sequence[str],
    tail: Sequence[str],
    total: Sequence[str] = (),
    low: Sequence[str] = (),
    high: Sequence[str] = (),
    keep: Column | None = None,
) -> DataFrame:
    """Fold ``pieces`` of each ``key`` along the bigint column ``order`` until no two neighbours are linked.

    ``linked(prev, greatest)`` is the rule as a condition; ``prev("c")`` is column ``c`` of the piece before,
    ``greatest("c")`` the greatest so far in the cell, a plain column is this piece's.  ``head`` columns are taken from a run's first piece (``order`` is one of them implicitly), ``tail``
    columns from its last, ``total`` columns are summed, of ``low`` and ``high`` columns the
    least and the greatest count.  ``shifts`` are the levels: a cell is ``order >> shift``; the
    last is None, one cell for all.  ``keep`` is the condition on finished runs that are wanted.  Each level but the
    last is written to the shared folder: its finished runs and its edges are read from there, so nothing before it
    runs twice.

    Nulls: rows with a null in ``key`` or ``order`` belong to no sequence and must be dropped before.  A rule that
    gives null doesn't link.  An empty input gives an empty result.  Ties in ``order`` within a key must be resolved
    by the caller (one piece for each place).
    """
    columns = [*key, order, *head, *tail, *total, *low, *high]
    current = pieces.select(*columns, F.lit(True).alias("_open"))
    finished: list[DataFrame] = []
    for level, shift in enumerate(shifts):
        last = level == len(shifts) - 1
        cell = F.lit(0).cast("bigint") if shift is None else F.shiftright(F.col(order), shift)
        current = current.withColumn("_cell", cell)
        by = [*key] if shift is None else [*key, "_cell"]
        if shift is not None:  # the whole key set of the windows and groups below, so that one exchange serves them
            current = current.repartition(*by)
        window = Window.partitionBy(*by).orderBy(order)
        current = current.withColumn("_first", F.lag(order).over(window).isNull())
        # a run that began inside an earlier cell is settled: what stands before it now isn't what stood before it
        joins = F.col("_open") & linked(lambda c: F.lag(c).over(window), lambda c: F.max(c).over(window.rowsBetween(Window.unboundedPreceding, -1)))
        current = current.withColumn("_start", F.when(F.col("_first"), 1).otherwise(F.when(joins, 0).otherwise(1)))
        current = current.withColumn("_last", F.lead(order).over(window).isNull())
        current = current.withColumn("_run", F.sum("_start").over(window.rowsBetween(Window.unboundedPreceding, 0)))
        first = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in head])).alias("_h")
        final = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in tail])).alias("_t")
        runs = current.groupBy(*by, "_run").agg(
            first, final, *[F.sum(c).alias(c) for c in total], *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high], F.max("_first").alias("_first"), F.max(F.col("_first") & F.col("_open")).alias("_open"), F.max("_last").alias("_last")
        )
        runs = runs.select(
            *key,
            F.col("_h._o").alias(order),
            *[F.col(f"_h.{c}").alias(c) for c in head],
            *[F.col(f"_t.{c}").alias(c) for c in tail],
            *total,
            *low,
            *high,
            "_first",
            "_open",
            "_last",
        )
        wanted = F.lit(True) if keep is None else keep
        if last:
            finished.append(runs.filter(wanted).select(*columns))
        else:
            edge = F.col("_first") | F.col("_last")
            runs = runs.select(*columns, "_open", edge.alias("_edge")).filter(wanted | F.col("_edge"))
            runs = materialize(runs, "runs")
            finished.append(runs.filter(~F.col("_edge") & wanted).select(*columns))
            current = runs.filter("_edge").select(*columns, "_open")
    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    return result
