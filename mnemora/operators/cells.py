"""Ordered work on hot keys: rows in cells of a bounded width, and a small table of cells over them.

A window over a whole key would sort a hot key in one task.  Here the rows of a key are cut along an axis into cells;
windows run inside the cells, and what a cell must know of those before it comes from one row for each cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Side = Callable[[str], Column]


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], cell: Column, starts: Callable[[Side, Side], Column] | None = None, prev: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``run``, ``row`` and ``prev_<c>``: number of the run, place in the key (from 1), values of the row before.

    ``starts(before, this)`` says whether a row starts a new run; the first row of a key always does, and a rule that
    gives null doesn't.  It reads columns in ``order`` and ``prev`` only.  ``cell`` is a bigint that doesn't decrease
    along ``order``; its width must bound the rows of a cell.  ``order`` must have no ties within a key (ties are
    broken arbitrarily, but consistently within one cell).  Rows with a null key form one sequence of their own.
    """
    carried = [*order, *[c for c in prev if c not in order]]
    by = [*key, "_cell"]
    d = df.withColumn("_cell", cell).repartition(*by)
    inside = Window.partitionBy(*by).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_prev", F.lag(F.struct(*carried)).over(inside))
    own: Side = F.col
    rule = F.lit(False) if starts is None else F.coalesce(starts(lambda c: F.col(f"_prev.{c}"), own), F.lit(False))
    d = d.withColumn("_start", F.when(F.col("_prev").isNull(), 0).otherwise(rule.cast("int")))
    d = d.withColumn("_in", F.sum("_start").over(so_far)).withColumn("_row", F.row_number().over(inside))
    ends = d.groupBy(*by).agg(F.min(F.struct(*carried)).alias("_first"), F.max(F.struct(*carried)).alias("_last"), F.sum("_start").alias("_starts"), F.count("*").alias("_rows"))
    cells = Window.partitionBy(*key).orderBy("_cell")
    before = cells.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.lag("_last").over(cells))
    edge = F.lit(False) if starts is None else F.coalesce(starts(lambda c: F.col(f"_before.{c}"), lambda c: F.col(f"_first.{c}")), F.lit(False))
    ends = ends.withColumn("_edge", F.when(F.col("_before").isNull(), 1).otherwise(edge.cast("int")))
    ends = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        "_before",
        (F.coalesce(F.sum(F.col("_starts") + F.col("_edge")).over(before), F.lit(0)) + F.col("_edge")).alias("_runs"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
    )
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & d[k].eqNullSafe(ends[f"_k{i}"])
    out = d.join(ends, same)
    seen = [F.when(F.col("_prev").isNotNull(), F.col(f"_prev.{c}")).otherwise(F.col(f"_before.{c}")).alias(f"prev_{c}") for c in prev]
    return out.select(*[out[c] for c in df.columns], *seen, (F.col("_runs") + F.col("_in")).alias("run"), (F.col("_base") + F.col("_row")).alias("row"))
