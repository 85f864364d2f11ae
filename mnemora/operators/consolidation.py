"""Maintenance of memories: strength, state, associations, primed importance, working memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import DAY_MS, HOUR_MS, PRIMING, WORKING_MEMORY
from mnemora.functions import activation as act


def strengthened(strength: Column, idle_ms: Column) -> Column:
    """A tenth more if used within 30 minutes (1 at most), two in a hundred less if idle for a week (0.1 at least)."""
    return F.when(idle_ms <= HOUR_MS / 2, F.least(strength * 1.1, F.lit(1.0))).when((idle_ms > 7 * DAY_MS) & (strength > 0.1), F.greatest(strength * 0.98, F.lit(0.1))).otherwise(strength)


def next_state(state: Column, age_ms: Column, since_ms: Column) -> Column:
    """Fresh for an hour, consolidating for a day, then consolidated; reconsolidating for a day since it was changed."""
    return F.when(state.isin("fresh", "consolidating") & (age_ms > DAY_MS), "consolidated").when((state == "fresh") & (age_ms > HOUR_MS), "consolidating").when((state == "reconsolidating") & (since_ms > DAY_MS), "consolidated").otherwise(state)


def decay_associations(associations: DataFrame, now: int, state: str = "fresh", least: float = 0.1, change: float = 0.001) -> DataFrame:
    """The associations after one step of decay: those under ``least`` go, and tiny changes aren't made.

    ``associations`` has strength and last_reinforced; one that was never reinforced, or later than ``now``, stays.
    """
    age = F.lit(now) - F.col("last_reinforced")
    left = F.when(F.col("last_reinforced").isNull() | (age < 0), F.col("strength")).otherwise(act.association_decay(F.col("strength"), age, F.lit(state)))
    left = F.when(F.abs(left - F.col("strength")) > change, left).otherwise(F.col("strength"))
    return associations.withColumn("strength", left).filter(F.col("strength") >= least)


def primed(memories: DataFrame) -> DataFrame:
    """id, boost: what earlier important memories, of whatever project, add to a memory's encoding.

    ``memories`` has id, at and importance.  A memory of importance 0.7 or more gives a boost of 1.67 times what is over
    that, 0.5 at most, which halves every 90 minutes and replaces an earlier one unless that is still greater; under
    0.01 there is none.  So the boost is the greatest of all decayed ones, and as each is under 0.01 after less than
    nine hours, it comes from the memory's own cell of twelve hours or the one before: no window holds more than a cell.
    Memories of one instant go by id; a null importance gives none.
    """
    cell, half_life = PRIMING["cell_ms"], PRIMING["half_life_ms"]
    m = memories.select("id", "at", "importance").filter("id is not null and at is not null").withColumn("cell", F.floor(F.col("at") / cell))
    given = F.least((F.col("importance") - PRIMING["threshold"]) * PRIMING["slope"], F.lit(PRIMING["most"]))
    # the decayed boosts of one cell compare as log2(boost) + time in half-lives
    place = F.when((F.col("importance") >= PRIMING["threshold"]) & (given > 0), F.log2(given) + (F.col("at") - F.col("cell") * cell) / half_life)
    m = m.withColumn("place", place)
    inside = Window.partitionBy("cell").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = m.groupBy((F.col("cell") + 1).alias("cell")).agg((F.max("place") - cell / half_life).alias("earlier"))
    m = m.withColumn("own", F.max("place").over(inside)).join(before, "cell", "left")
    boost = F.pow(F.lit(2.0), F.greatest("own", "earlier") - (F.col("at") - F.col("cell") * cell) / half_life)
    return m.select("id", F.when(boost >= PRIMING["least"], boost).otherwise(0.0).alias("boost"))


def working_memory(accesses: DataFrame, by: list[str]) -> DataFrame:
    """``by``, id, at, k: the seven memories used last within 20 seconds before the last use, for each of ``by``.

    ``accesses`` has ``by``, id and at.  Ties go to the smaller id.  Nothing but the last 20 seconds is put in order.
    """
    a = accesses.filter("id is not null and at is not null")
    last = a.groupBy(*by).agg(F.max("at").alias("last"))
    live = a.join(last, by).filter(F.col("last") - F.col("at") <= WORKING_MEMORY["expiry_ms"]).groupBy(*by, "id").agg(F.max("at").alias("at"))
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("at"), "id"))
    return live.withColumn("k", k).filter(F.col("k") <= WORKING_MEMORY["capacity"])
