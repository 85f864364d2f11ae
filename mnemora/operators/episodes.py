"""Episodes of events, the links between their events, and what spreads along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import EPISODE
from mnemora.operators.cells import numbered

#: A cell of the ordered fold is 2 ** 27 ms wide (37 hours).
CELL_BITS = 27


def episodes(events: DataFrame, gap_ms: int = EPISODE["gap_ms"], most: int = EPISODE["most_events"]) -> DataFrame:
    """key, run, part, position, id, at: events in order, cut where more than ``gap_ms`` passes and after ``most`` events.

    ``events`` has key, id and at (ms).  Rows with a null in key or at are left out; ties in time go by id.  Rows of a
    hot key are numbered in cells of time, not in one window.
    """
    e = events.select("key", "id", "at").filter("key is not null and at is not null")
    e = numbered(e, ["key"], ["at", "id"], F.shiftright("at", CELL_BITS), lambda before, this: this("at") - before("at") > gap_ms)
    began = e.groupBy("key", "run").agg((F.min("row")).alias("first"))
    e = e.join(began, ["key", "run"]).withColumn("n", F.col("row") - F.col("first"))
    return e.select("key", "run", F.floor(F.col("n") / most).alias("part"), (F.col("n") % most).alias("position"), "id", "at")


def links(events: DataFrame, reach: int = EPISODE["reach"]) -> DataFrame:
    """key, run, part, src, dst, distance, forward, backward: pairs of one episode at most ``reach`` events apart.

    An episode has a bounded number of events, so the pairs are linear in the events.
    """
    on = ["key", "run", "part"]
    a = events.select(*on, F.col("id").alias("src"), F.col("position").alias("i"))
    b = events.select(*on, F.col("id").alias("dst"), F.col("position").alias("j"))
    pairs = a.join(b, on).filter((F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + reach))
    distance = F.col("j") - F.col("i")
    fall = F.exp(-EPISODE["rate"] * distance)
    return pairs.select(*on, "src", "dst", distance.alias("distance"), (EPISODE["forward"] * fall).alias("forward"), (EPISODE["backward"] * fall).alias("backward"))


def merge_links(rows: DataFrame) -> DataFrame:
    """a, b, forward, backward: the directed rows of a pair as one, with the greatest strength of either direction.

    ``rows`` has src, dst, src_position, dst_position and strength, one row for each direction as it is stored.  A row
    that runs along the order is a forward one; a missing direction counts as 0, loops are left out.
    """
    r = rows.filter("src_position <> dst_position")
    onward = F.col("src_position") < F.col("dst_position")
    a, b = F.when(onward, F.col("src")).otherwise(F.col("dst")), F.when(onward, F.col("dst")).otherwise(F.col("src"))
    forward, backward = F.max(F.when(onward, F.col("strength"))), F.max(F.when(~onward, F.col("strength")))
    return r.groupBy(a.alias("a"), b.alias("b")).agg(F.coalesce(forward, F.lit(0.0)).alias("forward"), F.coalesce(backward, F.lit(0.0)).alias("backward"))


def spread_temporal(seeds: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """id, a (and ``by``): what seeds give to the events of their episodes; a linked seed keeps its own.

    ``seeds`` has id and a (and ``by``, a probe say), ``pairs`` src, dst, forward and backward.  Over several episodes
    and seeds the greatest activation counts, not the sum.  Seeds without links give and keep nothing here.
    """
    s = seeds.select(*by, F.col("id").alias("seed"), "a")
    both = pairs.select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.col("forward").alias("w")).unionByName(pairs.select(F.col("dst").alias("seed"), F.col("src").alias("id"), F.col("backward").alias("w")))
    met = both.join(s, "seed")
    got = met.select(*by, "id", (F.col("a") * F.col("w") * EPISODE["boost"]).alias("a"))
    return got.unionByName(met.select(*by, F.col("seed").alias("id"), "a")).groupBy(*by, "id").agg(F.max("a").alias("a"))


def temporal_neighbours(anchors: DataFrame, pairs: DataFrame, direction: str = "both", limit: int = 5) -> DataFrame:
    """anchor, id, distance, strength, k: the events nearest to each anchor, before or after it, or both.

    Nearest by distance, then by strength, then by id; k counts from 1.
    """
    after = pairs.select(F.col("src").alias("anchor"), F.col("dst").alias("id"), "distance", F.col("forward").alias("strength"))
    before = pairs.select(F.col("dst").alias("anchor"), F.col("src").alias("id"), "distance", F.col("backward").alias("strength"))
    chosen = {"after": after, "before": before, "both": after.unionByName(before)}[direction]
    met = chosen.join(anchors.select(F.col("id").alias("anchor")).distinct(), "anchor", "left_semi")
    k = F.row_number().over(Window.partitionBy("anchor").orderBy("distance", F.desc("strength"), "id"))  # an event has 2 * reach links an episode
    return met.withColumn("k", k).filter(F.col("k") <= limit)


def narrative(anchors: DataFrame, members: DataFrame, pairs: DataFrame, direction: str = "before", limit: int = 5) -> DataFrame:
    """id, score: what came before or after the anchor that has most such neighbours; of several, the best anchor.

    ``anchors`` has id (of a memory) and place (1 is the best), ``members`` event and memory, ``pairs`` the links of
    events.  A memory counts once, by its nearest event; the anchor itself isn't among the results.
    """
    own = members.join(anchors.withColumnRenamed("id", "memory"), "memory").select("place", F.col("memory").alias("anchor_memory"), F.col("event").alias("id"))
    near = temporal_neighbours(own.select("id"), pairs, direction, limit)
    near = near.join(own.select(F.col("id").alias("anchor"), "place", "anchor_memory"), "anchor").join(members.select(F.col("event").alias("id"), "memory"), "id")
    near = near.filter("memory <> anchor_memory").groupBy("place", "memory").agg(F.max("strength").alias("score"))
    best = near.groupBy("place").agg(F.least(F.count("*"), F.lit(limit)).alias("n")).orderBy(F.desc("n"), "place").limit(1)
    return near.join(best.select("place"), "place").orderBy(F.desc("score"), "memory").limit(limit).select(F.col("memory").alias("id"), "score")


