"""Activation spread, PageRank and paths over an edge table.

Hops are joins and sums over whole tables; a hop's result is written to the shared folder every few hops, so that plans
stay short and a lost executor costs one stretch of hops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.sources.shared import materialize


def spread(seeds: DataFrame, edges: DataFrame, depth: int, decay: float = 0.7, least: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """id, a: activation after ``depth`` hops, of every group of ``by`` columns (a probe, say) apart.

    ``seeds`` has id and a (and ``by``), ``edges`` src, dst, w, bw.  A node sends ``a / fan * w * decay`` forward and
    ``a / fan_in * bw * decay ** 2`` backward, once, in the hop after it was reached, with the activation it had at
    the hop's start, if that is ``least`` or more; contributions to nodes reached before count too.  Nodes without
    edges keep their activation; nulls in an edge's ends join nothing; parallel edges count each.
    """
    fan = edges.groupBy("src").agg(F.count("*").alias("fan"))
    fan_in = edges.groupBy("dst").agg(F.count("*").alias("fan_in"))
    forward = edges.join(fan, "src").select(F.col("src").alias("id"), F.col("dst").alias("to"), (F.col("w") / F.col("fan") * decay).alias("k"))
    backward = edges.join(fan_in, "dst").select(F.col("dst").alias("id"), F.col("src").alias("to"), (F.col("bw") / F.col("fan_in") * decay * decay).alias("k"))
    links = materialize(forward.unionByName(backward), "links") if depth > 1 else forward.unionByName(backward)
    state = seeds.select(*by, "id", F.col("a").cast("double").alias("a"), F.lit(0).alias("hop"))
    for hop in range(depth):
        sent = state.filter((F.col("hop") == hop) & (F.col("a") >= least)).join(links, "id")
        got = sent.groupBy(*by, F.col("to").alias("id")).agg(F.sum(F.col("a") * F.col("k")).alias("more"))
        state = state.join(got, [*by, "id"], "full").select(*by, "id", (F.coalesce("a", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("a"), F.coalesce("hop", F.lit(hop + 1)).alias("hop"))
        if hop % 3 == 1 and hop < depth - 1:
            state = materialize(state, "spread")
    return state.select(*by, "id", "a")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """id, rank: weights don't count, parallel edges do; what dangling nodes hold is spread over all nodes.

    An empty node table gives no rows; edges from or to other nodes are left out.
    """
    ids = nodes.select("id").distinct()
    inside = edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi").select("src", "dst")
    fan = inside.groupBy("src").agg(F.count("*").alias("fan"))
    links = materialize(inside.join(fan, "src").select(F.col("src").alias("id"), "dst", "fan"), "links")
    n = ids.agg(F.count("*").alias("n"))
    state = ids.join(fan.select(F.col("src").alias("id"), "fan"), "id", "left").crossJoin(F.broadcast(n)).select("id", (F.lit(1.0) / F.col("n")).alias("rank"), F.col("fan").isNull().alias("dangling"), "n")  # one row is broadcast
    state = materialize(state, "rank")
    for k in range(iterations):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = state.join(links, "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("fan")).alias("got"))
        rank = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))
        state = state.join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", rank.alias("rank"), "dangling", "n")
        if k % 3 == 2:
            state = materialize(state, "rank")
    return state.select("id", "rank")


def shortest_path(edges: DataFrame, source: int, target: int, most: int = 6) -> DataFrame:
    """hops, path: a path of fewest hops along the edges' direction, of several the one with the smallest ids.

    No row where the target can't be reached in ``most`` hops.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType.simpleString()
    reached = spark.createDataFrame([(source, [source])], f"id {kind}, path array<{kind}>")
    frontier, seen = reached, reached
    for _ in range(most):
        onward = frontier.join(e, frontier.id == e.src).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = onward.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        frontier = materialize(frontier, "frontier")
        seen = seen.unionByName(frontier)
        if not frontier.filter(F.col("id") == target).isEmpty():  # no later hop can give a shorter path
            break
    return seen.filter(F.col("id") == target).select((F.size("path") - 1).alias("hops"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
