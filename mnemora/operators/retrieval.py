"""Ranked retrieval: similarity, recency, emotion, and activation spread, for one probe or for many at once."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import CORE, SERVER, RetrievalConfig
from mnemora.functions import activation as act
from mnemora.functions import visual as vis
from mnemora.functions.vector import cosine
from mnemora.operators.episodes import spread_temporal
from mnemora.operators.graph import spread
from mnemora.operators.similarity import activation_score, top_matches
from mnemora.sources.shared import materialize


def retrieve(memories: DataFrame, edges: DataFrame | None = None, config: RetrievalConfig = CORE) -> DataFrame:
    """id, total, probability, spread of the best memories for one probe.

    ``memories`` has id, s (similarity to the probe, after any working-memory boost), b (base level, -10 without
    history) and emotion.  Seeds are the best few by their own activation; edges whose ends aren't both memories are
    left out.  Ties go to the smaller id.  Null similarities count as 0; an empty table gives no rows.
    """
    own = memories.select("id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("b", F.lit(act.NO_HISTORY)).alias("b"), F.coalesce("emotion", F.lit(0.5)).alias("emotion"))
    own = own.withColumn("p", act.cubed(F.least("s", F.lit(1.0))))
    own = own.withColumn("own", act.combined(F.col("b"), F.col("p"), F.lit(0.0), F.col("emotion")))
    if edges is None or config.depth == 0:
        scored = own.withColumn("spread", F.lit(0.0))
    else:
        own = materialize(own, "scored")
        seeds = own.filter(F.col("p") > config.seed_floor).orderBy(F.desc("own"), "id").limit(config.seeds).select("id", F.col("own").alias("a"))
        ids = own.select("id")
        inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        more = spread(seeds, inside.select("src", "dst", "w", "bw"), config.depth, config.spread_decay, config.least_activation)
        scored = own.join(more, "id", "left").withColumn("spread", F.coalesce("a", F.lit(0.0)))
    scored = scored.withColumn("total", F.col("own") + F.col("spread"))
    scored = scored.withColumn("probability", act.probability(F.col("total"), config.threshold, config.noise))
    kept = scored.filter(F.col("probability") >= config.min_probability)
    return kept.orderBy(F.desc("total"), "id").limit(config.limit).select("id", "total", "probability", "spread")


def _seed_score(cosines: np.ndarray, base: np.ndarray, emotion: np.ndarray, floor: float = 0.1) -> np.ndarray:
    own = activation_score(cosines, base, emotion)
    return np.where(np.minimum(cosines, 1.0) ** 3 > floor, own, -np.inf)


def _best_of_each(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each probe."""
    k = F.row_number().over(Window.partitionBy("probe").orderBy(*order))
    return df.withColumn("rank", k).filter(F.col("rank") <= limit)


def retrieve_batch(probes: DataFrame, memories: DataFrame, edges: DataFrame | None = None, config: RetrievalConfig = CORE) -> DataFrame:
    """probe, id, total, probability, spread, rank: the best memories of every probe.

    ``probes`` has id and v, ``memories`` id, v, b (base level) and emotion, ``edges`` src, dst, w and bw.  The ranking
    is that of :func:`retrieve`, with each probe's own seeds.  As a spread is never negative, a probe's best are among
    those that are best without it and those that it reaches, so all other pairs end in the tasks that make them.  Null
    base levels count as -10, null emotions as 0.5; vectors that can't be compared match nothing; an empty table gives
    no rows; ties go to the smaller id.
    """
    m = memories.select("id", "v", F.coalesce("b", F.lit(act.NO_HISTORY)).alias("b"), F.coalesce("emotion", F.lit(0.5)).alias("emotion"))
    top = top_matches(probes, m, config.limit, score=activation_score, extra=("b", "emotion")).select(F.col("query").alias("probe"), "id", F.col("s").alias("own"), F.lit(0.0).alias("a"))
    if edges is not None and config.depth:
        seeds = top_matches(probes, m, config.seeds, score=lambda s, b, e: _seed_score(s, b, e, config.seed_floor), extra=("b", "emotion")).filter(F.col("s") > float("-inf"))
        ids = m.select("id")
        inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "w", "bw")
        reached = spread(seeds.select(F.col("query").alias("probe"), "id", F.col("s").alias("a")), inside, config.depth, config.spread_decay, config.least_activation, by=["probe"])
        p = probes.select(F.col("id").alias("probe"), F.col("v").alias("pv"))
        pairs = reached.join(m, "id").join(p, "probe")
        own = act.combined(F.col("b"), act.cubed(F.least(cosine(F.col("v"), F.col("pv")), F.lit(1.0))), F.lit(0.0), F.col("emotion"))
        top = top.unionByName(pairs.select("probe", "id", own.alias("own"), "a"))
    both = top.groupBy("probe", "id").agg(F.max("own").alias("own"), F.max("a").alias("spread")).withColumn("total", F.col("own") + F.col("spread"))
    both = both.withColumn("probability", act.probability(F.col("total"), config.threshold, config.noise)).filter(F.col("probability") >= config.min_probability)
    return _best_of_each(both, [F.desc(F.round("total", 12)), "id"], config.limit).select("probe", "id", "total", "probability", "spread", "rank")


def retrieve_server(probes: DataFrame, memories: DataFrame, edges: DataFrame, pairs: DataFrame, session: DataFrame, limit: int = 10, config: RetrievalConfig = SERVER) -> DataFrame:
    """probe, id, score, probability, rank: the ranking of :func:`retrieve_batch` as a server refines it.

    Twice as many rows are fetched; their probability is taken anew with the noise of each memory's ``strength``
    (encoding strength); the five best give activation along the episodes' links (``pairs`` of memories: src, dst,
    forward, backward), which is added to the score; memories of ``session`` (id) score half as much again.
    """
    fetched = retrieve_batch(probes, memories, edges, replace(config, limit=2 * limit))
    fetched = materialize(fetched.join(memories.select("id", "strength"), "id"), "fetched")
    seeds = fetched.filter(F.col("rank") <= 5).select("probe", "id", F.col("total").alias("a"))
    boost = spread_temporal(seeds, pairs, by=["probe"]).withColumnRenamed("a", "boost")
    p = act.probability(F.col("total"), config.threshold, act.instance_noise(F.coalesce("strength", F.lit(0.5))))
    out = fetched.join(boost, ["probe", "id"], "left").join(session.select("id", F.lit(True).alias("here")).distinct(), "id", "left")
    score = (F.col("total") + F.coalesce("boost", F.lit(0.0))) * F.when(F.col("here"), 1.5).otherwise(1.0)
    out = out.select("probe", "id", score.alias("score"), p.alias("probability"))
    return _best_of_each(out, [F.desc(F.round("score", 12)), "id"], limit)


def _visual_score(cosines: np.ndarray, base: np.ndarray, weight: np.ndarray, significance: np.ndarray) -> np.ndarray:
    return activation_score(cosines, base, weight) + 0.2 * significance + np.where(weight > 0.7, (weight - 0.7) * 0.3, 0.0)


def _visual_seed(cosines: np.ndarray, base: np.ndarray, weight: np.ndarray) -> np.ndarray:
    own = (base + np.minimum(cosines, 1.0) ** 3) * (1.0 + weight - 0.5)
    return np.where(own > 0, own, -np.inf)


def retrieve_visual(probes: DataFrame, visuals: DataFrame, edges: DataFrame | None = None, config: RetrievalConfig = CORE) -> DataFrame:
    """probe, id, total, probability, similarity, rank: the best visual memories of every probe.

    ``visuals`` has id, v, b (base level of its own accesses), weight (0.5 + arousal) and significance.  A total is that
    of memories, and a fifth of the significance, and for weights over 0.7 three tenths of what is over it.  The five
    seeds of the spread go by the additive activation ``(b + cosine ** 3) * (weight + 0.5)``, if it is over 0.  Nulls
    count as b -10, weight 1 and significance 0.5.
    """
    m = visuals.select("id", "v", F.coalesce("b", F.lit(act.NO_HISTORY)).alias("b"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("significance", F.lit(0.5)).alias("significance"))
    best = top_matches(probes, m, config.limit, score=_visual_score, extra=("b", "weight", "significance")).select(F.col("query").alias("probe"), "id")
    reached = None
    if edges is not None and config.depth:
        seeds = top_matches(probes, m, config.seeds, score=_visual_seed, extra=("b", "weight")).filter(F.col("s") > float("-inf"))
        reached = spread(seeds.select(F.col("query").alias("probe"), "id", F.col("s").alias("a")), edges, config.depth, config.spread_decay, config.least_activation, by=["probe"])
        best = best.unionByName(reached.select("probe", "id")).distinct()
    pairs = best.join(m, "id").join(probes.select(F.col("id").alias("probe"), F.col("v").alias("pv")), "probe").withColumn("similarity", cosine(F.col("v"), F.col("pv")))
    pairs = pairs.withColumn("spread", F.lit(0.0)) if reached is None else pairs.join(reached.withColumnRenamed("a", "spread"), ["probe", "id"], "left")
    total = act.combined(F.col("b"), act.cubed(F.least("similarity", F.lit(1.0))), F.coalesce("spread", F.lit(0.0)), F.col("weight")) + vis.boost(F.col("significance"), F.col("weight"))
    out = pairs.withColumn("total", total)
    out = out.withColumn("probability", act.probability(F.col("total"), config.threshold, config.noise)).filter(F.col("probability") >= config.min_probability)
    return _best_of_each(out, [F.desc(F.round("total", 12)), "id"], config.limit).select("probe", "id", "total", "probability", "similarity", "rank")


def context_with_visuals(texts: DataFrame, visuals: DataFrame, budget: int = 300, visual_ratio: float = 0.3, least: float = 0.3) -> DataFrame:
    """probe, what, id, tokens, running: of each probe the notes and pictures that fit in its budget, best first.

    Both tables are rankings: probe, id, similarity, rank and tokens.  The visual share of the budget is rounded down
    and the rest is for text; rows less similar than ``least`` are passed over, and either list ends at the first row
    that doesn't fit.
    """
    of_visuals = int(budget * visual_ratio)
    out = None
    for what, df, share in (("text", texts, budget - of_visuals), ("visual", visuals, of_visuals)):
        running = F.sum("tokens").over(Window.partitionBy("probe").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        kept = df.filter(F.col("similarity") >= least).withColumn("running", running).filter(F.col("running") <= share)
        part = kept.select("probe", F.lit(what).alias("what"), F.col("id").cast("string").alias("id"), "tokens", "running")
        out = part if out is None else out.unionByName(part)
    return out


def within_budget(ranked: DataFrame, budget: int, order: list) -> DataFrame:
    """The longest beginning of a ranked report of which the ``tokens`` fit in the budget.

    For the few rows of a report only: the running sum is one window over all of them.
    """
    running = F.sum("tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", running).filter(F.col("running") <= budget)
