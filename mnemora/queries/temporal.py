"""Queries of episodes, over the events of users and over the memories of projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.operators.episodes import episodes, links, merge_links, narrative, spread_temporal, temporal_neighbours
from mnemora.operators.sessions import clean_key
from mnemora.operators.similarity import top_matches
from mnemora.queries.base import f_embeddings, millis, own, own_sql, read_table, sql_cosine

c = F.col
r6 = lambda x: F.round(x, 6)


def _events(spark, d):
    return read_table(spark, d, "events").select(c("user_id").alias("key"), c("event_id").alias("id"), millis("ts").alias("at"))


def _notes(spark, d):
    """The memories of each project in order: an episode's events."""
    return own(spark, d, "memories").select(clean_key(c("project_id")).alias("key"), "id", c("created_at").alias("at"))


def episode_sizes(spark, d):
    return episodes(_events(spark, d)).groupBy("key", "run", "part").agg(F.count("*").alias("n"), F.min("at").alias("started"), F.max("at").alias("ended"))


def episode_events(spark, d):
    """Place of every memory in its project's episodes."""
    return episodes(_notes(spark, d)).select(c("key").alias("project"), "run", "part", "position", "id")


def episode_links(spark, d):
    return links(episodes(_notes(spark, d))).select("src", "dst", "distance", r6(c("forward")).alias("forward"), r6(c("backward")).alias("backward"))


def episodes_for_memory(spark, d):
    """The episodes (user, run, part) in which a memory was accessed, for every memory."""
    n = f_embeddings(spark, d).agg(F.count("*").alias("n"))
    return episodes(_events(spark, d)).crossJoin(F.broadcast(n)).select((c("id") % c("n")).alias("memory"), c("key").alias("user_id"), "run", "part").distinct()  # one row on the right


def merge_temporal_links(spark, d):
    """Directed rows as they are stored, one for each direction, merged into one row for each pair."""
    e = episodes(_notes(spark, d))
    pairs = links(e)
    at = e.select("id", "position")
    rows = pairs.select("src", "dst", c("forward").alias("strength")).unionByName(pairs.select(c("dst").alias("src"), c("src").alias("dst"), c("backward").alias("strength")))
    rows = rows.join(at.select(c("id").alias("src"), c("position").alias("src_position")), "src").join(at.select(c("id").alias("dst"), c("position").alias("dst_position")), "dst")
    return merge_links(rows).select("a", "b", r6(c("forward")).alias("forward"), r6(c("backward")).alias("backward"))


def _seeds(spark, d):
    return own(spark, d, "memories").filter("emotional_weight >= 0.9").select("id", c("emotional_weight").alias("a"))


def temporal_spread(spark, d):
    """Activation that strongly felt memories give to what came before and after them in their episode."""
    return spread_temporal(_seeds(spark, d), links(episodes(_notes(spark, d)))).select("id", r6(c("a")).alias("a"))


def temporal_spread_multi(spark, d):
    """The same over the accesses of users: a memory is in many episodes, and its best offer counts."""
    n = f_embeddings(spark, d).agg(F.count("*").alias("n"))
    p = links(episodes(_events(spark, d), gap_ms=7_200_000)).crossJoin(F.broadcast(n)).select((c("src") % c("n")).alias("src"), (c("dst") % c("n")).alias("dst"), "forward", "backward").filter("src <> dst")  # one row on the right
    seeds = f_embeddings(spark, d).filter("id % 20 = 0").select("id", F.lit(1.0).alias("a"))
    return spread_temporal(seeds, p).select("id", r6(c("a")).alias("a"))


def _neighbours(direction):
    def run(spark, d):
        return temporal_neighbours(_notes(spark, d).select("id"), links(episodes(_notes(spark, d))), direction, 3).select("anchor", "id", "distance", r6(c("strength")).alias("strength"), "k")

    return run


def narrated(spark, d):
    """What came before the best anchor for a probe: the ten memories whose vectors are most similar to one memory's."""
    v = read_table(spark, d, "memory_embeddings").filter("dimensions = 64 and size(vector) = 64").groupBy("memory_id").agg(F.max("vector").alias("v")).select(c("memory_id").alias("id"), "v")
    probe = v.join(own(spark, d, "memories").filter("type = 'bug'").select("id"), "id", "left_semi").orderBy("id").limit(1)
    anchors = top_matches(probe, v, 10).select("id", c("rank").alias("place"))
    notes = _notes(spark, d)
    members = notes.select(c("id").alias("event"), c("id").alias("memory"))
    return narrative(anchors, members, links(episodes(notes))).select("id", r6(c("score")).alias("score"))


QUERIES = {f.__name__: f for f in (episode_sizes, episode_events, episode_links, episodes_for_memory, merge_temporal_links, temporal_spread, temporal_spread_multi)}
QUERIES |= {"temporal_neighbors": _neighbours("after"), "temporal_neighbors_before": _neighbours("before"), "temporal_neighbors_both": _neighbours("both"), "narrative": narrated}


def episode_sql(events: str, gap: int = 300_000) -> str:
    """``ep`` (k, run, part, pos, id, t) and ``li`` (src, dst, distance, f, bk) over a select of k, id and t."""
    return f"""ev as ({events}), e1 as (select *, case when t - lag(t) over (partition by k order by t, id) <= {gap} then 0 else 1 end s from ev where k is not null and t is not null),
e2 as (select *, sum(s) over (partition by k order by t, id) run from e1), e3 as (select *, row_number() over (partition by k, run order by t, id) - 1 n from e2),
ep as (select k, run, n // 50 part, n % 50 pos, id, t from e3),
li as (select a.id src, b.id dst, b.pos - a.pos distance, exp(-0.3 * (b.pos - a.pos)) f, 0.7 * exp(-0.3 * (b.pos - a.pos)) bk from ep a join ep b on a.k = b.k and a.run = b.run and a.part = b.part and b.pos > a.pos and b.pos <= a.pos + 10)"""


_EV = episode_sql("select user_id k, event_id id, epoch_us(ts) // 1000 t from events")
_NO = episode_sql(r"select nullif(lower(regexp_replace(project_id, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g')), '') k, id, created_at t from " + own_sql("memories", "project_id, created_at"))
_N = "(select count(*) from embeddings)"
_SD = f"sd as (select id, emotional_weight a from {own_sql('memories', 'emotional_weight')} where emotional_weight >= 0.9)"
_GOT = "select id, round(max(a), 6) a from (select dst id, 1.2 * f * a a from {l} join sd on sd.id = src union all select src, 1.2 * bk * a from {l} join sd on sd.id = dst union all select sd.id, a from sd where id in (select src from {l}) or id in (select dst from {l})) group by 1"
_AFTER, _BEFORE = "select src anchor, dst id, distance, f strength from li", "select dst anchor, src id, distance, bk strength from li"
_NEAR = "select anchor, id, distance, round(strength, 6) strength, k from (select *, row_number() over (partition by anchor order by distance, strength desc, id) k from ({x})) where k <= 3"
ORACLES = {
    "episode_sizes": f"with {_EV} select k \"key\", run, part, count(*) n, min(t) started, max(t) ended from ep group by 1, 2, 3",
    "episode_events": f"with {_NO} select k project, run, part, pos \"position\", id from ep",
    "episode_links": f"with {_NO} select src, dst, distance, round(f, 6) forward, round(bk, 6) backward from li",
    "episodes_for_memory": f"with {_EV} select distinct id % {_N} memory, k user_id, run, part from ep",
    "merge_temporal_links": f"with {_NO} select src a, dst b, round(f, 6) forward, round(bk, 6) backward from li",
    "temporal_spread": f"with {_NO}, {_SD} " + _GOT.format(l="li"),
    "temporal_spread_multi": f"with {episode_sql('select user_id k, event_id id, epoch_us(ts) // 1000 t from events', 7_200_000)}, lm as (select src % {_N} src, dst % {_N} dst, f, bk from li where src % {_N} <> dst % {_N}), sd as (select vec_id id, 1.0::double a from embeddings where vec_id % 20 = 0) " + _GOT.format(l="lm"),
    "temporal_neighbors": f"with {_NO} " + _NEAR.format(x=_AFTER),
    "temporal_neighbors_before": f"with {_NO} " + _NEAR.format(x=_BEFORE),
    "temporal_neighbors_both": f"with {_NO} " + _NEAR.format(x=f"{_AFTER} union all {_BEFORE}"),
    "narrative": f"with {_NO}, v as (select memory_id id, max(vector) v from memory_embeddings where dimensions = 64 and len(vector) = 64 group by 1), g as (select * from v where isfinite(list_sum(list_transform(v, lambda x: x::double * x::double))) and list_sum(list_transform(v, lambda x: x::double * x::double)) > 0), p as (select v pv from v where id in (select id from {own_sql('memories', 'type')} where type = 'bug') order by id limit 1), an as (select id, row_number() over (order by round({sql_cosine('v', 'pv')}, 12) desc, id) place from g, p qualify place <= 10), nb as (select place, dst, src, bk, row_number() over (partition by dst order by distance, bk desc, src) k from li join an on an.id = dst qualify k <= 5), bp as (select place, count(*) n from nb group by 1 order by least(count(*), 5) desc, place limit 1) select src id, round(bk, 6) score from nb where place = (select place from bp)",
}
