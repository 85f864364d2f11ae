"""Queries of locations and visual memories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.functions import activation as act
from mnemora.functions import location as loc
from mnemora.functions import visual as vis
from mnemora.operators.coaccess import co_access_by_task, co_access_by_time, co_access_strength, locations, newest_contexts
from mnemora.queries.base import NOW, own, own_sql, millis, read_table

c = F.col
r6 = lambda x: F.round(x, 6)
DAY = 86_400_000.0


def _accesses(spark, d):
    e = read_table(spark, d, "events")
    return e.select(c("user_id").cast("string").alias("project"), F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("path"), (c("value") > 50).alias("direct"), c("event_type").alias("context"), millis("ts").alias("at"), c("event_id").alias("id"))


def _orders(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", (millis("l_shipdate")).alias("at"), (c("l_linenumber").cast("bigint") * 1_000_000_000 + c("l_partkey")).alias("id"))
    return li.join(o, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("project"), c("l_orderkey").alias("task"), c("l_partkey").alias("path"), c("l_returnflag").alias("activity"), "at", "id")


def location_familiarity(spark, d):
    return locations(_accesses(spark, d)).select("project", "path", "accesses", "saved", "last", "description", r6(c("familiarity")).alias("familiarity"))


def _coarse(spark, d):
    """Accesses of five projects to places of ten files each, so that places become well known."""
    e = read_table(spark, d, "events")
    path = F.concat_ws("/", "event_type", F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string"))
    return e.select((c("user_id") % 5).cast("string").alias("project"), path.alias("path"), (c("value") > 50).alias("direct"), c("event_type").alias("context"), millis("ts").alias("at"), c("event_id").alias("id"))


def location_stats(spark, d):
    """Number of places, of well-known ones (over 0.7), searches saved, mean familiarity and the five best-known paths."""
    x = locations(_coarse(spark, d))
    top = x.orderBy(F.desc("familiarity"), "project", "path").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("familiarity")).alias("f"), "project", "path"))), lambda s: s["path"]), ",").alias("top_paths"))
    a = x.agg(F.count("*").alias("n"), F.count_if(c("familiarity") > 0.7).alias("known"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), r6(F.coalesce(F.avg("familiarity"), F.lit(0.0))).alias("mean"))
    return a.crossJoin(top)  # one row each


def location_find(spark, d):
    """Places whose path or description holds a pattern in any case, the best known first."""
    x = locations(_coarse(spark, d)).filter(c("path").ilike("%CLICK/1%") | c("description").ilike("%sign%"))
    return x.orderBy(F.desc("familiarity"), "project", "path").limit(20).select("project", "path", r6(c("familiarity")).alias("familiarity"))


def location_nested(spark, d):
    """Every place with its newest ten contexts in one row."""
    k = newest_contexts(_coarse(spark, d), 10)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"].cast("string")), ",")
    return k.groupBy("project", "path").agg(ids.alias("ids"))


def recent_locations(spark, d):
    return locations(_accesses(spark, d)).orderBy(F.desc("last"), "project", "path").limit(20).select("project", "path", "last")


def all_locations(spark, d):
    return locations(_accesses(spark, d)).orderBy(F.desc("accesses"), "project", "path").limit(50).select("project", "path", "accesses")


def location_contexts(spark, d):
    """The newest 50 contexts of each place."""
    return newest_contexts(_coarse(spark, d)).select("project", "path", "id", "k")


def prune_contexts(spark, d):
    """What each project loses: the accesses of a place beyond its newest 50."""
    a = _coarse(spark, d)
    return a.join(newest_contexts(a).select("id"), "id", "left_anti").groupBy("project").agg(F.count("*").alias("pruned"))


def location_by_activity(spark, d):
    a = _accesses(spark, d)
    return a.groupBy("project", "path", "context").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def context_summaries(spark, d):
    """One line for each location and activity with more than two old accesses, and the newest of them."""
    a = _accesses(spark, d).filter(c("at") < 1_706_000_000_000)
    g = a.groupBy("project", "path", "context").agg(F.count("*").alias("n"), F.max_by("id", F.struct("at", "id")).alias("kept")).filter("n > 2")
    return g.select("project", "path", F.format_string("%d %s accesses", "n", "context").alias("summary"), "kept")


def location_orphaned(spark, d):
    """Places that were known (0.4 or more), aren't pinned and weren't accessed for 60 days, three months on."""
    x = locations(_coarse(spark, d)).filter((c("familiarity") >= 0.4) & (c("last") < 1_706_745_600_000 + 90 * 86_400_000 - 60 * 86_400_000) & ~c("path").startswith("error"))
    return x.select("project", "path")


def location_merge(spark, d):
    """Clicks become views: counts and searches saved add up, the greater familiarity and the later access count, contexts move."""
    to = F.regexp_replace("path", "^click/", "view/").alias("path")
    x = locations(_coarse(spark, d)).withColumn("path", to)
    merged = x.groupBy("project", "path").agg(F.sum("accesses").alias("accesses"), F.sum("saved").alias("saved"), F.max("last").alias("last"), F.max("familiarity").alias("f"))
    contexts = _coarse(spark, d).withColumn("path", to).filter("path is not null").groupBy("project", "path").agg(F.count("*").alias("contexts"))
    return merged.join(contexts, ["project", "path"]).select("project", "path", "accesses", "saved", "last", r6(c("f")).alias("familiarity"), "contexts")


def location_associated(spark, d):
    """The three strongest companions of each location."""
    x = co_access_strength(co_access_by_task(_orders(spark, d)))
    both = x.select("project", c("a").alias("path"), c("b").alias("other"), "strength").union(x.select("project", c("b").alias("path"), c("a").alias("other"), "strength"))
    k = F.row_number().over(Window.partitionBy("project", "path").orderBy(F.desc(r6(c("strength"))), "other"))
    return both.withColumn("k", k).filter("k <= 3").select("project", "path", "other", r6(c("strength")).alias("strength"))


def strengths(spark, d):
    x = co_access_strength(co_access_by_task(_orders(spark, d)))
    return x.select("project", "a", "b", "n", "count", r6(c("strength")).alias("strength"))


def co_access_time(spark, d):
    """Co-access within an hour, the activity being what was done and the session the user's."""
    a = _coarse(spark, d).join(read_table(spark, d, "events").select(c("event_id").alias("id"), c("user_id").alias("session")), "id").withColumn("activity", c("context"))
    return co_access_strength(co_access_by_time(a)).select("project", "a", "b", "n", "count", r6(c("strength")).alias("strength"))


def _visuals(spark, d):
    v = own(spark, d, "visual_memories")
    last = F.coalesce("last_accessed", "created_at", "received_at")
    return v.select("id", "media_type", "significance", act.clamp(c("emotional_arousal"), 0.0, 1.0).alias("arousal"), act.clamp(c("emotional_valence"), -1.0, 1.0).alias("valence"), ((NOW - last) / DAY).alias("days"), F.coalesce("access_count", F.lit(0)).alias("n"), (c("frame_number") == 0).alias("key"), F.coalesce(c("access_count") > 8, F.lit(False)).alias("pinned"), "frame_number", "source", "description", "shared_by")


def significant_visuals(spark, d):
    return _visuals(spark, d).filter(vis.significant(c("arousal"), c("valence"))).select("id", r6(c("arousal")).alias("arousal"), r6(c("valence")).alias("valence"))


def tag_strength(spark, d):
    s = vis.tag_strength(0.3, c("n"), c("significance"))
    return _visuals(spark, d).filter("significance is not null").select("id", r6(s).alias("strength"), (r6(s) >= 0.6).alias("tag"))


def pruning_candidates(spark, d):
    reason, score = vis.pruning(c("significance"), c("days"), c("pinned"), F.coalesce("frame_number", F.lit(1)))
    return _visuals(spark, d).filter("significance is not null and days is not null").select("id", reason.alias("reason"), r6(score).alias("score")).filter("reason is not null")


def should_prune_visual(spark, d):
    p = vis.should_prune(c("significance"), c("days") + 60, c("pinned"), F.coalesce("key", F.lit(False)))
    return _visuals(spark, d).filter("significance is not null and days is not null").select("id", p.alias("prune"))


def visual_weights(spark, d):
    w = vis.emotional_weight(c("arousal"))
    return _visuals(spark, d).filter("arousal is not null").select("id", r6(w).alias("weight"), r6(F.coalesce("significance", F.lit(0.5)) * 0.2 + F.when(w > 0.7, (w - 0.7) * 0.3).otherwise(0.0)).alias("boost"))


def visual_stats(spark, d):
    return _visuals(spark, d).groupBy("media_type", "source").agg(F.count("*").alias("n"), r6(F.avg("significance")).alias("significance"))


def aggregate_frames(spark, d):
    """Of each video its frames' mean emotion, greatest significance (0 at least) and distinct objects in lower case."""
    v = own(spark, d, "visual_memories").filter("video_id is not null")
    objects = F.explode_outer(F.from_json("objects", "array<string>"))
    n = v.select("video_id", objects.alias("o")).select("video_id", F.lower("o").alias("o")).distinct().groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list("o")), ",").alias("objects"))
    a = v.groupBy("video_id").agg(r6(F.avg("emotional_valence")).alias("valence"), r6(F.avg("emotional_arousal")).alias("arousal"), F.greatest(F.max("significance"), F.lit(0.0)).alias("significance"))
    return a.join(n, "video_id")


QUERIES = {f.__name__: f for f in (location_familiarity, location_stats, recent_locations, all_locations, location_contexts, prune_contexts, location_by_activity, context_summaries, location_orphaned, location_merge, location_associated, co_access_time, location_find, location_nested, significant_visuals, tag_strength, pruning_candidates, should_prune_visual, visual_weights, visual_stats, aggregate_frames)}
QUERIES["co_access_strength"] = strengths

_AC = "with a as (select user_id::varchar project, event_type || '/' || (props->>'$.k') path, value > 50 direct, event_type context, epoch_us(ts) // 1000 t, event_id id from events) "
_LO = _AC + ", l as (select project, path, count(*) n, count(*) filter (where direct) saved, max(t) last, arg_min(context, (t, context)) description, 1 - 1 / (1 + 0.1::double * count(*)) f from a where path is not null group by 1, 2) "
_CA = "with a as (select (user_id % 5)::varchar project, event_type || '/' || ((props->>'$.k')::int // 10) path, value > 50 direct, event_type context, epoch_us(ts) // 1000 t, event_id id, user_id session from events) "
_CO = _CA + ", l as (select project, path, count(*) n, count(*) filter (where direct) saved, max(t) last, arg_min(context, (t, context)) description, 1 - 1 / (1 + 0.1::double * count(*)) f from a where path is not null group by 1, 2) "
#: The store inserts a pair with a count of 1 and the strength of its first weight; later weights are added to the count.
_CLOSED = "w as (select *, row_number() over (partition by project, a, b order by t, id, other) i from p), s as (select project, a, b, count(*) n, (1.0 + coalesce(sum(m) filter (where i > 1), 0))::double count, case when count(*) = 1 then 1 - 1 / (1 + 0.1::double * max(m1)) else 1 - 1 / (1 + 0.1::double * (1.0 + sum(m) filter (where i > 1))) end strength from w group by 1, 2, 3)"
_PAIRS = "with o as (select o_custkey project, l_orderkey task, l_partkey path, l_returnflag act, epoch_us(l_shipdate) // 1000 t, l_linenumber * 1000000000::bigint + l_partkey id from lineitem join orders on l_orderkey = o_orderkey), o2 as (select *, row_number() over (partition by project, task order by t, id) r from o), p as (select x.project, least(x.path, y.path) a, greatest(x.path, y.path) b, y.t, y.id, x.r other, case when x.act = y.act then 5 else 3 end m, case when x.act = y.act then 5 else 3 end m1 from o2 x join o2 y on x.project = y.project and x.task = y.task and x.path <> y.path and x.r < y.r and y.r - x.r <= 100), " + _CLOSED
_VI = f"with v as (select id, media_type, significance, least(greatest(emotional_arousal, 0), 1) arousal, least(greatest(emotional_valence, -1), 1) valence, ({NOW} - coalesce(last_accessed, created_at, received_at)) / 86400000.0::double old, coalesce(access_count, 0) n, coalesce(frame_number = 0, false) k0, coalesce(access_count > 8, false) pinned, frame_number, source, description, shared_by from {own_sql('visual_memories', 'media_type, significance, emotional_arousal, emotional_valence, last_accessed, created_at, received_at, access_count, frame_number, source, description, shared_by')}) "
_W = "(0.5 + arousal)"
ORACLES = {
    "location_nested": _CA + "select project, path, string_agg(id, ',' order by k) ids from (select *, row_number() over (partition by project, path order by t desc, id) k from a) where k <= 10 group by 1, 2",
    "location_find": _CO + "select project, path, round(f, 6) familiarity from l where path ilike '%CLICK/1%' or description ilike '%sign%' order by f desc, project, path limit 20",
    "location_familiarity": _LO + "select project, path, n accesses, saved, last, description, round(f, 6) familiarity from l",
    "location_stats": _CO + "select count(*) n, count(*) filter (where f > 0.7) known, coalesce(sum(saved), 0)::bigint saved, round(coalesce(avg(f), 0), 6) mean, (select string_agg(path, ',' order by f desc, project, path) from (select * from l order by f desc, project, path limit 5)) top_paths from l",
    "recent_locations": _LO + "select project, path, last from l order by last desc, project, path limit 20",
    "all_locations": _LO + "select project, path, n accesses from l order by n desc, project, path limit 50",
    "location_contexts": _CA + "select project, path, id, k from (select *, row_number() over (partition by project, path order by t desc, id) k from a) where k <= 50",
    "prune_contexts": _CA + "select project, count(*) pruned from (select *, row_number() over (partition by project, path order by t desc, id) k from a) where k > 50 group by 1",
    "location_by_activity": _AC + "select project, path, context, count(*) n, max(t) last from a group by 1, 2, 3",
    "context_summaries": _AC + "select project, path, count(*) || ' ' || context || ' accesses' summary, arg_max(id, (t, id)) kept from a where t < 1706000000000 group by project, path, context having count(*) > 2",
    "location_orphaned": _CO + f"select project, path from l where f >= 0.4 and last < {1_706_745_600_000 + 30 * 86_400_000} and path not like 'error%'",
    "location_merge": _CO + "select l.project, regexp_replace(l.path, '^click/', 'view/') path, sum(n)::bigint accesses, sum(saved)::bigint saved, max(last) \"last\", round(max(f), 6) familiarity, sum(n)::bigint contexts from l group by 1, 2",
    "location_associated": _PAIRS + ", b as (select project, a path, b other, round(strength, 6) strength from s union all select project, b, a, round(strength, 6) from s) select project, path, other, strength from (select *, row_number() over (partition by project, path order by strength desc, other) k from b) where k <= 3",
    "co_access_strength": _PAIRS + "select project, a, b, n, count, round(strength, 6) strength from s",
    "co_access_time": _CA + """, r as (select *, row_number() over (order by t, id) p from a), p as (select x.project, least(x.path, y.path) a, greatest(x.path, y.path) b, y.t t, y.id id, x.p other, case when x.context = y.context then 2 else 1 end m1, case when x.context = y.context then 2 else 1 end * case when x.session = y.session then 1.5 else 1 end m from r x join r y on x.project = y.project and x.path <> y.path and y.p > x.p and y.p - x.p <= 500 and y.t - x.t < 3600000), """ + _CLOSED + " select project, a, b, n, count, round(strength, 6) strength from s",
    "significant_visuals": _VI + "select id, round(arousal, 6) arousal, round(valence, 6) valence from v where arousal > 0.7 or abs(valence) > 0.7",
    "tag_strength": _VI + ", s as (select id, round(least(0.3 + 0.3 * (1 - 1 / (1 + 0.1::double * n)) + greatest(0, (significance - 0.6) * 0.5), 1), 6) strength from v where significance is not null) select id, strength, strength >= 0.6 tag from s",
    "pruning_candidates": _VI + "select id, case when old > 90 then 'stale' else 'low_significance' end reason, round(case when old > 90 then old / 90 * (1 - significance) else (0.2 - significance) * least(old / 14, 1) end, 6) score from v where significance is not null and old is not null and not pinned and coalesce(frame_number, 1) <> 0 and (old > 90 or significance < 0.2)",
    "should_prune_visual": _VI + "select id, not pinned and not k0 and ((old + 60 > 90 and significance < 0.2) or (old + 60 > 180 and significance < 0.5)) prune from v where significance is not null and old is not null",
    "visual_weights": _VI + f"select id, round({_W}, 6) weight, round(coalesce(significance, 0.5) * 0.2 + case when {_W} > 0.7 then ({_W} - 0.7) * 0.3 else 0 end, 6) boost from v where arousal is not null",
    "visual_stats": _VI + "select media_type, source, count(*) n, round(avg(significance), 6) significance from v group by 1, 2",
    "aggregate_frames": f"with v as {own_sql('visual_memories', 'video_id, objects, emotional_valence, emotional_arousal, significance')}, o as (select distinct video_id, lower(unnest(json_extract_string(objects, '$[*]'))) o from v where json_valid(objects) and objects like '[%'), n as (select video_id, string_agg(o, ',' order by o) objects from o group by 1) select v.video_id, round(avg(emotional_valence), 6) valence, round(avg(emotional_arousal), 6) arousal, greatest(max(significance), 0) significance, coalesce(max(n.objects), '') objects from v left join n using (video_id) where video_id is not null group by 1",
}
