"""Queries of graphs, retrieval and episodes over the integer set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.config import CORE, SERVER
from mnemora.functions import activation as act
from mnemora.functions.text import tokens
from mnemora.operators.cells import numbered
from mnemora.operators.graph import pagerank, shortest_path, spread
from mnemora.operators.retrieval import retrieve, within_budget
from mnemora.operators.sessions import clean_key
from mnemora.operators.similarity import best_match, recent_matches, top_matches
from mnemora.queries.base import F_EDGES, F_MEM, NOW_F, PROBE, f_edges, f_embeddings, f_history, f_memories, millis, own, own_sql, read_table, sql_cosine, sql_dot

c = F.col
r6 = lambda x: F.round(x, 6)
QUERIES, ORACLES = {}, {}


def _seeds(spark, d):
    return f_embeddings(spark, d).filter(c("id").isin(3, 7, 11)).select("id", (c("id") / 10.0).alias("a"))


def _spread(depth):
    return lambda spark, d: spread(_seeds(spark, d), f_edges(spark, d), depth).select("id", r6(c("a")).alias("a"))


def _sql_spread(seeds: str, depth: int, edges: str = "edges") -> str:
    out = f"fo_ as (select src, greatest(1, count(*)) f from {edges} group by 1), fi_ as (select dst, greatest(1, count(*)) f from {edges} group by 1), l_ as (select e.src id, e.dst too, w / f * 0.7 k from {edges} e join fo_ using (src) union all select e.dst, e.src, bw / f * 0.7 * 0.7 from {edges} e join fi_ using (dst)), s0 as (select id, a, 0 hop from ({seeds}))"
    for h in range(depth):
        out += f", g{h} as (select too id, sum(a * k) more from s{h} join l_ using (id) where hop = {h} and a >= 0.01 group by 1), s{h + 1} as (select coalesce(s{h}.id, g{h}.id) id, coalesce(a, 0) + coalesce(more, 0) a, coalesce(hop, {h + 1}) hop from s{h} full join g{h} on s{h}.id = g{h}.id)"
    return out


for _d in (1, 2, 3):
    QUERIES[f"spread_depth{_d}"] = _spread(_d)
    ORACLES[f"spread_depth{_d}"] = f"with {F_EDGES}, {_sql_spread('select vec_id id, vec_id / 10.0::double a from embeddings where vec_id in (3, 7, 11)', _d)} select id, round(a, 6) a from s{_d}"


def _location_edges(spark, d):
    return f_edges(spark, d).withColumn("bw", 0.7 * c("w"))


QUERIES["location_spread"] = lambda spark, d: spread(f_embeddings(spark, d).filter(c("id") == PROBE).select("id", F.lit(1.0).alias("a")), _location_edges(spark, d), 3).select("id", r6(c("a")).alias("a"))
ORACLES["location_spread"] = f"with {F_EDGES}, le as (select src, dst, w, 0.7 * w bw from edges), {_sql_spread(f'select vec_id id, 1.0::double a from embeddings where vec_id = {PROBE}', 3, 'le')} select id, round(a, 6) a from s3"

QUERIES["pagerank"] = lambda spark, d: pagerank(f_embeddings(spark, d), f_edges(spark, d)).select("id", F.round("rank", 9).alias("rank"))
_PR = "".join(f", r{k + 1} as (select e_.id, 0.15::double / n + 0.85::double * (coalesce(g, 0) + coalesce((select sum(r) from r{k} where id not in (select src from edges)), 0) / n) r from e_ left join (select dst id, sum(r / f) g from edges join r{k} on src = r{k}.id join fo using (src) group by 1) x on x.id = e_.id, n_)" for k in range(10))
ORACLES["pagerank"] = f"with {F_EDGES}, fo as (select src, count(*) f from edges group by 1), r0 as (select id, 1.0::double / n r from e_, n_){_PR} select id, round(r, 9) \"rank\" from r10"
QUERIES["activation_path"] = lambda spark, d: shortest_path(f_edges(spark, d), 7, 20)
ORACLES["activation_path"] = f"with recursive {F_EDGES}, w(id, path, hops) as (select 7::bigint, [7::bigint], 0 union all select dst, list_append(path, dst), hops + 1 from w join edges on src = w.id where hops < 6 and not list_contains(path, dst)), f as (select min(hops) h from w where id = 20), g as (select hops, min(path) path from w, f where id = 20 and hops = h group by hops) select hops, array_to_string(path, '>') path from g"

_OWN = "(s * s * s * (1 + emotion - 0.5) * (1 + least(greatest((b + 10) / 10, 0), 1)))"
_TOP = "select id, round(total, 6) total, round(1 / (1 + exp((TAU - total) / NOISE)), 6) probability from t where 1 / (1 + exp((TAU - total) / NOISE)) >= 0.1 order by t.total desc, id limit 10"


def _shape(df):
    return df.select("id", r6(c("total")).alias("total"), r6(c("probability")).alias("probability"))


def _own_sql(tau, noise):
    return f"with {F_MEM}, t as (select id, {_OWN} total from mem) " + _TOP.replace("TAU", str(tau)).replace("NOISE", str(noise))


QUERIES["retrieve_core"] = lambda spark, d: _shape(retrieve(f_memories(spark, d)))
ORACLES["retrieve_core"] = _own_sql(0.3, 0.1)
QUERIES["retrieve_preset_server"] = lambda spark, d: _shape(retrieve(f_memories(spark, d), config=SERVER))
ORACLES["retrieve_preset_server"] = _own_sql(0.0, 0.25)
_SEEDS = f"select id, {_OWN} a from mem where s * s * s > 0.1 order by a desc, id limit 5"
_INSIDE = "ie as (select edges.* from edges where src in (select id from mem) and dst in (select id from mem))"
_WITH = f"with {F_MEM}, {F_EDGES}, {_INSIDE}, {_sql_spread(_SEEDS, 3, 'ie')}, t as (select mem.id, {_OWN} + coalesce(a, 0) total from mem left join s3 on s3.id = mem.id) "
QUERIES["retrieve_with_spreading"] = lambda spark, d: _shape(retrieve(f_memories(spark, d), f_edges(spark, d)))
ORACLES["retrieve_with_spreading"] = _WITH + _TOP.replace("TAU", "0.3").replace("NOISE", "0.1")


def retrieve_recency(spark, d):
    m = f_memories(spark, d).select("id", "last")
    h = f_history(spark, d).join(m, "id")
    b = h.groupBy("id").agg(act.base_level(NOW_F - c("t"), act.session_decay((NOW_F - c("last")).cast("double"))).alias("b"))
    return b.orderBy(F.desc("b"), "id").limit(10).select("id", r6(c("b")).alias("b"))


def topk_similarity(spark, d):
    return f_memories(spark, d).orderBy(F.desc("s"), "id").limit(10).select("id", r6(c("s")).alias("s"))


def most_similar(spark, d):
    return f_memories(spark, d).filter((c("id") != PROBE) & (c("s") >= 0.2)).agg(F.max_by("id", F.struct("s", -c("id"))).alias("id"), r6(F.max("s")).alias("s"))


def rank_by_activation(spark, d):
    total = act.combined(c("b"), act.cubed(c("s")), F.lit(0.0), c("emotion"))
    return f_memories(spark, d).select("id", total.alias("total")).orderBy(F.desc("total"), "id").limit(20).select("id", r6(c("total")).alias("total"))


def context_budget(spark, d):
    """The ten best that are similar by 0.3 or more, as long as they fit in 2,000 tokens."""
    m = f_memories(spark, d)
    best = retrieve(m).join(m.select("id", "s", "content"), "id").filter("s >= 0.3").select("id", "total", tokens(c("content")).alias("tokens"))
    return within_budget(best, 2000, [F.desc("total"), "id"]).select("id", "tokens", "running")


def salience_rank(spark, d):
    return f_memories(spark, d).filter("last is not null").select("id", F.pow(F.lit(2.0), -(NOW_F - c("last")) / 86_400_000.0).alias("x")).orderBy(F.desc("x"), "id").limit(10).select("id", r6(c("x")).alias("x"))


def reinforce_top5(spark, d):
    """Associations between two of a probe's five best memories, in whatever direction, made stronger by 0.05."""
    best = top_matches(f_embeddings(spark, d).filter("id % 20 = 0"), f_embeddings(spark, d), 5).select("query", "id")
    e = f_edges(spark, d)
    ends = best.select("query", c("id").alias("src")).join(e, "src").join(best.select("query", c("id").alias("dst")), ["query", "dst"])
    return ends.select("src", "dst", r6(act.reinforced(c("w"))).alias("w")).distinct()


def association_index(spark, d):
    e = f_edges(spark, d)
    return e.select(c("src").alias("id"), "src", "dst").union(e.select(c("dst").alias("id"), "src", "dst")).groupBy("id").agg(F.count("*").alias("n"))


def prune_associations(spark, d):
    """Associations that keep at least 0.1 after a month's decay as consolidated ones."""
    kept = act.association_decay(c("w"), F.lit(30.0 * 86_400_000), F.lit("consolidated"))
    return f_edges(spark, d).select("src", "dst", r6(kept).alias("w"), kept.alias("x")).filter("x >= 0.1").drop("x")


def associations_of(spark, d):
    """Both kinds of neighbours of a node: edges from it and to it."""
    return f_edges(spark, d).filter((c("src") == 20) | (c("dst") == 20)).select("src", "dst", r6(c("w")).alias("w"))


def location_assoc_stats(spark, d):
    return f_edges(spark, d).groupBy("src").agg(F.count("*").alias("n"), F.count_if(c("w") >= 0.5).alias("strong"), r6(F.avg("w")).alias("mean"))


def ndcg_mrr(spark, d):
    """Quality of the ranking by activation against graded relevance (the label)."""
    total = act.combined(c("b"), act.cubed(c("s")), F.lit(0.0), c("emotion"))
    ranked = f_memories(spark, d).select("id", (c("project") % 4).alias("rel"), total.alias("t")).orderBy(F.desc("t"), "id").limit(10)
    ranked = ranked.withColumn("k", F.row_number().over(Window.orderBy(F.desc("t"), "id")))  # ten rows
    ideal = f_memories(spark, d).select((c("project") % 4).alias("rel"), "id").orderBy(F.desc("rel"), "id").limit(10)
    ideal = ideal.withColumn("k", F.row_number().over(Window.orderBy(F.desc("rel"), "id")))
    gain = (F.pow(F.lit(2.0), c("rel")) - 1) / F.log2(c("k") + 1.0)
    a = ranked.agg(F.sum(gain).alias("dcg"), F.max(F.when(c("rel") > 0, 1.0 / c("k")).otherwise(0.0)).alias("mrr"), (F.count_if(c("rel") > 0) / 10.0).alias("p"), F.count_if(c("rel") > 0).alias("hits"))
    every = f_memories(spark, d).agg(F.count_if(c("project") % 4 > 0).alias("relevant"))
    return a.crossJoin(ideal.agg(F.sum(gain).alias("best"))).crossJoin(every).select(r6(c("dcg") / c("best")).alias("ndcg"), r6(c("mrr")).alias("mrr"), r6(c("p")).alias("p"), r6(c("hits") / c("relevant")).alias("r"))  # one row each


def _events(spark, d):
    return read_table(spark, d, "events").select(c("user_id").alias("key"), c("event_id").alias("id"), millis("ts").alias("at"))


def sessions_users(spark, d):
    """Sessions of each user, and when each ended: a lapsed one as the next began, the last one isn't ended."""
    e = numbered(_events(spark, d), ["key"], ["at", "id"], F.shiftright("at", 27), lambda before, this: this("at") - before("at") >= 1_800_000)
    s = e.groupBy(c("key").alias("user_id"), c("run").alias("session")).agg(F.min("at").alias("started"), F.max("at").alias("last_active"), F.count("*").alias("n"))
    after = s.select("user_id", (c("session") - 1).alias("session"), c("started").alias("ended"))
    return s.join(after, ["user_id", "session"], "left")


def session_memories(spark, d):
    """Memories that a user accessed during each of the user's sessions; both meet by user and hour."""
    s = sessions_users(spark, d).select("user_id", "session", "started", "last_active")
    hours = F.explode(F.sequence(F.floor(c("started") / 3_600_000), F.floor(c("last_active") / 3_600_000)))
    n = f_embeddings(spark, d).agg(F.count("*").alias("n"))
    h = _events(spark, d).crossJoin(F.broadcast(n)).select(c("key").alias("user_id"), (c("id") % c("n")).alias("id"), c("at").alias("t"), F.floor(c("at") / 3_600_000).alias("hour"))  # one row on the right
    return h.join(s.withColumn("hour", hours), ["user_id", "hour"]).filter((c("t") >= c("started")) & (c("t") <= c("last_active"))).select("user_id", "session", "id").distinct()


def expired_sessions(spark, d):
    return sessions_users(spark, d).filter(c("ended") < NOW_F - 7 * 86_400_000).groupBy("user_id").agg(F.count("*").alias("n"))


def auto_associations(spark, d):
    """Of each memory, the five most similar ones (0.4 or more) made within 30 minutes before it, in the same project."""
    v = read_table(spark, d, "memory_embeddings").filter("dimensions = 64 and size(vector) = 64").groupBy("memory_id").agg(F.max("vector").alias("v"))
    m = own(spark, d, "memories").select(clean_key(c("project_id")).alias("key"), "id", c("created_at").alias("at"))
    return recent_matches(m.join(v, c("id") == c("memory_id")), 1_800_000, 0.4, 5).select("src", "dst", r6(c("s")).alias("s"))


def pe_routing(spark, d):
    """What becomes of each note against the most similar other one; asked for are the ids divisible by 20, against all."""
    e = f_embeddings(spark, d)
    best = best_match(e.filter("id % 20 = 0"), e, others=True)
    zone = act.error_zone(1 - c("s"), F.lit(0.1), F.lit(0.55))
    return best.select("id", F.when(c("s") >= 0.4, c("match")).alias("match"), F.when(c("s") >= 0.4, zone).otherwise("new_trace").alias("zone"))


for _f in (retrieve_recency, topk_similarity, most_similar, rank_by_activation, context_budget, salience_rank, reinforce_top5, association_index, prune_associations, associations_of, location_assoc_stats, ndcg_mrr, sessions_users, session_memories, expired_sessions, auto_associations, pe_routing):
    QUERIES[_f.__name__] = _f

_RATE = "case when a < 0 then 0.5 when a < 1800000 then 0.3 when a < 7200000 then 0.4 when a < 86400000 then 0.45 else 0.5 end"
_EV = """ev as (select user_id k, event_id id, epoch_us(ts) // 1000 t from events)"""
_SS = _EV + """, s1 as (select *, case when t - lag(t) over (partition by k order by t, id) < 1800000 then 0 else 1 end s from ev), s2 as (select *, sum(s) over (partition by k order by t, id) g from s1),
s3_ as (select k user_id, g session, min(t) started, max(t) last_active, count(*) n from s2 group by 1, 2), ss as (select *, lead(started) over (partition by user_id order by session) ended from s3_)"""
_TEN = f"t as (select id, {_OWN} total, s, content from mem), ten as (select * from t where 1 / (1 + exp((0.3 - total) / 0.1)) >= 0.1 order by total desc, id limit 10)"
ORACLES |= {
    "retrieve_recency": f"with {F_MEM}, x as (select h.id, t, {NOW_F} - \"last\" a from h join mem on h.id = mem.id) select id, round(b, 6) b from (select id, ln(sum(pow(greatest(({NOW_F} - t) / 1000.0::double, 1.0::double), -({_RATE})))) b from x group by id order by b desc, id limit 10)",
    "topk_similarity": f"with {F_MEM} select id, round(s, 6) s from (select id, s from mem order by s desc, id limit 10)",
    "most_similar": f"with {F_MEM} select id, round(s, 6) s from (select id, s from mem where id <> {PROBE} and s >= 0.2 order by s desc, id limit 1)",
    "rank_by_activation": f"with {F_MEM} select id, round(t, 6) total from (select id, {_OWN} t from mem order by t desc, id limit 20)",
    "context_budget": f"with {F_MEM}, {_TEN}, u as (select id, total, ceil(length(content) / 4.0)::int tokens from ten where s >= 0.3), v as (select id, tokens, sum(tokens) over (order by total desc, id)::bigint running from u) select * from v where running <= 2000",
    "salience_rank": f"with {F_MEM} select id, round(x, 6) x from (select id, pow(2.0::double, -({NOW_F} - \"last\") / 86400000.0::double) x from mem where \"last\" is not null order by x desc, id limit 10)",
    "reinforce_top5": f"with {F_EDGES}, k as (select a.vec_id q, b.vec_id id, row_number() over (partition by a.vec_id order by round({sql_cosine('a.embedding', 'b.embedding')}, 12) desc, b.vec_id) r from embeddings a, embeddings b where a.vec_id % 20 = 0) select distinct src, dst, round(least(1, w + 0.05), 6) w from edges join k x on x.id = src and x.r <= 5 join k y on y.id = dst and y.r <= 5 and x.q = y.q",
    "association_index": f"with {F_EDGES} select id, count(*) n from (select src id from edges union all select dst from edges) group by 1",
    "prune_associations": f"with {F_EDGES} select src, dst, round(w * exp(-1.0::double), 6) w from edges where w * exp(-1.0::double) >= 0.1",
    "associations_of": f"with {F_EDGES} select src, dst, round(w, 6) w from edges where src = 20 or dst = 20",
    "location_assoc_stats": f"with {F_EDGES} select src, count(*) n, count(*) filter (where w >= 0.5) strong, round(avg(w), 6) mean from edges group by 1",
    "ndcg_mrr": f"with {F_MEM}, r as (select project % 4 rel, row_number() over (order by {_OWN} desc, id) k from mem qualify k <= 10), i as (select project % 4 rel, row_number() over (order by project % 4 desc, id) k from mem qualify k <= 10) select round((select sum((pow(2, rel) - 1) / log2(k + 1)) from r) / (select sum((pow(2, rel) - 1) / log2(k + 1)) from i), 6) ndcg, round((select max(case when rel > 0 then 1.0::double / k else 0 end) from r), 6) mrr, round((select count(*) filter (where rel > 0) / 10.0::double from r), 6) p, round((select count(*) filter (where rel > 0) from r) / (select count(*) filter (where project % 4 > 0) from mem)::double, 6) r",
    "sessions_users": f"with {_SS} select * from ss",
    "session_memories": f"with {_SS} select distinct user_id, session, event_id % (select count(*) from embeddings) id from events join ss using (user_id) where epoch_us(ts) // 1000 between started and last_active",
    "expired_sessions": f"with {_SS} select user_id, count(*) n from ss where ended < {NOW_F - 7 * 86_400_000} group by 1",
    "auto_associations": f"with v as (select memory_id id, max(vector) v from memory_embeddings where dimensions = 64 and len(vector) = 64 group by 1), g as (select * from v where isfinite({sql_dot('v', 'v')}) and {sql_dot('v', 'v')} > 0), m as (select id, v, nullif(lower(regexp_replace(project_id, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')), '') p, created_at t from {own_sql('memories', 'project_id, created_at')} join g using (id)), s as (select a.id src, b.id dst, round({sql_cosine('a.v', 'b.v')}, 12) s from m a join m b on a.p = b.p and b.t < a.t and a.t - b.t < 1800000), k as (select *, row_number() over (partition by src order by s desc, dst) k from s where s >= 0.4) select src, dst, round(s, 6) s from k where k <= 5",
    "pe_routing": f"with s as (select a.vec_id id, b.vec_id o, {sql_cosine('a.embedding', 'b.embedding')} s from embeddings a, embeddings b where a.vec_id % 20 = 0 and b.vec_id <> a.vec_id), k as (select *, row_number() over (partition by id order by round(s, 12) desc, o) k from s) select id, case when s >= 0.4 then o end \"match\", case when s < 0.4 or 1 - s >= 0.55 then 'new_trace' when 1 - s < 0.1 then 'reinforce' else 'reconsolidate' end zone from k where k = 1",
}
