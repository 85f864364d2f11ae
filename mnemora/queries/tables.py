"""Filters, aggregates and maintenance over the project's own tables, most of them in Spark SQL over deduplicated views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import activation as act
from mnemora.operators.episodes import episodes
from mnemora.queries.base import NOW, clean_key, own, own_sql, read_table
from mnemora.queries.temporal import episode_sql

c = F.col
r6 = lambda x: F.round(x, 6)
_P = "lower(regexp_replace(project_id, '^\\s+|\\s+$', '', 'g'))"
_MEM = own_sql("memories", "id, type, content, gist, created_at, last_accessed, access_count, emotional_weight, project_id, encoding_strength, consolidation_state, last_consolidated, source")
_VIS = own_sql("visual_memories", "id, description, media_type, emotional_valence, emotional_arousal, significance, shared_by, source, received_at, last_accessed, access_count, created_at, project_id")
_HIS = own_sql("access_history", "id, memory_id, accessed_at")
_STATES = ("fresh", "consolidating", "consolidated", "reconsolidating")
_TYPES = ("learning", "decision", "context", "bug", "solution", "conversation")
_VALID_EMB = "(select memory_id, max(model) model, max(dimensions) dimensions from memory_embeddings where vector is not null group by memory_id)"


def _mem(spark: SparkSession, d: str) -> DataFrame:
    return own(spark, d, "memories")


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memory_embeddings").filter("vector is not null").groupBy("memory_id").agg(F.max("model").alias("model"), F.max("dimensions").alias("dimensions"))


def query_memories(spark, d):
    """Conjunctive filters, newest first, a page of them."""
    return _mem(spark, d).filter((c("type") == "learning") & (c("access_count") >= 2)).orderBy(F.desc("created_at"), "id").offset(5).limit(100).select("id", "created_at", "access_count")


def recently_accessed(spark, d):
    return _mem(spark, d).filter(c("last_accessed").between(NOW - 30 * 86_400_000, NOW)).select("id", "last_accessed")


def stale_memories(spark, d):
    return _mem(spark, d).filter((c("last_accessed").isNull() | (c("last_accessed") < NOW - 60 * 86_400_000)) & (c("encoding_strength") > 0.1)).orderBy(F.asc_nulls_first("last_accessed"), "id").limit(100).select("id", "last_accessed")


def by_state(spark, d):
    return _mem(spark, d).filter(c("consolidation_state") == "consolidating").orderBy("created_at", "id").limit(100).select("id", "created_at")


def typed_memories(spark, d):
    """Types outside the known ones come out as ``learning``."""
    kind = F.lower(F.trim("type"))
    return _mem(spark, d).select("id", F.when(kind.isin(*_TYPES), kind).otherwise("learning").alias("type"))


def partial_update(spark, d):
    """New values where they are given, the old ones else, of several fields at once."""
    m = _mem(spark, d)
    new = m.filter("access_count >= 10").select("id", F.concat(F.lit("seen "), c("access_count").cast("string")).alias("new_gist"), F.when(c("access_count") >= 12, 0.9).alias("new_weight"), F.when(c("type") == "bug", "solution").alias("new_type"))
    return m.join(new, "id", "left").select("id", F.coalesce("new_gist", "gist").alias("gist"), F.coalesce("new_weight", "emotional_weight").alias("weight"), F.coalesce("new_type", "type").alias("type"))


def has_embedding(spark, d):
    return _mem(spark, d).select("id").join(_emb(spark, d), c("id") == c("memory_id"), "left_semi")


def pending_embeddings(spark, d):
    return _mem(spark, d).select("id").join(_emb(spark, d), c("id") == c("memory_id"), "left_anti")


def stale_embeddings(spark, d):
    return _emb(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(c("model") != "memvec-base-2").alias("stale"))


def embedded_memories(spark, d):
    return _mem(spark, d).join(_emb(spark, d), c("id") == c("memory_id")).groupBy("type", "model").agg(F.count("*").alias("n"))


def access_summary(spark, d):
    return own(spark, d, "access_history").filter("accessed_at <= " + str(NOW)).groupBy("memory_id").agg(F.count("*").alias("n"), F.max("accessed_at").alias("last"))


def memory_base_level(spark, d):
    """Activation of every memory by the decay rate of its own last access."""
    h = own(spark, d, "access_history").filter(f"accessed_at <= {NOW}")
    last = h.groupBy("memory_id").agg(F.max("accessed_at").alias("last"))
    h = h.join(last, "memory_id")
    return h.groupBy("memory_id").agg(r6(act.base_level(NOW - c("accessed_at"), act.session_decay((NOW - c("last")).cast("double")))).alias("b"))


def consolidation_counts(spark, d):
    states = spark.createDataFrame([(s,) for s in _STATES], "state string")
    n = _mem(spark, d).groupBy(c("consolidation_state").alias("state")).agg(F.count("*").alias("n"))
    return states.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def consolidation_status(spark, d):
    """Counts by state, weak memories (under 0.1), mean strength, vectors pending, and the five newest episodes' sizes."""
    m = _mem(spark, d)
    a = m.agg(F.count("*").alias("memories"), F.count_if(c("encoding_strength") < 0.1).alias("weak"), r6(F.avg("encoding_strength")).alias("mean_strength"), *[F.count_if(c("consolidation_state") == s).alias(s) for s in _STATES])
    e = episodes(m.select(clean_key(c("project_id")).alias("key"), "id", c("created_at").alias("at"))).groupBy("key", "run", "part").agg(F.count("*").alias("n"), F.max("at").alias("ended"))
    newest = e.orderBy(F.desc("ended"), "key", "run", "part").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("ended")).alias("o"), "key", "run", "part", "n"))), lambda x: x["n"].cast("string")), ",").alias("newest_episodes"))
    return a.crossJoin(pending_embeddings(spark, d).agg(F.count("*").alias("pending"))).crossJoin(newest)  # one row each


def store_stats(spark, d):
    """Rows of each kind and bytes of text."""
    parts = [
        ("memories", _mem(spark, d)), ("embeddings", _emb(spark, d)), ("projects", own(spark, d, "projects")), ("visual_memories", own(spark, d, "visual_memories")), ("visual_embeddings", own(spark, d, "visual_memories").filter("embedding is not null")),
        ("accesses", own(spark, d, "access_history")), ("pending", pending_embeddings(spark, d)), ("pending_visuals", own(spark, d, "visual_memories").filter("embedding is null")),
    ]
    out = _mem(spark, d).agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n")).select(F.lit("bytes").alias("what"), "n")
    for name, df in parts:
        out = out.union(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
    return out


def project_rollup(spark, d):
    """Of each project the number of memories, the types seen in order of their first memory, and the last memory's time."""
    m = _mem(spark, d).withColumn("p", clean_key(c("project_id"))).filter("p is not null")
    n = m.groupBy(c("p").alias("project")).agg(F.count("*").alias("memories"), F.max("created_at").alias("last"))
    first = m.filter("type is not null").groupBy(c("p").alias("project"), "type").agg(F.min(F.struct("created_at", "id")).alias("x"))
    seen = first.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "type"))), lambda s: s["type"]), ",").alias("types_seen"))
    return n.join(seen, "project", "left")


def project_rollup_tags(spark, d):
    """Distinct tags of each project, in order."""
    m = _mem(spark, d).withColumn("p", clean_key(c("project_id"))).filter("p is not null")
    t = m.select(c("p").alias("project"), F.explode(F.from_json("tags", "array<string>")).alias("tag")).filter("tag is not null").distinct()
    return t.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("all_tags"))


def forget_cascade(spark, d):
    """What is left in every child table after the memories that were never accessed, and pictures without a use, are forgotten."""
    gone = _mem(spark, d).filter("access_count = 0").select(c("id").alias("gone"))
    unseen = own(spark, d, "visual_memories").filter("access_count = 0").select(c("id").alias("gone"))
    order = _mem(spark, d).select(c("project_id").alias("p"), "id")
    pairs = f_pairs(order)
    left = lambda df, column, out: df.join(out, c(column) == c("gone"), "left_anti")
    parts = [
        ("embeddings", left(_emb(spark, d), "memory_id", gone)),
        ("accesses", left(own(spark, d, "access_history").select("memory_id"), "memory_id", gone)),
        ("associations", left(left(pairs, "src", gone), "dst", gone)),
        ("events", left(_mem(spark, d).filter("created_at is not null").select("id"), "id", gone)),
        ("visual_embeddings", left(own(spark, d, "visual_memories").filter("embedding is not null").select("id"), "id", unseen)),
    ]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.union(row)
    return out


def f_pairs(memories: DataFrame) -> DataFrame:
    """src, dst: associations made up for the test, memories whose ids begin with the same three characters."""
    m = memories.select("id", F.substring("id", 1, 3).alias("k"))
    return m.select(c("id").alias("src"), "k").join(m.select(c("id").alias("dst"), "k"), "k").filter("src < dst").select("src", "dst")


def prune_oldest(spark, d):
    """The oldest thousand by last access, then by accesses."""
    return _mem(spark, d).orderBy(F.coalesce("last_accessed", "created_at"), "access_count", "id").limit(1000).select("id")


def micro_strengthen(spark, d):
    m = _mem(spark, d).filter(c("last_accessed") >= NOW - 7 * 86_400_000)
    return m.select("id", r6(F.least(c("encoding_strength") * 1.1, F.lit(1.0))).alias("strength"))


def micro_decay(spark, d):
    m = _mem(spark, d).filter((c("last_accessed").isNull() | (c("last_accessed") < NOW - 7 * 86_400_000)) & (c("encoding_strength") > 0.1))
    return m.select("id", r6(F.greatest(c("encoding_strength") * 0.98, F.lit(0.1))).alias("strength"))


def visual_list(spark, d):
    v = own(spark, d, "visual_memories").filter((c("media_type") == "image") & (c("significance") >= 0.5) & (c("shared_by") == "user"))
    return v.orderBy(F.desc("received_at"), "id").limit(50).select("id", "received_at")


QUERIES = {f.__name__: f for f in (query_memories, recently_accessed, stale_memories, by_state, typed_memories, partial_update, has_embedding, pending_embeddings, project_rollup, stale_embeddings, embedded_memories, access_summary, memory_base_level, consolidation_counts, consolidation_status, store_stats, project_rollup_tags, forget_cascade, prune_oldest, micro_strengthen, micro_decay, visual_list)}

_M, _V, _H = f"with m as {_MEM} ", f"with v as {_VIS} ", f"with h as {_HIS} "
_CASE = f"case when lower(trim(type)) in {_TYPES} then lower(trim(type)) else 'learning' end"
_RATE = "case when {a} < 0 then 0.5 when {a} < 1800000 then 0.3 when {a} < 7200000 then 0.4 when {a} < 86400000 then 0.45 else 0.5 end"
ORACLES = {
    "query_memories": _M + "select id, created_at, access_count from m where type = 'learning' and access_count >= 2 order by created_at desc nulls last, id limit 100 offset 5",
    "recently_accessed": _M + f"select id, last_accessed from m where last_accessed between {NOW - 30 * 86_400_000} and {NOW}",
    "stale_memories": _M + f"select id, last_accessed from m where (last_accessed is null or last_accessed < {NOW - 60 * 86_400_000}) and encoding_strength > 0.1 order by last_accessed asc nulls first, id limit 100",
    "by_state": _M + "select id, created_at from m where consolidation_state = 'consolidating' order by created_at nulls first, id limit 100",
    "typed_memories": _M + f"select id, {_CASE} type from m",
    "partial_update": _M + "select id, case when access_count >= 10 then 'seen ' || access_count else gist end gist, case when access_count >= 12 then 0.9 else emotional_weight end weight, case when access_count >= 10 and type = 'bug' then 'solution' else type end type from m",
    "has_embedding": _M + f"select id from m where id in (select memory_id from {_VALID_EMB})",
    "pending_embeddings": _M + f"select id from m where id not in (select memory_id from {_VALID_EMB})",
    "stale_embeddings": f"select model, count(*) n, count(*) filter (where model <> 'memvec-base-2') stale from {_VALID_EMB} group by model",
    "embedded_memories": _M + f"select type, model, count(*) n from m join {_VALID_EMB} e on m.id = e.memory_id group by all",
    "access_summary": _H + f"select memory_id, count(*) n, max(accessed_at) \"last\" from h where accessed_at <= {NOW} group by 1",
    "memory_base_level": _H + f", k as (select *, max(accessed_at) over (partition by memory_id) last from h where accessed_at <= {NOW}) select memory_id, round(ln(sum(pow(greatest(({NOW} - accessed_at) / 1000.0::double, 1.0::double), -({_RATE.format(a=f'({NOW} - last)')})))), 6) b from k group by 1",
    "consolidation_counts": _M + f"select s state, count(m.id) n from (select unnest({list(_STATES)}) s) left join m on consolidation_state = s group by 1",
    "consolidation_status": _M + f", {episode_sql('select nullif(' + _P + ", '') k, id, created_at t from m")}, z as (select k, run, part, count(*) n, max(t) ended from ep group by 1, 2, 3 order by ended desc, k, run, part limit 5) select count(*) memories, count(*) filter (where encoding_strength < 0.1) weak, round(avg(encoding_strength), 6) mean_strength, {', '.join(f"count(*) filter (where consolidation_state = '{x}') {x}" for x in _STATES)}, count(*) filter (where id not in (select memory_id from {_VALID_EMB})) pending, (select string_agg(n, ',' order by ended desc, k, run, part) from z) newest_episodes from m",
    "store_stats": _M + f", v as {own_sql('visual_memories', 'embedding')} select 'memories' what, count(*) n from m union all select 'embeddings', count(*) from {_VALID_EMB} union all select 'projects', count(distinct id) from projects union all select 'visual_memories', count(*) from v union all select 'visual_embeddings', count(*) from v where embedding is not null union all select 'accesses', count(distinct id) from access_history union all select 'pending', count(*) from m where id not in (select memory_id from {_VALID_EMB}) union all select 'pending_visuals', count(*) from v where embedding is null union all select 'bytes', coalesce(sum(strlen(content)), 0) from m",
    "project_rollup": _M + f", k as (select {_P} project, type, created_at t, id from m where {_P} <> ''), f as (select project, type, min((t, id)) x from k where type is not null group by 1, 2), s as (select project, string_agg(type, ',' order by x, type) types_seen from f group by 1), n as (select project, count(*) memories, max(t) \"last\" from k group by 1) select n.project, memories, \"last\", types_seen from n left join s using (project)",
    "project_rollup_tags": f"with m as {own_sql('memories', 'project_id, tags')}, t as (select distinct {_P} project, unnest(json_extract_string(tags, '$[*]')) tag from m where {_P} <> '' and json_valid(tags) and tags like '[%') select project, string_agg(tag, ',' order by tag) all_tags from t where tag is not null group by 1",
    "forget_cascade": _M + f", g as (select id from m where access_count = 0), v as {own_sql('visual_memories', 'embedding, access_count')} select 'embeddings' what, count(*) n from {_VALID_EMB} where memory_id not in (select id from g) union all select 'accesses', count(*) from {_HIS} where memory_id is null or memory_id not in (select id from g) union all select 'associations', count(*) from m a join m b on a.id < b.id and substring(a.id, 1, 3) = substring(b.id, 1, 3) where a.id not in (select id from g) and b.id not in (select id from g) union all select 'events', count(*) from m where created_at is not null and id not in (select id from g) union all select 'visual_embeddings', count(*) from v where embedding is not null and access_count is distinct from 0",
    "prune_oldest": _M + "select id from m order by coalesce(last_accessed, created_at) nulls first, access_count nulls first, id limit 1000",
    "micro_strengthen": _M + f"select id, round(least(encoding_strength * 1.1, 1), 6) strength from m where last_accessed >= {NOW - 7 * 86_400_000}",
    "micro_decay": _M + f"select id, round(greatest(encoding_strength * 0.98, 0.1), 6) strength from m where (last_accessed is null or last_accessed < {NOW - 7 * 86_400_000}) and encoding_strength > 0.1",
    "visual_list": _V + "select id, received_at from v where media_type = 'image' and significance >= 0.5 and shared_by = 'user' order by received_at desc nulls last, id limit 50",
}
