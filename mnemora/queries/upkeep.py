"""Queries of what changes stored rows: lookups, upserts, deletions, maintenance, and functions registered for SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.config import DAY_MS
from mnemora.engine import route
from mnemora.functions.registry import register
from mnemora.operators.consolidation import decay_associations, next_state, primed, strengthened, working_memory
from mnemora.operators.sessions import clean_key
from mnemora.operators.similarity import best_match
from mnemora.queries.base import F_EDGES, F_MEM, NOW, f_edges, f_embeddings, f_memories, own, own_sql, read_table, sql_cosine

c = F.col
r6 = lambda x: F.round(x, 6)


def memory_lookup(spark, d):
    """The memories of one exact content type and state by equality, as a point lookup reads them."""
    return own(spark, d, "memories").filter((c("type") == "bug") & (c("consolidation_state") == "reconsolidating")).select("id", "type", "consolidation_state")


def project_lookup(spark, d):
    """A project by its path."""
    return own(spark, d, "projects").filter(c("path").startswith("/home/dev/corran-index")).select("id", "path")


def project_upsert(spark, d):
    """The projects after the paths of this batch were asked for: known ones are touched, the others are made."""
    p = own(spark, d, "projects").filter("path is not null").groupBy("path").agg(F.min("id").alias("id"), F.max("last_active").alias("last_active"))
    wanted = own(spark, d, "memories").select(F.concat(F.lit("/home/dev/"), F.lower("source"), F.lit("-"), (F.length("id") + c("access_count")).cast("string")).alias("path"))
    wanted = wanted.unionByName(p.filter(c("path").endswith("7")).select("path")).filter("path is not null").distinct()
    out = p.join(wanted.withColumn("asked", F.lit(True)), "path", "full")
    return out.select("path", c("id").isNotNull().alias("known"), F.when(c("asked"), F.lit(NOW)).otherwise(c("last_active")).alias("last_active"))


def record_access(spark, d):
    """Counts and last uses of memories after the log's accesses up to now were added to them."""
    m = own(spark, d, "memories").select("id", "access_count", "last_accessed")
    h = own(spark, d, "access_history").filter(f"accessed_at <= {NOW}").groupBy("memory_id").agg(F.count("*").alias("n"), F.max("accessed_at").alias("last"))
    x = m.join(h, c("id") == c("memory_id"), "left")
    return x.select("id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("access_count"), F.greatest("last_accessed", "last").alias("last_accessed"))


def associate_upsert(spark, d):
    """Associations of nodes given one after the other: the latest strength of a pair counts, and how often it was given."""
    e = f_edges(spark, d)
    again = e.select("src", "dst", (c("w") * 0.5).alias("w"), F.lit(2).alias("at")).filter("src % 3 = 0").unionByName(e.select("src", "dst", "w", F.lit(1).alias("at")))
    return again.groupBy("src", "dst").agg(r6(F.max_by("w", "at")).alias("w"), F.count("*").alias("n"))


def dissociate(spark, d):
    """Associations without the pairs that were taken apart."""
    gone = f_edges(spark, d).filter("(src + dst) % 5 = 0").select("src", "dst")
    return f_edges(spark, d).join(gone, ["src", "dst"], "left_anti").select("src", "dst", r6(c("w")).alias("w"))


def update_strengths(spark, d):
    """Strengths of single associations set anew, the others as they were."""
    new = f_edges(spark, d).filter("src % 10 = 1").select("src", "dst", F.lit(0.42).alias("new"))
    return f_edges(spark, d).join(new, ["src", "dst"], "left").select("src", "dst", r6(F.coalesce("new", "w")).alias("w"))


def _reinforced(spark, d):
    return f_edges(spark, d).select("src", "dst", c("w").alias("strength"), F.when(c("src") % 4 != 0, F.lit(NOW) - c("dst") * 60_000).alias("last_reinforced"))


def decay_candidates(spark, d):
    """Associations that were reinforced at some time."""
    return _reinforced(spark, d).filter("last_reinforced is not null").select("src", "dst", "last_reinforced")


def association_step(spark, d):
    """One step of decay of the associations, as fresh ones: those under 0.1 go, tiny changes aren't made."""
    return decay_associations(_reinforced(spark, d), NOW).select("src", "dst", r6(c("strength")).alias("strength"))


def micro_consolidation(spark, d):
    """Every memory's strength after one pass: more for those used within 30 minutes, less for those idle for a week."""
    m = own(spark, d, "memories")
    idle = NOW - F.coalesce("last_accessed", "created_at")
    return m.select("id", r6(strengthened(c("encoding_strength"), idle)).alias("strength"))


def state_transitions(spark, d):
    m = own(spark, d, "memories")
    return m.select("id", next_state(c("consolidation_state"), NOW - c("created_at"), NOW - c("last_consolidated")).alias("state"))


def prp_modifier(spark, d):
    """The boost that earlier important memories give to each memory."""
    m = own(spark, d, "memories").select("id", c("created_at").alias("at"), c("emotional_weight").alias("importance"))
    return primed(m).select("id", r6(c("boost")).alias("boost"))


def working_memory_now(spark, d):
    """What is in working memory after each project's last use of a memory."""
    m = own(spark, d, "memories").select(clean_key(c("project_id")).alias("project"), "id").filter("project is not null")
    h = own(spark, d, "access_history").filter(f"accessed_at <= {NOW}").select(c("memory_id").alias("id"), c("accessed_at").alias("at"))
    return working_memory(h.join(m, "id"), ["project"]).select("project", "id", "at", "k")


def store_visual(spark, d):
    """Pictures with the defaults of what they lack, and their first access."""
    v = own(spark, d, "visual_memories")
    return v.select("id", F.coalesce("emotional_valence", F.lit(0.0)).alias("valence"), F.coalesce("emotional_arousal", F.lit(0.5)).alias("arousal"), F.coalesce("significance", F.lit(0.5)).alias("significance"), F.coalesce("source", F.lit("direct")).alias("source"), F.coalesce("received_at", "created_at").alias("first_access"))


def reconsolidation_routes(spark, d):
    """What becomes of each note against the most similar other one, by surprise and the thresholds of that one's use."""
    e = f_embeddings(spark, d)
    m = f_memories(spark, d).select(c("id").alias("match"), "accesses", ((F.lit(1_706_745_600_000) - F.coalesce("last", F.lit(1_706_745_600_000))) / float(DAY_MS)).alias("idle_days"), "strength")
    best = best_match(e.filter("id % 20 = 0"), e, others=True)
    return route(best.join(m, "match"))


def stale_vectors_dropped(spark, d):
    """Vectors that a migration to the current model keeps, and those that it drops, by model."""
    e = read_table(spark, d, "memory_embeddings").select("memory_id", "model").distinct()
    return e.groupBy("model").agg(F.count_if(c("model") == "memvec-base-2").alias("kept"), F.count_if(F.coalesce(c("model") != "memvec-base-2", F.lit(True))).alias("dropped"))


def json_result(spark, d):
    """Retrieval results as JSON, numbers with two decimals."""
    m = f_memories(spark, d).select("id", F.round("s", 2).alias("similarity"), F.round("b", 2).alias("base_level"))
    return m.select("id", F.to_json(F.struct("id", "similarity", "base_level")).alias("json")).select("id", F.get_json_object("json", "$.similarity").cast("double").alias("similarity"), F.get_json_object("json", "$.base_level").cast("double").alias("base_level"))


def time_formats(spark, d):
    """Milliseconds as seconds, as ISO text and as a day, and a preview of 50 characters."""
    m = own(spark, d, "memories").filter("created_at is not null")
    at = F.timestamp_millis("created_at")
    return m.select("id", (c("created_at") / 1000.0).alias("seconds"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.substring("content", 1, 50).alias("preview"))


def array_helpers(spark, d):
    """Tags without repeats, whether one is among them, and the first two."""
    m = own(spark, d, "memories").select("id", F.from_json("tags", "array<string>").alias("t")).filter("t is not null")
    one = F.array_distinct("t")
    return m.select("id", F.size(one).alias("n"), F.coalesce(F.array_contains(one, "perf"), F.lit(False)).alias("perf"), F.array_join(F.slice(one, 1, 2), ",").alias("two"))


def sql_functions(spark, d):
    """The column functions called by their names in SQL."""
    register(spark)
    return spark.sql(
        """select id, round(mem_cubed(s), 6) p, round(mem_combined(b, mem_cubed(s), 0.0D, emotion), 6) total, round(mem_probability(mem_cubed(s), 0.3D, 0.1D), 6) probability,
        round(mem_familiarity(accesses), 6) familiarity, round(mem_latency(s), 6) latency, round(mem_noise(strength), 6) noise, mem_zone(1 - s, 0.1D, 0.55D) zone, round(mem_reinforced(strength), 6) reinforced from {m}""",
        m=f_memories(spark, d),
    )


QUERIES = {f.__name__: f for f in (memory_lookup, project_lookup, project_upsert, record_access, associate_upsert, dissociate, update_strengths, decay_candidates, association_step, micro_consolidation, state_transitions, prp_modifier, store_visual, reconsolidation_routes, stale_vectors_dropped, json_result, time_formats, array_helpers, sql_functions)}
QUERIES["working_memory"] = working_memory_now

_M = f"with m as {own_sql('memories', 'type, content, created_at, last_accessed, access_count, emotional_weight, project_id, encoding_strength, consolidation_state, last_consolidated, source, tags')} "
_P = r"nullif(lower(regexp_replace(project_id, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g')), '')"
_R = f"with {F_EDGES}, r as (select src, dst, w strength, case when src % 4 <> 0 then {NOW} - dst * 60000 end last_reinforced from edges) "
_KEEP = f"case when last_reinforced is null or {NOW} - last_reinforced < 0 then strength else strength * exp(-(({NOW} - last_reinforced) / 86400000.0::double) / (1 / 24.0::double)) end"
_IDLE = f"({NOW} - coalesce(last_accessed, created_at))"
_DAYS = "((1706745600000 - coalesce(\"last\", 1706745600000)) / 86400000.0::double)"
ORACLES = {
    "memory_lookup": _M + "select id, type, consolidation_state from m where type = 'bug' and consolidation_state = 'reconsolidating'",
    "project_lookup": f"select id, path from {own_sql('projects', 'path')} where path like '/home/dev/corran-index%'",
    "project_upsert": _M + f", p as (select path, min(id) id, max(last_active) last_active from {own_sql('projects', 'path, last_active')} where path is not null group by 1), w as (select distinct '/home/dev/' || lower(source) || '-' || (length(id) + access_count) path from m union select path from p where path like '%7') select coalesce(p.path, w.path) path, id is not null known, case when w.path is not null then {NOW} else last_active end last_active from p full join (select * from w where path is not null) w on p.path = w.path",
    "record_access": _M + f", h as (select memory_id, count(*) n, max(accessed_at) l from {own_sql('access_history', 'memory_id, accessed_at')} where accessed_at <= {NOW} group by 1) select id, coalesce(access_count, 0) + coalesce(n, 0) access_count, greatest(last_accessed, l) last_accessed from m left join h on id = memory_id",
    "associate_upsert": f"with {F_EDGES} select src, dst, round(case when src % 3 = 0 then w * 0.5 else w end, 6) w, case when src % 3 = 0 then 2 else 1 end n from edges",
    "dissociate": f"with {F_EDGES} select src, dst, round(w, 6) w from edges where (src + dst) % 5 <> 0",
    "update_strengths": f"with {F_EDGES} select src, dst, round(case when src % 10 = 1 then 0.42::double else w end, 6) w from edges",
    "decay_candidates": _R + "select src, dst, last_reinforced from r where last_reinforced is not null",
    "association_step": _R + f", k as (select src, dst, strength, {_KEEP} a from r), f as (select src, dst, case when abs(a - strength) > 0.001 then a else strength end s from k) select src, dst, round(s, 6) strength from f where s >= 0.1",
    "micro_consolidation": _M + f"select id, round(case when {_IDLE} <= 1800000 then least(encoding_strength * 1.1, 1) when {_IDLE} > 604800000 and encoding_strength > 0.1 then greatest(encoding_strength * 0.98, 0.1) else encoding_strength end, 6) strength from m",
    "state_transitions": _M + f"select id, case when consolidation_state in ('fresh', 'consolidating') and {NOW} - created_at > 86400000 then 'consolidated' when consolidation_state = 'fresh' and {NOW} - created_at > 3600000 then 'consolidating' when consolidation_state = 'reconsolidating' and {NOW} - last_consolidated > 86400000 then 'consolidated' else consolidation_state end state from m",
    "prp_modifier": _M + ", g as (select id, created_at t, least((emotional_weight - 0.7) * 1.67, 0.5) s from m where emotional_weight >= 0.7 and created_at is not null), x as (select m.id, max(s * pow(0.5::double, (created_at - t) / 5400000.0::double)) b from m left join g on (t < created_at or (t = created_at and g.id < m.id)) and t > created_at - 86400000 where created_at is not null group by 1) select id, round(case when b >= 0.01 then b else 0 end, 6) boost from x",
    "working_memory": _M + f", h as (select {_P} project, m.id, accessed_at t from {own_sql('access_history', 'memory_id, accessed_at')} a join m on m.id = memory_id where accessed_at <= {NOW}), l as (select *, max(t) over (partition by project) top from h where project is not null), u as (select project, id, max(t) \"at\" from l where top - t <= 20000 group by 1, 2) select project, id, \"at\", row_number() over (partition by project order by \"at\" desc, id) k from u qualify k <= 7",
    "store_visual": f"select id, coalesce(emotional_valence, 0) valence, coalesce(emotional_arousal, 0.5) arousal, coalesce(significance, 0.5) significance, coalesce(source, 'direct') source, coalesce(received_at, created_at) first_access from {own_sql('visual_memories', 'emotional_valence, emotional_arousal, significance, source, received_at, created_at')}",
    "reconsolidation_routes": f"with {F_MEM}, s as (select a.vec_id id, b.vec_id o, {sql_cosine('a.embedding', 'b.embedding')} s from embeddings a, embeddings b where a.vec_id % 20 = 0 and b.vec_id <> a.vec_id), k as (select * from s qualify row_number() over (partition by id order by round(s, 12) desc, o) = 1), j as (select k.id, o, k.s, least(1, (1 - k.s) / (0.5 + 0.01 * {_DAYS} + 0.2 * strength)) e, 0.1 + 0.05 * least({_DAYS}, 5) low, greatest(0.55 - 0.15 * least(accesses / 5.0::double, 3), 0.1 + 0.05 * least({_DAYS}, 5) + 0.05) high from k join mem on mem.id = o) select id, case when s >= 0.4 then o end \"match\", case when s < 0.4 then 'new_trace' when e < low then 'reinforce' when e < high then 'reconsolidate' else 'new_trace' end zone from j",
    "stale_vectors_dropped": "select model, count(*) filter (where model = 'memvec-base-2') kept, count(*) filter (where model is distinct from 'memvec-base-2') dropped from (select distinct memory_id, model from memory_embeddings) group by 1",
    "json_result": f"with {F_MEM} select id, round(s, 2) similarity, round(b, 2) base_level from mem",
    "time_formats": _M + "select id, created_at / 1000.0::double \"seconds\", strftime(epoch_ms(created_at), '%Y-%m-%dT%H:%M:%S.') || lpad((created_at % 1000)::varchar, 3, '0') || 'Z' iso, strftime(epoch_ms(created_at), '%Y-%m-%d') \"day\", substring(content, 1, 50) preview from m where created_at is not null",
    "array_helpers": _M + ", t as (select id, json_extract_string(tags, '$[*]') t from m where json_valid(tags) and tags like '[%'), u as (select id, list_filter(t, lambda x, i: list_position(t, x) = i) one from t) select id, len(one)::int n, coalesce(list_contains(one, 'perf'), false) perf, array_to_string(one[1:2], ',') two from u",
    "sql_functions": f"with {F_MEM} select id, round(s * s * s, 6) p, round(s * s * s * (1 + emotion - 0.5) * (1 + least(greatest((b + 10) / 10, 0), 1)), 6) total, round(1 / (1 + exp((0.3 - s * s * s) / 0.1)), 6) probability, round(1 - 1 / (1 + 0.1 * accesses), 6) familiarity, round(exp(-s) * 1000, 6) latency, round(0.25 * (2 - strength), 6) noise, case when 1 - s < 0.1 then 'reinforce' when 1 - s < 0.55 then 'reconsolidate' else 'new_trace' end zone, round(least(1, strength + 0.05), 6) reinforced from mem",
}
