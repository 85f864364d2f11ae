"""One query for each column function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.config import DAY_MS
from mnemora.functions import activation as act
from mnemora.functions import location as loc
from mnemora.functions import visual as vis
from mnemora.functions.text import STOP_WORDS, collapsed, gist, media_path, sentences, tokens
from mnemora.functions.vector import unit
from mnemora.queries.base import F_MEM, NOW, NOW_F, f_embeddings, f_memories, own, own_sql, read_table

r6 = lambda c: F.round(c, 6)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _memory(name: str, columns, sql: str) -> None:
    """A query of expressions over the integer memories, and its SQL select list."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return f_memories(spark, d).select("id", *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = run
    ORACLES[name] = f"with {F_MEM} select id, {sql} from mem"


c = F.col
_memory("cosine_batch", lambda: {"s": r6(c("s"))}, "round(s, 6) s")
_memory("cubed_similarity", lambda: {"p": r6(act.cubed(c("s")))}, "round(s * s * s, 6) p")
_memory("base_level", lambda: {"b": r6(c("b")), "accesses": c("accesses")}, "round(b, 6) b, accesses")
_TOTAL = "(s * s * s * (1 + emotion - 0.5) * (1 + least(greatest((b + 10) / 10, 0), 1)))"
_total = lambda: act.combined(c("b"), act.cubed(c("s")), F.lit(0.0), c("emotion"))
_memory("combined_activation", lambda: {"total": r6(_total())}, f"round({_TOTAL}, 6) total")
_memory("retrieval_probability", lambda: {"core": r6(act.probability(_total(), 0.3, 0.1)), "server": r6(act.probability(_total(), 0.0, 0.25))}, f"round(1 / (1 + exp((0.3 - {_TOTAL}) / 0.1)), 6) core, round(1 / (1 + exp((0.0 - {_TOTAL}) / 0.25)), 6) server")
_memory("retrieval_latency", lambda: {"ms": r6(act.latency_ms(_total()))}, f"round(exp(-{_TOTAL}) * 1000, 6) ms")
_memory("wm_boost", lambda: {"boost": r6(act.working_memory_boost((c("id") * 137 - 500).cast("double")))}, "round(case when id * 137 - 500 < 0 then 1 else 1 + exp(-(id * 137 - 500) / 4000.0::double) end, 6) boost")
_memory("session_decay", lambda: {"rate": act.session_decay(((c("id") * 977_333) % 200_000_000 - 1_000_000).cast("double"))}, "case when (id * 977333) % 200000000 - 1000000 < 0 then 0.5 when (id * 977333) % 200000000 - 1000000 < 1800000 then 0.3 when (id * 977333) % 200000000 - 1000000 < 7200000 then 0.4 when (id * 977333) % 200000000 - 1000000 < 86400000 then 0.45 else 0.5 end::double rate")
_memory("encoding_strength", lambda: {"strength": r6(act.encoding_strength((c("id") % 5) / 4.0, c("emotion"), c("accesses")))}, "round(least(greatest(0.3 + 0.2 * ((id % 5) / 4.0::double) + 0.2 * emotion + 0.3 * least(accesses, 10) / 10.0::double, 0), 1), 6) strength")
_memory("instance_noise", lambda: {"noise": r6(act.instance_noise(c("strength")))}, "round(0.25 * (2 - strength), 6) noise")
_DAYS = f"(({NOW_F} - coalesce(last, {NOW_F})) / 86400000.0::double)"
_days = lambda: (NOW_F - F.coalesce(c("last"), F.lit(NOW_F))) / float(DAY_MS)
_LOW, _HIGH = f"(0.1 + 0.05 * least({_DAYS}, 5))", f"greatest(0.55 - 0.15 * least(accesses / 5.0::double, 3), 0.1 + 0.05 * least({_DAYS}, 5) + 0.05)"
_memory("effective_thresholds", lambda: {"low": r6(act.thresholds(c("accesses"), _days())[0]), "high": r6(act.thresholds(c("accesses"), _days())[1])}, f"round({_LOW}, 6) low, round({_HIGH}, 6) high")
_memory("pe_zone", lambda: {"zone": act.error_zone(1 - c("s"), *act.thresholds(c("accesses"), _days()))}, f"case when 1 - s < {_LOW} then 'reinforce' when 1 - s < {_HIGH} then 'reconsolidate' else 'new_trace' end zone")
_memory("reconsolidation_prob", lambda: {"p": r6(act.reconsolidation_probability(1 - c("s"), 0.1, 0.55))}, "round(1 / (1 + exp(-10 * (abs(1 - s) - 0.1))) * (1 - 1 / (1 + exp(-10 * (abs(1 - s) - 0.55)))), 6) p")
_memory("surprise", lambda: {"surprise": r6(act.surprise(c("s"), _days(), c("strength"))), "labile": act.surprise(c("s"), _days(), c("strength")) > 0.5}, f"round(least(1, (1 - s) / (0.5 + 0.01 * {_DAYS} + 0.2 * strength)), 6) surprise, least(1, (1 - s) / (0.5 + 0.01 * {_DAYS} + 0.2 * strength)) > 0.5 labile")
_memory("project_boost", lambda: {"weight": r6(act.project_boost(c("emotion"), c("project") == 3))}, "round(case when project = 3 then least(emotion + 0.15, 1) else emotion end, 6) weight")
_memory("reinforce_strength", lambda: {"w": r6(act.reinforced(c("strength"))), "prune": c("strength") < 0.35}, "round(least(1, strength + 0.05), 6) w, strength < 0.35 prune")
_memory("filter_by_probability", lambda: {"kept": act.probability(_total(), 0.3, 0.1) >= 0.1}, f"1 / (1 + exp((0.3 - {_TOTAL}) / 0.1)) >= 0.1 kept")
_memory("token_estimate", lambda: {"tokens": tokens(c("content")), "fits": tokens(c("content")) <= 600}, "ceil((length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0)::int tokens, ceil((length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) <= 600 fits")
_memory("familiarity", lambda: {"f": r6(loc.familiarity(c("accesses"))), "known": loc.well_known(loc.familiarity(c("accesses")))}, "round(1 - 1 / (1 + 0.1 * accesses), 6) f, 1 - 1 / (1 + 0.1 * accesses) >= 0.7 known")
_memory("assoc_multiplier", lambda: {"m": loc.multiplier(c("id") % 2 == 0, c("id") % 3 == 0), "strength": r6(loc.association_strength(c("id") % 9, loc.multiplier(c("id") % 2 == 0, c("id") % 3 == 0)))}, "case when id % 2 = 0 and id % 3 = 0 then 5 when id % 2 = 0 then 3 when id % 3 = 0 then 2 else 1 end::double m, round(1 - 1 / (1 + 0.1 * (id % 9) * case when id % 2 = 0 and id % 3 = 0 then 5 when id % 2 = 0 then 3 when id % 3 = 0 then 2 else 1 end), 6) strength")
_memory("consolidation_progress", lambda: {"progress": r6(act.clamp(c("id") * 60_000 / 3_600_000.0, 0.0, 1.0)), "open": c("id") * 60_000 < 3_600_000}, "round(least(greatest(id * 60000 / 3600000.0::double, 0), 1), 6) progress, id * 60000 < 3600000 \"open\"")


def normalize_vec(spark: SparkSession, d: str) -> DataFrame:
    return f_embeddings(spark, d).select("id", F.posexplode(unit(c("v"))).alias("k", "x")).select("id", "k", r6(c("x")).alias("x"))


def association_decay(spark: SparkSession, d: str) -> DataFrame:
    m = own(spark, d, "memories").filter("created_at is not null and encoding_strength is not null")
    return m.select("id", r6(act.association_decay(c("encoding_strength"), NOW - c("created_at"), F.lower("consolidation_state"))).alias("s"))


def gists(spark: SparkSession, d: str) -> DataFrame:
    return own(spark, d, "memories").filter("content is not null").select("id", gist(c("content")).alias("gist"))


def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    m = own(spark, d, "memories").filter("content is not null")
    return m.select("id", F.posexplode(sentences(collapsed(c("content")))).alias("k", "sentence"))


def infer_activity(spark: SparkSession, d: str) -> DataFrame:
    """The activity of each memory: bugs say so outright, contexts say that they don't know, the others leave it open."""
    explicit = F.when(c("type") == "bug", "debugging").when(c("type") == "context", "unknown")
    m = own(spark, d, "memories").select("id", loc.activity(c("content"), F.when(c("source") == "editor", "Edit").when(c("source") == "cli", "Read"), explicit).alias("a"))
    return m.select("id", "a.activity", "a.source", "a.confidence")


def detect_media(spark: SparkSession, d: str) -> DataFrame:
    """Paths in texts that hold them bare, in quotes, or as an address, by turns."""
    path = F.coalesce("original_path", F.lit("nothing"))
    kind = F.length("description") % 3
    shown = F.when(kind == 0, path).when(kind == 1, F.concat(F.lit('"'), F.regexp_replace(path, "/media/", "/my media/"), F.lit('" or x.gif'))).otherwise(F.concat(F.lit("https://files.example"), path, F.lit(" and a.png")))
    v = own(spark, d, "visual_memories").select("id", F.concat(F.lit("look at "), F.coalesce(shown, path), F.lit(" please")).alias("t"))
    return v.select("id", media_path(c("t")).alias("image"), media_path(c("t"), "mp4|mov|avi|mkv|webm|m4v").alias("video"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


def json_safe(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of projects, an empty one where the JSON is broken or null."""
    x = F.from_json("context", "memoryCount int, typesSeen array<string>")
    return own(spark, d, "projects").select("id", F.coalesce(x["memoryCount"], F.lit(0)).alias("count"), F.coalesce(F.array_join(x["typesSeen"], ","), F.lit("")).alias("seen"))


def location_decay(spark: SparkSession, d: str) -> DataFrame:
    m = f_memories(spark, d).select("id", loc.familiarity(c("accesses")).alias("f"), (c("id") % 90).cast("double").alias("days"), (c("id") % 13 == 0).alias("pinned"))
    return m.select("id", r6(loc.decayed(c("f"), c("days"), c("pinned"))).alias("f"))


def render_context(spark: SparkSession, d: str) -> DataFrame:
    m = own(spark, d, "memories")
    return m.select("id", F.format_string("- [%s] %s", F.lower(F.coalesce("type", F.lit("unknown"))), F.coalesce("gist", F.substring(F.coalesce("content", F.lit("")), 1, 50))).alias("line"))


QUERIES |= {"normalize_vec": normalize_vec, "association_decay": association_decay, "gist": gists, "split_sentences": split_sentences, "infer_activity": infer_activity, "detect_media": detect_media, "json_props": json_props, "json_safe": json_safe, "location_decay": location_decay, "render_context": render_context}

_ACT = " ".join(f"when regexp_matches(t, '{'|'.join(w)}') then '{a}'" for a, w, _ in loc.ACTIVITIES)
_CONF = " ".join(f"when regexp_matches(t, '{'|'.join(w)}') then {x}" for _, w, x in loc.ACTIVITIES)
_KW = "regexp_matches(t, '" + "|".join(x for _, w, _ in loc.ACTIVITIES for x in w) + "')"
_IMG, _VID = "jpg|jpeg|png|gif|webp|heic|heif", "mp4|mov|avi|mkv|webm|m4v"
ORACLES |= {
    "normalize_vec": "with e as (select vec_id id, embedding v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) n from embeddings) select id, (i - 1)::int k, round(v[i]::double / n, 6) x from e, range(1, 65) r(i)",
    "association_decay": f"select id, round(encoding_strength * exp(-(({NOW} - created_at) / 86400000.0::double) / case lower(consolidation_state) when 'consolidating' then 1.0::double when 'consolidated' then 30.0::double when 'reconsolidating' then 7.0::double else 1 / 24.0::double end), 6) s from {own_sql('memories', 'created_at, encoding_strength, consolidation_state')} where created_at is not null and encoding_strength is not null",
    "split_sentences": f"with m as (select id, trim(regexp_replace(content, '\\s+', ' ', 'g')) t from {own_sql('memories', 'content')} where content is not null), p as (select id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') s from m) select id, (i - 1)::int k, s[i] sentence from p, lateral (select unnest(range(1, len(s) + 1)) i)",
    "gist": f"with m as (select id, trim(regexp_replace(content, '[\\s\\x{{a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{1680}}\\x{{85}}]+', ' ', 'g')) t from {own_sql('memories', 'content')} where content is not null), p as (select id, t, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from m), f as (select id, t, coalesce(list_filter(s, lambda x: length(x) > 20)[1], s[1]) one from p), w as (select id, one, unnest(regexp_extract_all(lower(t), '\\b[a-z]+\\b')) x, generate_subscripts(regexp_extract_all(lower(t), '\\b[a-z]+\\b'), 1) i from f where length(t) > 150 and length(one) <= 150), k as (select id, x, count(*) n, min(i) i from w where length(x) > 3 and x not in {tuple(sorted(set(STOP_WORDS)))} and not list_contains(regexp_extract_all(lower(one), '\\b[a-z]+\\b'), x) group by 1, 2 having count(*) > 1), g as (select id, string_agg(x, ', ' order by n desc, i) terms from (select * from k qualify row_number() over (partition by id order by n desc, i) <= 3) group by 1) select f.id, case when length(t) <= 150 then t when length(one) <= 150 then one || case when terms is not null and length(one) + length(terms) + 3 <= 150 then ' [' || terms || ']' else '' end else regexp_extract(left(t, 148), '^(.*) ', 1) || '...' end gist from f left join g on g.id = f.id",
    "infer_activity": f"with m as (select id, lower(coalesce(content, '')) t, source s, type = 'bug' e from {own_sql('memories', 'content, source, type')}) select id, case when e then 'debugging' {_ACT} when s = 'cli' then 'reading' when s = 'editor' then 'writing' else 'unknown' end activity, case when e then 'explicit' when {_KW} then 'keyword' when s in ('cli', 'editor') then 'tool' else 'default' end source, case when e then 1.0 {_CONF} when s in ('cli', 'editor') then 0.5 else 0.0 end::double confidence from m",
    "detect_media": f"with w as (select id, coalesce(original_path, 'nothing') p, length(description) % 3 k from {own_sql('visual_memories', 'original_path, description')}), v as (select id, 'look at ' || case when k = 0 then p when k = 1 then '\"' || replace(p, '/media/', '/my media/') || '\" or x.gif' when k = 2 then 'https://files.example' || p || ' and a.png' else p end || ' please' t from w) select id, "
    + ", ".join(f"coalesce(nullif(regexp_extract(t, '\"([^\"]+\\.(?:{x}))\"', 1), ''), nullif(regexp_extract(t, '(https?://[^\\s]+\\.(?:{x}))', 1), ''), nullif(regexp_extract(t, '([^\\s]+\\.(?:{x}))', 1), '')) {n}" for n, x in (("image", _IMG), ("video", _VID)))
    + " from v",
    "json_safe": f"select id, coalesce(case when json_valid(context) then (context->>'$.memoryCount')::int end, 0) count, coalesce(case when json_valid(context) then array_to_string(json_extract_string(context, '$.typesSeen[*]'), ',') end, '') seen from {own_sql('projects', 'context')}",
    "json_props": "select (props->>'$.k')::int k, count(*) n from events group by 1",
    "location_decay": f"with {F_MEM}, l as (select id, 1 - 1 / (1 + 0.1::double * accesses) f, (id % 90)::double old from mem) select id, round(case when id % 13 = 0 or old < 30 then f else greatest(0.1 + case when f > 0.5 then 0.4 * (f - 0.5) else 0 end, f * (1 - 0.1 * (1 - 0.8 * f))) end, 6) f from l",
    "render_context": f"select id, '- [' || lower(coalesce(type, 'unknown')) || '] ' || coalesce(gist, substring(coalesce(content, ''), 1, 50)) line from {own_sql('memories', 'type, gist, content')}",
}
