"""Queries of ranked retrieval for many probes at once, as the server refines it, and over pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.config import CORE, SERVER
from mnemora.functions import activation as act
from mnemora.functions import visual as vis
from mnemora.functions.text import tokens
from mnemora.functions.vector import cosine, usable
from mnemora.operators.episodes import episodes, links
from mnemora.operators.retrieval import context_with_visuals, retrieve_batch, retrieve_server, retrieve_visual, within_budget
from mnemora.operators.similarity import top_matches
from mnemora.queries.base import F_EDGES, NOW, NOW_F, PROBE, f_edges, f_embeddings, f_history, f_memories, millis, own, own_sql, read_table, sql_cosine, sql_dot

c = F.col
r6 = lambda x: F.round(x, 6)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def f_probes(spark, d):
    """Every vector whose id is divisible by 20."""
    return f_embeddings(spark, d).filter("id % 20 = 0").select("id", "v")


def f_vectors(spark, d):
    m = f_memories(spark, d).select("id", "b", "emotion", "strength", "type", "content", "last")
    return m.join(f_embeddings(spark, d).select("id", "v"), "id")


def _shape(df):
    return df.select("probe", "id", r6(c("total")).alias("total"), r6(c("probability")).alias("probability"), "rank")


def f_links(spark, d):
    """Links of memories: those of the events that accessed them (5 minutes, 50 events), loops left out."""
    e = read_table(spark, d, "events").select(c("user_id").alias("key"), c("event_id").alias("id"), millis("ts").alias("at"))
    n = f_embeddings(spark, d).agg(F.count("*").alias("n"))
    p = links(episodes(e)).crossJoin(F.broadcast(n))  # one row on the right
    return p.select((c("src") % c("n")).alias("src"), (c("dst") % c("n")).alias("dst"), "distance", "forward", "backward").filter("src <> dst")


def f_session(spark, d):
    """Memories accessed within 30 minutes before the last event."""
    h = f_history(spark, d)
    last = h.agg(F.max("t").alias("last"))
    return h.crossJoin(F.broadcast(last)).filter("t >= last - 1800000").select("id").distinct()  # one row on the right


def retrieve_many(spark, d):
    """The ten best memories of each probe, without spread."""
    return _shape(retrieve_batch(f_probes(spark, d), f_vectors(spark, d)))


def retrieve_many_spreading(spark, d):
    return _shape(retrieve_batch(f_probes(spark, d), f_vectors(spark, d), f_edges(spark, d)))


def retrieve_typed(spark, d):
    """Only memories of one type are candidates, seeds and stations of the spread."""
    return _shape(retrieve_batch(f_probes(spark, d), f_vectors(spark, d).filter("type = 'decision'"), f_edges(spark, d)))


def server_many(spark, d):
    out = retrieve_server(f_probes(spark, d), f_vectors(spark, d), f_edges(spark, d), f_links(spark, d), f_session(spark, d))
    return out.select("probe", "id", r6(c("score")).alias("score"), r6(c("probability")).alias("probability"), "rank")


def m_vectors(spark, d):
    """The project's memories with an undamaged vector of 64 numbers: id, v, b of their accesses up to now, emotion."""
    v = read_table(spark, d, "memory_embeddings").filter("dimensions = 64").filter(usable(c("vector"), 64)).groupBy("memory_id").agg(F.max("vector").alias("v"))
    h = own(spark, d, "access_history").filter(f"accessed_at <= {NOW}").groupBy("memory_id").agg(act.base_level(NOW - c("accessed_at")).alias("b"))
    m = own(spark, d, "memories").select("id", c("emotional_weight").alias("emotion"))
    return v.join(h, "memory_id", "left").withColumnRenamed("memory_id", "id").join(m, "id")


def retrieve_all(spark, d):
    """Every memory as a probe for all of them: the ten best of each."""
    m = m_vectors(spark, d)
    return _shape(retrieve_batch(m.select("id", "v"), m))


def naive_topk(spark, d):
    """The ten most similar memories of each probe by cosine alone."""
    return top_matches(f_probes(spark, d), f_embeddings(spark, d), 10).select(c("query").alias("probe"), "id", r6(c("s")).alias("s"), "rank")


def rag_budget(spark, d):
    """Of each probe the most similar texts, in chunks of at most 256 tokens, that fit in 2,000 tokens."""
    top = top_matches(f_probes(spark, d), f_embeddings(spark, d), 10).join(f_vectors(spark, d).select("id", "content"), "id")
    size = F.length("content")
    chunks = top.select(c("query").alias("probe"), "id", "rank", size.alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / 1024.0) - 1, F.lit(0)).cast("int"))).alias("chunk"))
    t = F.ceil(F.least(c("size") - c("chunk") * 1024, F.lit(1024)) / 4.0).cast("int")
    from pyspark.sql import Window

    running = F.sum("tokens").over(Window.partitionBy("probe").orderBy("rank", "chunk"))
    return chunks.withColumn("tokens", t).withColumn("running", running).filter("running <= 2000").select("probe", "id", "chunk", "tokens", "running")


def disclosure_layers(spark, d):
    """Three layers of disclosure: of each probe's ten best the gist-sized, the paragraph-sized and the whole text's tokens."""
    top = retrieve_batch(f_probes(spark, d), f_vectors(spark, d)).join(f_vectors(spark, d).select("id", "content"), "id")
    layer = lambda n: F.ceil(F.least(F.length("content"), F.lit(n)) / 4.0).cast("int")
    return top.select("probe", "id", "rank", layer(150).alias("index_tokens"), F.when(c("rank") <= 5, layer(600)).alias("summary_tokens"), F.when(c("rank") <= 2, tokens(c("content"))).alias("full_tokens"))


def v_visuals(spark, d):
    """Pictures with an undamaged vector: id, v, b (of receipt and last access), weight, significance, description."""
    v = own(spark, d, "visual_memories").filter(usable(c("embedding"), 64))
    h = v.select("id", F.explode(F.array_distinct(F.array("received_at", "last_accessed"))).alias("t")).filter(f"t <= {NOW}")
    b = h.groupBy("id").agg(act.base_level(NOW - c("t")).alias("b"))
    weight = F.when(c("emotional_arousal").isNotNull(), vis.emotional_weight(c("emotional_arousal")))
    return v.join(b, "id", "left").select("id", c("embedding").alias("v"), "b", weight.alias("weight"), "significance", F.coalesce("description", F.lit("")).alias("description"), "project_id")


def visual_retrieve(spark, d):
    """The ten best pictures of each probe."""
    out = retrieve_visual(f_probes(spark, d), v_visuals(spark, d))
    return _shape(out).join(out.select("probe", "id", r6(c("similarity")).alias("similarity")), ["probe", "id"])


def v_edges(spark, d):
    """Pictures of one video, each with the next one: src, dst, w, bw."""
    from pyspark.sql import Window

    v = own(spark, d, "visual_memories").filter("video_id is not null and frame_number is not null").select("id", "video_id", "frame_number")
    after = F.lead("id").over(Window.partitionBy("video_id").orderBy("frame_number", "id"))
    return v.select(c("id").alias("src"), after.alias("dst")).filter("dst is not null").select("src", "dst", F.lit(0.8).alias("w"), F.lit(0.4).alias("bw"))


def visual_retrieve_spreading(spark, d):
    """The same with spread along videos; a picture whose vector is damaged passes activation on, but isn't ranked."""
    return _shape(retrieve_visual(f_probes(spark, d), v_visuals(spark, d), v_edges(spark, d)))


def visual_recency(spark, d):
    """Without an embedder pictures are ranked by base level with the session's decay rates."""
    v = own(spark, d, "visual_memories")
    h = v.select("id", F.explode(F.array_distinct(F.array("received_at", "last_accessed"))).alias("t")).filter(f"t <= {NOW}")
    last = h.groupBy("id").agg(F.max("t").alias("last"))
    b = h.join(last, "id").groupBy("id").agg(act.base_level(NOW - c("t"), act.session_decay((NOW - c("last")).cast("double"))).alias("b"))
    return b.orderBy(F.desc(F.round("b", 9)), "id").limit(10).select("id", r6(c("b")).alias("b"), r6(act.probability(c("b"), 0.3, 0.1)).alias("probability"))


def visual_context(spark, d):
    """Notes and pictures within 300 tokens for each probe: ten notes by rank, five pictures, similar by 0.3 or more."""
    probes = f_probes(spark, d)
    m = f_vectors(spark, d)
    top = retrieve_batch(probes, m).select("probe", "id", "rank")
    p = probes.select(c("id").alias("probe"), c("v").alias("pv"))
    short = F.least(F.length("content"), F.lit(150))
    texts = top.join(m.select("id", "v", "content"), "id").join(p, "probe").select("probe", "id", "rank", cosine(c("v"), c("pv")).alias("similarity"), F.ceil(short / 4.0).cast("int").alias("tokens"))
    from dataclasses import replace

    v = v_visuals(spark, d)
    seen = retrieve_visual(probes, v, config=replace(CORE, limit=5)).join(v.select("id", "description"), "id")
    pictures = seen.select("probe", "id", "rank", "similarity", tokens(c("description")).alias("tokens"))
    return context_with_visuals(texts, pictures)


for _f in (retrieve_all, retrieve_many, retrieve_many_spreading, retrieve_typed, naive_topk, rag_budget, disclosure_layers, visual_retrieve, visual_retrieve_spreading, visual_recency):
    QUERIES[_f.__name__] = _f
QUERIES |= {"retrieve_server": server_many, "context_with_visuals": visual_context}

_B = f"(select event_id % (select count(*) from embeddings) id, ln(sum(pow(greatest(({NOW_F} - epoch_us(ts) // 1000) / 1000.0::double, 1.0::double), -0.5::double))) b from events group by 1)"
_MV = f"mv as (select vec_id id, embedding v, (vec_id % 11) / 10.0::double emotion, 0.3::double + 0.7::double * (vec_id % 8) / 7.0::double strength, vec_id % 6 = 1 decision, coalesce(b, -10.0::double) b, coalesce(text, '') content from embeddings left join documents on vec_id = doc_id left join {_B} hb on hb.id = vec_id), q as (select vec_id probe, embedding pv from embeddings where vec_id % 20 = 0)"
_OWN = "(pow(least(s, 1), 3) * (1 + emotion - 0.5) * (1 + least(greatest((b + 10) / 10, 0), 1)))"


def _scored(where: str = "true") -> str:
    return f"{_MV}, sc as (select probe, id, {sql_cosine('v', 'pv')} s, b, emotion, strength, content from mv, q where {where}), ow as (select *, {_OWN} own, pow(least(s, 1), 3) p from sc)"


def _spread_by(depth: int, seeds: str, edges: str, least: float = 0.01) -> str:
    out = f"fo_ as (select src, count(*) f from {edges} group by 1), fi_ as (select dst, count(*) f from {edges} group by 1), l_ as (select e.src id, e.dst too, w / f * 0.7 k from {edges} e join fo_ using (src) union all select e.dst, e.src, bw / f * 0.7 * 0.7 from {edges} e join fi_ using (dst)), s0 as (select probe, id, a, 0 hop from ({seeds}))"
    for h in range(depth):
        out += f", g{h} as (select probe, too id, sum(a * k) more from s{h} join l_ using (id) where hop = {h} and a >= {least} group by 1, 2), s{h + 1} as (select coalesce(s{h}.probe, g{h}.probe) probe, coalesce(s{h}.id, g{h}.id) id, coalesce(a, 0) + coalesce(more, 0) a, coalesce(hop, {h + 1}) hop from s{h} full join g{h} on s{h}.id = g{h}.id and s{h}.probe = g{h}.probe)"
    return out


_SEEDS = "select probe, id, own a from ow where p > 0.1 qualify row_number() over (partition by probe order by round(own, 12) desc, id) <= 5"
_IE = "ie as (select * from edges where src in (select id from ow) and dst in (select id from ow))"


def _total(tau: float, noise: float, limit: int) -> str:
    return f"t as (select *, 1 / (1 + exp(({tau} - total) / {noise})) probability from tt where 1 / (1 + exp(({tau} - total) / {noise})) >= 0.1), k as (select *, row_number() over (partition by probe order by round(total, 12) desc, id) r from t qualify r <= {limit})"


_KEPT = 'select probe, id, round(total, 6) total, round(probability, 6) probability, r "rank" from k'
_PLAIN = "tt as (select *, own total from ow)"
_SPREAD = "tt as (select ow.*, own + coalesce(a, 0) total from ow left join s3 on ow.probe = s3.probe and ow.id = s3.id)"
_EPF = """ev as (select user_id k, event_id id, epoch_us(ts) // 1000 t from events), e1 as (select *, case when t - lag(t) over (partition by k order by t, id) <= 300000 then 0 else 1 end s from ev),
e2 as (select *, sum(s) over (partition by k order by t, id) run from e1), ep as (select *, (row_number() over (partition by k, run order by t, id) - 1) // 50 part, (row_number() over (partition by k, run order by t, id) - 1) % 50 pos from e2),
li as (select a.id % (select count(*) from embeddings) src, b.id % (select count(*) from embeddings) dst, exp(-0.3 * (b.pos - a.pos)) f, 0.7 * exp(-0.3 * (b.pos - a.pos)) bk from ep a join ep b on a.k = b.k and a.run = b.run and a.part = b.part and b.pos > a.pos and b.pos <= a.pos + 10), lm as (select * from li where src <> dst)"""
_VV = f"""vr as {own_sql("visual_memories", "description, embedding, emotional_arousal, significance, received_at, last_accessed, video_id, frame_number")},
vh as (select distinct id, unnest([received_at, last_accessed]) t from vr), vb as (select id, ln(sum(pow(greatest(({NOW} - t) / 1000.0::double, 1.0::double), -0.5::double))) b from vh where t <= {NOW} group by 1),
vv as (select vr.id, embedding v, coalesce(b, -10) b, coalesce(0.5 + least(greatest(emotional_arousal, 0), 1), 1) w, coalesce(significance, 0.5) sig, coalesce(description, '') description from vr left join vb using (id) where len(embedding) = 64 and isfinite({sql_dot('embedding', 'embedding')}) and {sql_dot('embedding', 'embedding')} > 0),
q as (select vec_id probe, embedding pv from embeddings where vec_id % 20 = 0), vs as (select probe, id, b, w emotion, sig, description, {sql_cosine('v', 'pv')} s from vv, q), vo as (select *, {_OWN} + 0.2 * sig + case when w2 > 0.7 then (w2 - 0.7) * 0.3 else 0 end own, (b + pow(least(s, 1), 3)) * (1 + emotion - 0.5) seed from (select *, emotion w2 from vs))"""
_VE = "ve as (select id src, lead(id) over (partition by video_id order by frame_number, id) dst, 0.8::double w, 0.4::double bw from vr where video_id is not null and frame_number is not null), vl as (select * from ve where dst is not null)"
_VSEEDS = "select probe, id, seed a from vo where seed > 0 qualify row_number() over (partition by probe order by round(seed, 12) desc, id) <= 5"
_RATE = "case when a < 0 then 0.5 when a < 1800000 then 0.3 when a < 7200000 then 0.4 when a < 86400000 then 0.45 else 0.5 end"
_CTX = "select probe, '{what}' what, id::varchar id, tokens, running from (select *, sum(tokens) over (partition by probe order by r)::bigint running from {of} where s >= 0.3) where running <= {share}"
ORACLES |= {
    "retrieve_many": f"with {_scored()}, {_PLAIN}, {_total(0.3, 0.1, 10)} {_KEPT}",
    "retrieve_many_spreading": f"with {F_EDGES}, {_scored()}, {_IE}, {_spread_by(3, _SEEDS, 'ie')}, {_SPREAD}, {_total(0.3, 0.1, 10)} {_KEPT}",
    "retrieve_typed": f"with {F_EDGES}, {_scored('decision')}, {_IE}, {_spread_by(3, _SEEDS, 'ie')}, {_SPREAD}, {_total(0.3, 0.1, 10)} {_KEPT}",
    "retrieve_server": f"with {F_EDGES}, {_scored()}, {_IE}, {_spread_by(3, _SEEDS, 'ie')}, {_SPREAD}, {_total(0.0, 0.25, 20)}, {_EPF}, bo as (select k.probe, id, max(a) boost from (select probe, dst id, total * f * 1.2 a from k join lm on k.id = src where r <= 5 union all select probe, src, total * bk * 1.2 from k join lm on k.id = dst where r <= 5 union all select probe, k.id, total from k where r <= 5 and (k.id in (select src from lm) or k.id in (select dst from lm))) k group by 1, 2), se as (select distinct event_id % (select count(*) from embeddings) id from events where epoch_us(ts) // 1000 >= (select max(epoch_us(ts) // 1000) from events) - 1800000), fi as (select k.probe, k.id, (total + coalesce(boost, 0)) * case when k.id in (select id from se) then 1.5 else 1 end score, 1 / (1 + exp((0.0 - total) / (0.25 * (2 - strength)))) probability from k left join bo on bo.probe = k.probe and bo.id = k.id), rk as (select *, row_number() over (partition by probe order by round(score, 12) desc, id) r from fi) select probe, id, round(score, 6) score, round(probability, 6) probability, r \"rank\" from rk where r <= 10",
    "naive_topk": f"with {_scored()}, k as (select *, row_number() over (partition by probe order by round(s, 12) desc, id) r from ow) select probe, id, round(s, 6) s, r \"rank\" from k where r <= 10",
    "rag_budget": f"with {_scored()}, k as (select *, row_number() over (partition by probe order by round(s, 12) desc, id) r from ow qualify r <= 10), ch as (select probe, id, r, chunk, ceil(least(length(content) - chunk * 1024, 1024) / 4.0)::int tokens from k, lateral (select unnest(range(0, greatest(ceil(length(content) / 1024.0)::int, 1)))::int chunk)), v as (select probe, id, chunk, tokens, sum(tokens) over (partition by probe order by r, chunk)::bigint running from ch) select * from v where running <= 2000",
    "disclosure_layers": f"with {_scored()}, {_PLAIN}, {_total(0.3, 0.1, 10)} select probe, id, r \"rank\", ceil(least(length(content), 150) / 4.0)::int index_tokens, case when r <= 5 then ceil(least(length(content), 600) / 4.0)::int end summary_tokens, case when r <= 2 then ceil(length(content) / 4.0)::int end full_tokens from k",
    "visual_retrieve": f"with {_VV}, tt as (select *, own total from vo), {_total(0.3, 0.1, 10)} select probe, id, round(total, 6) total, round(probability, 6) probability, r \"rank\", round(s, 6) similarity from k",
    "visual_retrieve_spreading": f"with {_VV}, {_VE}, {_spread_by(3, _VSEEDS, 'vl')}, tt as (select vo.*, own + coalesce(a, 0) total from vo left join s3 on vo.probe = s3.probe and vo.id = s3.id), {_total(0.3, 0.1, 10)} {_KEPT}",
    "visual_recency": f"with vr as {own_sql('visual_memories', 'received_at, last_accessed')}, vh as (select distinct id, unnest([received_at, last_accessed]) t from vr), x as (select id, t, {NOW} - max(t) over (partition by id) a from vh where t <= {NOW}), y as (select id, ln(sum(pow(greatest(({NOW} - t) / 1000.0::double, 1.0::double), -({_RATE})))) b from x group by 1 order by round(b, 9) desc, id limit 10) select id, round(b, 6) b, round(1 / (1 + exp((0.3 - b) / 0.1)), 6) probability from y",
    "context_with_visuals": f"with {_scored()}, {_PLAIN}, {_total(0.3, 0.1, 10)}, tx as (select probe, id, r, s, ceil(least(length(content), 150) / 4.0)::int tokens from k), {_VV.replace('q as (select vec_id probe, embedding pv from embeddings where vec_id % 20 = 0), ', '')}, vt as (select *, row_number() over (partition by probe order by round(own, 12) desc, id) r from vo where 1 / (1 + exp((0.3 - own) / 0.1)) >= 0.1 qualify r <= 5), vx as (select probe, id, r, s, ceil(length(description) / 4.0)::int tokens from vt) " + _CTX.format(what="text", of="tx", share=210) + " union all " + _CTX.format(what="visual", of="vx", share=90),
}
