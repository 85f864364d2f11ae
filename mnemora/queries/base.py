"""Domain tables made from the test tables, in DataFrames and, for the oracles, in SQL.

Two sets: ``f_*`` over embeddings, documents and events (integer ids), and the project's own tables, of which each
record counts once however often it was delivered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.activation import base_level
from mnemora.functions.vector import cosine
from mnemora.operators.sessions import clean_key
from mnemora.sources.shared import read_table

#: Clocks: 2024-02-01 for the integer set, 2024-04-01 for the project's tables (UTC).
NOW_F, NOW = 1_706_745_600_000, 1_711_929_600_000
PROBE = 7

#: Columns of the project's tables by key.
KEYS = {"memories": ["id"], "access_history": ["id"], "visual_memories": ["id"], "frame_candidates": ["video_id", "frame_number"], "projects": ["id"]}


def own(spark: SparkSession, d: str, table: str) -> DataFrame:
    """One row for each key; where deliveries differ, the greatest value counts."""
    df = read_table(spark, d, table)
    key = KEYS[table]
    return df.groupBy(*key).agg(*[F.max(c).alias(c) for c in df.columns if c not in key])


def own_sql(table: str, columns: str) -> str:
    key = KEYS[table]
    rest = [c.strip() for c in columns.split(",") if c.strip() not in key]
    return f"(select {', '.join(key)}, {', '.join(f'max({c}) {c}' for c in rest)} from {table} group by {', '.join(key)})"


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def f_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def f_probe(spark: SparkSession, d: str) -> DataFrame:
    return f_embeddings(spark, d).filter(F.col("id") == PROBE).select(F.col("v").alias("pv"))


def f_history(spark: SparkSession, d: str) -> DataFrame:
    n = f_embeddings(spark, d).agg(F.count("*").alias("n"))
    events = read_table(spark, d, "events").select("event_id", millis("ts").alias("t"))
    return events.crossJoin(F.broadcast(n)).select((F.col("event_id") % F.col("n")).alias("id"), "t")  # one row on the right


def f_memories(spark: SparkSession, d: str) -> DataFrame:
    """id, content, type, emotion, project, strength, s (cosine to the probe), b, accesses, last, first."""
    e = f_embeddings(spark, d)
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    h = f_history(spark, d).groupBy("id").agg(base_level(NOW_F - F.col("t")).alias("b"), F.count("*").alias("accesses"), F.max("t").alias("last"), F.min("t").alias("first"))
    kinds = F.array(*[F.lit(x) for x in ("learning", "decision", "context", "bug", "solution", "conversation")])
    df = e.join(docs, "id", "left").join(h, "id", "left").crossJoin(F.broadcast(f_probe(spark, d)))  # one probe
    return df.select(
        "id", F.coalesce("content", F.lit("")).alias("content"), F.get(kinds, (F.col("id") % 6).cast("int")).alias("type"), ((F.col("id") % 11) / 10.0).alias("emotion"), F.col("label").alias("project"),
        (0.3 + 0.7 * (F.col("id") % 8) / 7.0).alias("strength"), cosine(F.col("v"), F.col("pv")).alias("s"), F.coalesce("b", F.lit(-10.0)).alias("b"),
        F.coalesce("accesses", F.lit(0)).alias("accesses"), "last", "first",
    )


def f_edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, w, bw: two associations of every vector, without loops."""
    e = f_embeddings(spark, d).select("id")
    n = e.agg(F.count("*").alias("n"))
    e = e.crossJoin(F.broadcast(n))
    both = e.select("id", ((7 * F.col("id") + 1) % F.col("n")).alias("dst")).union(e.select("id", ((3 * F.col("id") + 2) % F.col("n")).alias("dst")))
    w = 0.1 + 0.8 * (F.col("id") % 10) / 9.0
    return both.filter(F.col("id") != F.col("dst")).distinct().select(F.col("id").alias("src"), "dst", w.alias("w"), (0.5 * w).alias("bw"))


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double))"


def sql_cosine(a: str, b: str) -> str:
    return f"({sql_dot(a, b)} / (sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)})))"


F_EDGES = """e_ as (select vec_id id from embeddings), n_ as (select count(*) n from embeddings),
edges as (select distinct id src, dst, 0.1::double + 0.8::double * (id % 10) / 9.0::double w, 0.5::double * (0.1::double + 0.8::double * (id % 10) / 9.0::double) bw from (
  select id, (7 * id + 1) % n dst from e_, n_ union all select id, (3 * id + 2) % n from e_, n_) where id <> dst)"""

F_MEM = f"""p_ as (select embedding pv from embeddings where vec_id = {PROBE}),
nn_ as (select count(*) n from embeddings),
h as (select event_id % (select n from nn_) id, epoch_us(ts) // 1000 t from events),
hb as (select id, ln(sum(pow(greatest(({NOW_F} - t) / 1000.0::double, 1.0::double), -0.5::double))) b, count(*) accesses, max(t) last, min(t) first from h group by id),
mem as (select vec_id id, coalesce(text, '') content, (['learning','decision','context','bug','solution','conversation'])[vec_id % 6 + 1] type,
  (vec_id % 11) / 10.0::double emotion, label project, 0.3::double + 0.7::double * (vec_id % 8) / 7.0::double strength,
  {sql_cosine('embedding', 'pv')} s, coalesce(hb.b, -10.0::double) b, coalesce(hb.accesses, 0) accesses, hb.last, hb.first
  from embeddings left join documents on vec_id = doc_id left join hb on hb.id = vec_id, p_)"""
