"""Streaming operators over the test tables; their results equal those of the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.operators.sessions import SessionTable
from mnemora.queries.base import NOW, millis, own_sql, read_table
from mnemora.queries.temporal import episode_sql
from mnemora.sources.shared import new_path
from mnemora.streaming import streams as st

c = F.col


def stream_familiarity(spark, d):
    e = st.read_stream(spark, d, "events")
    a = e.select(c("user_id").cast("string").alias("project"), F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("path"), millis("ts").alias("at"))
    path = new_path(spark, "familiarity")
    st.familiarity_stream(a, path)
    return st.latest_familiarity(spark, path).select("project", "path", "accesses", "last", F.round("familiarity", 6).alias("familiarity"))


def stream_sessions(spark, d):
    e = st.read_stream(spark, d, "events").select(c("user_id").cast("string").alias("key"), millis("ts").alias("at"), c("event_id").cast("string").alias("id"))
    table = SessionTable(spark, new_path(spark, "sessions"))
    st.session_stream(e, table)
    return table.sessions().select("key", "started_at", "ended_at", "events")


def _in_pieces(spark, d, parts=3):
    """The events by time, in so many files: a stream of as many batches."""
    path = new_path(spark, "pieces")
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    for k in range(parts):
        a, b = low + (high - low) * k / parts, low + (high - low) * (k + 1) / parts
        piece = e.filter((c("ts") >= a) & ((c("ts") < b) if k < parts - 1 else F.lit(True)))
        piece.coalesce(1).write.parquet(f"{path}/{k}/events.parquet")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*/events.parquet")


def stream_episodes(spark, d):
    """Episodes over three batches in order of time."""
    e = _in_pieces(spark, d).select(c("user_id").alias("key"), c("event_id").alias("id"), millis("ts").alias("at"))
    path = new_path(spark, "episodes")
    st.episode_stream(e, path)
    return spark.read.parquet(f"{path}/events").groupBy("key", "episode").agg(F.count("*").alias("n"), F.min("at").alias("started"), F.max("at").alias("ended")).drop("episode")


def stream_working_memory(spark, d):
    h = st.read_stream(spark, d, "access_history").filter(f"accessed_at <= {NOW} and memory_id is not null")
    path = new_path(spark, "working")
    st.working_memory_stream(h.select(F.substring("memory_id", 1, 1).alias("key"), c("memory_id").alias("id"), c("accessed_at").alias("at")), path)
    return st.latest_working_memory(spark, path)


def stream_priming(spark, d):
    m = st.read_stream(spark, d, "memories").select(c("created_at").alias("at"), c("emotional_weight").alias("importance"))
    path = new_path(spark, "priming")
    st.priming_stream(m, path)
    return st.priming_at(spark, path).select(F.round("boost", 6).alias("boost"))


def stream_base_level(spark, d):
    h = st.read_stream(spark, d, "access_history").filter("memory_id is not null").dropDuplicates(["id"])
    path = new_path(spark, "levels")
    st.base_level_stream(h, path, NOW)
    return st.latest_base_level(spark, path).select("memory_id", "n", F.round("b", 6).alias("b"))


def stream_hours(spark, d):
    e = st.read_stream(spark, d, "events").select(c("ts").cast("timestamp").alias("ts"), c("event_type").alias("kind"))
    path = new_path(spark, "hours")
    st.hourly_stream(e, path)
    return spark.read.parquet(path).select(F.unix_millis("hour").alias("hour"), "kind", "n")


QUERIES = {f.__name__: f for f in (stream_familiarity, stream_sessions, stream_episodes, stream_working_memory, stream_priming, stream_base_level, stream_hours)}

_EV = "with ev as (select user_id k, event_id id, epoch_us(ts) // 1000 t from events)"
_H = own_sql("access_history", "memory_id, accessed_at")
ORACLES = {
    "stream_familiarity": "select user_id::varchar project, event_type || '/' || (props->>'$.k') path, count(*) accesses, max(epoch_us(ts) // 1000) \"last\", round(1 - 1 / (1 + 0.1::double * count(*)), 6) familiarity from events group by 1, 2",
    "stream_sessions": _EV + ", s as (select *, case when t - lag(t) over (partition by k order by t, id) < 1800000 then 0 else 1 end s from ev), g as (select *, sum(s) over (partition by k order by t, id) g from s) select k::varchar \"key\", min(t) started_at, max(t) ended_at, count(*) events from g group by k, g",
    "stream_episodes": f"with {episode_sql('select user_id k, event_id id, epoch_us(ts) // 1000 t from events')} select k \"key\", count(*) n, min(t) started, max(t) ended from ep group by k, run, part",
    "stream_working_memory": f"with h as (select substring(memory_id, 1, 1) \"key\", memory_id id, accessed_at t from {_H} where accessed_at <= {NOW} and memory_id is not null), l as (select *, max(t) over (partition by \"key\") top from h), u as (select \"key\", id, max(t) \"at\" from l where top - t <= 20000 group by 1, 2) select * from u qualify row_number() over (partition by \"key\" order by \"at\" desc, id) <= 7",
    "stream_priming": "with g as (select least((emotional_weight - 0.7) * 1.67, 0.5) s, created_at t from memories where emotional_weight >= 0.7), x as (select max(s * pow(0.5::double, ((select max(created_at) from memories) - t) / 5400000.0::double)) b from g) select round(case when b >= 0.01 then b else 0 end, 6) boost from x",
    "stream_base_level": f"select memory_id, count(*) n, round(ln(sum(pow(greatest(({NOW} - accessed_at) / 1000.0::double, 1.0::double), -0.5::double))), 6) b from {_H} where memory_id is not null and accessed_at <= {NOW} group by 1",
    "stream_hours": "select epoch_us(date_trunc('hour', ts)) // 1000 \"hour\", event_type kind, count(*) n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minutes group by 1, 2",
}
