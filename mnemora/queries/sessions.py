"""Queries of the session table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.sessions import SessionTable, clean_key
from mnemora.sources.shared import new_path, read_table


def project_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memories: those before the last three days as one batch, and each of these days as a batch of its own."""
    events = read_table(spark, sf_dir, "memories").select(clean_key(F.col("project_id")).alias("key"), F.col("created_at").alias("at"), "id")
    table = SessionTable(spark, new_path(spark, "sessions"))
    last = events.agg(F.max("at")).first()[0]
    if last is not None:
        day = 86_400_000
        ends = [(last // day - k) * day for k in (2, 1, 0)]
        table.merge(events.filter(F.col("at") < ends[0]))
        for low in ends:
            table.merge(events.filter((F.col("at") >= low) & (F.col("at") < low + day)))
    return table.sessions()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_sessions(spark, sf_dir).select(F.col("key").alias("project_id"), "started_at", "ended_at")


def p6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_sessions(spark, sf_dir).withColumnRenamed("key", "project_id")


_SQL = r"""
with m as (
  select distinct lower(regexp_replace(project_id, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g')) p, created_at t, id
  from memories where created_at is not null and id is not null
), g as (
  select *, case when t - lag(t) over (partition by p order by t, id) < 1800000 then 0 else 1 end s
  from m where p is not null and p <> ''
), n as (
  select *, sum(s) over (partition by p order by t, id) k from g
), u as (
  select p project_id, min(t) started_at, max(t) ended_at, max(t) - min(t) duration_ms, count(*) events from n group by p, k
)
"""

QUERIES = {"p6_found": p6_found, "p6_sessions": p6_sessions}
ORACLES = {
    "p6_found": _SQL + "select project_id, started_at, ended_at from u",
    "p6_sessions": _SQL + "select * from u",
}
