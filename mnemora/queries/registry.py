"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemora.queries import graphs, locations, media, ranking, scalars, sessions, streams, tables, temporal, upkeep

_MODULES = (sessions, scalars, tables, upkeep, graphs, ranking, temporal, locations, media, streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
