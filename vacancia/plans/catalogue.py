"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacancia.plans import accounts, details, discovery, ingest, jobs, places, profiles, scalars, sources, state

MODULES = (jobs, state, discovery, scalars, ingest, profiles, accounts, places, details, sources)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
