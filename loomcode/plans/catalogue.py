"""The registered core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomcode.plans import code, flow_queries, search, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search.QUERIES, **code.QUERIES, **flow_queries.QUERIES, **state.QUERIES}
SQL: dict[str, str] = {**search.SQL, **code.SQL, **flow_queries.SQL, **state.SQL}
