"""The table of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schemas import PostProcessConfig, PseudoLabelConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RATE = 0.5
CFG = PostProcessConfig(frame_rate=RATE)
PCFG = PseudoLabelConfig(frame_rate=RATE, vote_s=18.0, min_sustained=0.16)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
