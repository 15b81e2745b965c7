"""Registration of queries with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netsift.sources.views import Views, oracle_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, more: str = "") -> Callable:
    """Register ``f(v: Views)``; ``sql`` follows a WITH clause over ``views`` and the common tables ``more``."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            names = views.split()
            ORACLES[name] = (oracle_with(*names, more=more) if names or more else "") + sql
        return f

    return add


# Common tables of the oracles.
SESSIONS = """
s AS (SELECT *, 1 + CAST(sum(CASE WHEN rank_no <= pr THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS BIGINT) AS session_id
  FROM (SELECT *, lag(rank_no) OVER (ORDER BY pos) AS pr FROM flows))"""
BLOCKS = """
b AS (SELECT *, CAST(sum(CASE WHEN offset_no < pr THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS BIGINT) AS block
  FROM (SELECT *, lag(offset_no) OVER (ORDER BY pos) AS pr FROM flows))"""
