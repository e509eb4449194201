"""Registration of queries and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modelloom.sources import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load_table(self.spark, f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""

    def register(make: Callable[[Tables], DataFrame]):
        name = make.__name__
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return make

    return register


def split_sql(table: str, key: str, share: float = 0.7, seed: int = 123) -> str:
    """Common table expressions ``train`` and ``test`` of the keyed random split."""
    return f"""
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))) AS rank_no
      FROM {table}),
    bound AS (SELECT round_even(count(*) * CAST({share} AS DOUBLE), 0) AS n FROM {table}),
    train AS (SELECT ranked.* EXCLUDE (rank_no) FROM ranked, bound WHERE rank_no <= n),
    test AS (SELECT ranked.* EXCLUDE (rank_no) FROM ranked, bound WHERE rank_no > n)"""
