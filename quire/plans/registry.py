"""The catalogue of queries over the standard tables: each has a name, a plan, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the table of that name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table that its scan reads in fewer tasks than there are cores, such as one small file, dealt to all of them.  Tables
    of more splits than that stay as they are."""
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= wanted else rows


def query(sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return register
