"""Streams that run until their source is empty, for queries that return a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import new_path
from quire.streaming import incremental


def run_seen_keys(spark: SparkSession, folder: str) -> DataFrame:
    scratch = new_path(spark, "stream")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # A pattern, as a plain path would have to be a folder; the table may also be a single file.
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    keys = incremental.seen_key_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "60 days").select("user_id")
    keys.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{scratch}/out")


def run_sweep(spark: SparkSession, folder: str) -> DataFrame:
    scratch, source = new_path(spark, "stream"), f"{folder}/pages.parquet"
    schema = spark.read.parquet(source).schema
    for _ in range(2):  # the second sweep finds nothing new
        incremental.sweep(spark, f"{folder}/pages.parque[t]", schema, f"{scratch}/out", f"{scratch}/state", work=lambda s: s.select("page_id", "url")).awaitTermination()
    return spark.read.schema("page_id long, url string").parquet(f"{scratch}/out")
