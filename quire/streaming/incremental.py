"""Incremental work: seen keys, swept folders, resumed indexes.  Each stream has a batch twin with the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unseen(batch: DataFrame, seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key that is not among the seen ones; rows without a key never pass."""
    from quire.operators.relational import first_wins

    new = batch.where(F.col(key).isNotNull()).join(seen.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return first_wins(new, [key], order)


def seen_key_stream(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within ``delay``: state is one key, and goes when the watermark passes it.  A key that comes again later
    passes again; :func:`unseen_stream` lets it pass once for ever."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sweep(spark, folder: str, schema, out: str, checkpoint: str, format: str = "parquet", work=None, **options) -> StreamingQuery:
    """Handles each file of a folder once, now and in any later call with the same checkpoint: the first sweep and the watch
    are one query.  Files are to be moved into the folder when they are whole."""
    stream = spark.readStream.format(format).schema(schema).options(**options).load(folder)
    stream = work(stream) if work else stream
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """n a window and key; late rows count until the watermark passes their window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


#: Folders of an index are named by this.
GENERATION = "generation"


def current(spark: SparkSession, index: str, key: str, before: int | None = None) -> DataFrame | None:
    """The rows of an index as it is, or was before a generation: of each key the latest, without those that were taken out."""
    from quire.sources.readers import exists

    if not exists(spark, index):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(index)
    rows = rows if before is None else rows.where(F.col(GENERATION) < before)
    latest = rows.groupBy(F.col(key).alias("__key")).agg(F.max(GENERATION).alias("__latest"))
    # Keys are unique within a generation.
    return rows.join(latest, (F.col(key) == F.col("__key")) & (F.col(GENERATION) == F.col("__latest"))).where("NOT __gone").drop("__key", "__latest", "__gone")


def put(spark: SparkSession, index: str, batch: DataFrame, key: str, version: str, generation: int, order: list[str] | None = None) -> DataFrame | None:
    """Writes what is new or changed of a batch as a generation of its own, and returns the index before it.

    A generation reads only earlier ones and replaces only itself, so an attempt that failed or is made again, and a lost
    executor, change nothing that anything reads.  Rows whose version is known stay where they are; of repeated keys in a batch
    the last in ``order`` (the version, if none is given) counts; rows without a key are left out.
    """
    last = F.struct(*(order or [version]), *(c for c in batch.columns if c not in (order or [version])))
    one = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*batch.columns), last).alias("r")).select("r.*")
    old = current(spark, index, key, generation)
    if old is not None:
        known = old.select(F.col(key).alias("__key"), F.col(version).alias("__version"))
        one = one.join(known, (F.col(key) == F.col("__key")) & F.col(version).eqNullSafe(F.col("__version")), "left_anti")
    one.withColumn("__gone", F.lit(False)).write.mode("overwrite").parquet(f"{index}/{GENERATION}={generation}")
    return old


def resync(spark: SparkSession, index: str, listing: DataFrame, key: str, version: str, generation: int) -> None:
    """Brings an index up to a full listing: as :func:`put`, and keys that are no longer listed are taken out."""
    old = put(spark, index, listing, key, version, generation)
    if old is not None:
        gone = old.join(listing.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
        gone.drop(GENERATION).withColumn("__gone", F.lit(True)).write.mode("append").parquet(f"{index}/{GENERATION}={generation}")


def _first_generation(spark: SparkSession, index: str, checkpoint: str) -> int:
    """The generation of a stream's first batch: after all that were there when the stream first began."""
    from quire.sources.readers import exists
    from quire.sources.scratch import write_text

    note = f"{checkpoint}-first-generation"
    if not exists(spark, note):
        there = spark.read.parquet(index).agg(F.max(GENERATION)).first()[0] if exists(spark, index) else None
        write_text(spark, note, str(0 if there is None else there + 1))
    return int(spark.read.text(note).first()[0])


def resume_index(stream: DataFrame, index: str, checkpoint: str, key: str, version: str, order: list[str] | None = None) -> StreamingQuery:
    """Keeps an index current: each batch is a generation; a batch that is run again after a failure replaces its own."""
    first = _first_generation(stream.sparkSession, index, checkpoint)
    merge = lambda batch, n: put(batch.sparkSession, index, batch, key, version, first + n, order) and None
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen_stream(stream: DataFrame, index: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Each key once for ever: the first row of a key is kept with its batch, and later ones are known by it."""
    first = _first_generation(stream.sparkSession, index, checkpoint)

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        seen = current(spark, index, key, first + n)
        new = unseen(batch, seen if seen is not None else batch.limit(0), key, order)
        new.withColumn("__gone", F.lit(False)).write.mode("overwrite").parquet(f"{index}/{GENERATION}={first + n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookback(rows: DataFrame, date: str, as_of: Column, days: int = 10) -> DataFrame:
    """Rows of the last days up to ``as_of``."""
    return rows.where(F.col(date).between(F.date_sub(as_of, days), as_of))


def stale(stages: DataFrame, newest_input: str, newest_output: str) -> DataFrame:
    """Stages whose input is newer than their output, or that have none."""
    return stages.where(F.col(newest_output).isNull() | (F.col(newest_input) > F.col(newest_output)))
