"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process, as in local tests.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"

#: ASCII white space, as every word and normalisation rule here defines it.
SPACE = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A standard table.  One that its scan reads in fewer tasks than there are cores is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    wanted = spark.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= wanted else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share; one of our own only where driver and tasks are one process."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINT_DIR


def _at(spark: SparkSession, path: str) -> tuple:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, whose files go when the driver's file system is closed."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    system, jvm_path = _at(spark, path)
    system.deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders of ``by``, and read it back.

    Cuts the lineage without depending on any executor staying alive, and gives the planner real file sizes, so that
    a later join broadcasts the table only while it is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialise` that nothing will read any more: all that came of them is written itself."""
    for table in tables:
        if path := getattr(table, "_quire_path", None):
            system, jvm_path = _at(table.sparkSession, path)
            system.delete(jvm_path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of an Arrow batch between Spark and its Python workers.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: ten thousand documents in one take off-heap memory that no task accounts for.

    The setting is read when a plan is made, which may be after an operator returns, so it stays with the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None]) -> None:
    """Called where worker code begins: what code of other owners keeps in this process is let go.

    Workers outlive their stage and are used again by the next one, so tables and caches of earlier operators would add up.
    """
    others = [o for o in _HELD if o != owner]
    for other in others:
        _HELD.pop(other)()
    _HELD[owner] = release
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of so many rows, so that a worker holds few of them as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
