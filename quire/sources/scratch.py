"""Folders for intermediate files, there for the driver and every executor."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no shared folder and runs in one process, as in local tests.
LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL


def path_of(spark: SparkSession, path: str):
    """A path as the JVM's file systems know it, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    p, system = path_of(spark, path)
    system.deleteOnExit(p)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of configuration or control, written by the driver."""
    p, system = path_of(spark, path)
    out = system.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def lock(spark: SparkSession, path: str, owner: str, stale_seconds: float) -> bool:
    """Takes a collection's lock: a file that only one can create.  A lock that was not renewed for so long is taken over."""
    p, system = path_of(spark, path)
    for _ in range(2):
        try:
            out = system.create(p, False)
            out.write(bytearray(owner.encode()))
            out.close()
            return True
        except Exception as e:  # noqa: BLE001  the JVM's own kinds of "it is there" differ by file system
            if not system.exists(p):
                raise RuntimeError(f"cannot lock {path}") from e
        age = spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - system.getFileStatus(p).getModificationTime()
        if age < stale_seconds * 1000:
            return False
        system.delete(p, False)
    return False


def unlock(spark: SparkSession, path: str, owner: str) -> bool:
    """Gives a lock back, if it is still the owner's."""
    p, system = path_of(spark, path)
    if not system.exists(p) or spark.read.text(path).first()[0] != owner:
        return False
    return bool(system.delete(p, False))
