"""Tables that several jobs of one operator read again, kept where every executor sees them.

What an operator writes inside ``scratch()`` is deleted when its result is written; the rest when the session ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is made only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scopes = threading.local()


def _open() -> list[list]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are kept inside are deleted at the end, but for those kept with ``stay``."""
    _open().append([])
    try:
        yield
    finally:
        for fs, path in _open().pop():
            fs.delete(path, True)


def folder(spark: SparkSession, name: str, stay: bool = False) -> str:
    """A new place in the shared folder, deleted like a kept table."""
    return _place(spark, name, stay)[0]


def _place(spark: SparkSession, name: str, stay: bool) -> tuple:
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    scopes = _open()[:-1] if stay else _open()
    if scopes:
        scopes[-1].append((fs, at))
    return path, fs, at


def kept(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    stay: the table outlives the innermost scratch() and belongs to the one around it, if any.
    """
    spark = df.sparkSession
    path, fs, at = _place(spark, name, stay)
    df.write.parquet(path)
    fs.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._quire_place = (fs, at)
    return table


def discard(table: DataFrame) -> None:
    """Delete what kept() wrote."""
    fs, at = table._quire_place
    fs.delete(at, True)
