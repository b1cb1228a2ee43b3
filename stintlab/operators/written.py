"""Intermediate tables that several uses share, written once where all executors see them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: The folder of a session on one machine that names none.
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own; a cluster
    is asked for it, since its executors don't see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _OWN[0]
    return base.rstrip("/")


def _clear() -> None:
    """Removes what was written, when the driver's Python ends: until then a plan may read it."""
    jvm = SparkContext._jvm
    for path in _WRITTEN if jvm is not None else ():
        # a store that is gone by then, or a session that was cut off, is no reason to fail at the end
        with contextlib.suppress(Exception):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again, so that what follows doesn't work them out for each use."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of sides of any size, neither of which is sent to the driver: rows that an array was spread into are estimated as
    their one row before, so that Spark may broadcast the greater side."""
    return left.hint("merge").join(right, on, how)
