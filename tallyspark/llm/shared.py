"""Results kept between jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and driver and tasks are one process, as in tests, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyspark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written to the shared folder: lineage ends there, and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/tallyspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    for tables in _kept:
        tables.append(out)
    return out


_kept: list[list[DataFrame]] = []


@contextmanager
def tables_of():
    """The list of the tables written within, for a caller that forgets them once its own result is written."""
    _kept.append([])
    try:
        yield _kept[-1]
    finally:
        _kept.pop()


def forget(df: DataFrame) -> None:
    """Delete the table of a written() frame that no later result reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables that one operator needs until its result is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame) -> DataFrame:
        out = written(df)
        self.tables.append(out)
        return out

    def clear(self) -> None:
        while self.tables:
            forget(self.tables.pop())
