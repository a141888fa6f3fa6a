"""What a plan does, read from Spark's own explanation: for tests that guard pushdown and shuffles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def explained(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df: DataFrame) -> int:
    """Shuffles of a plan before adaptive changes."""
    return len(re.findall(r"^\(\d+\) Exchange", explained(df), re.M))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", explained(df))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<(.*)>", explained(df))
