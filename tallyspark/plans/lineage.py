"""Where lineage is cut, and what may be broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder that spark.checkpoint.dir names; where it is unset, only one process may do without."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="tallyspark-checkpoints-"))
    return df.checkpoint()


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be broadcast, once it is found to have no more than so many rows."""
    if len(df.limit(most + 1).select(F.lit(1)).collect()) > most:
        raise ValueError(f"more than {most} rows are too many to broadcast")
    return F.broadcast(df)


#: Rows of a part, where rows are dealt out so that what one task holds doesn't grow with their table.
PART = 250_000


def parts(spark: SparkSession, rows: int) -> int:
    """Into how many parts so many rows are dealt: one for each shuffle partition, more where those would have over PART rows on average."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))


def numbered_in_order(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a number from 0 in a total order: ranges of the order are numbered apart, each from where the one before ends."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    ends, at = [], 0
    for part, n in sorted(map(tuple, placed.groupBy("_part").count().collect())):  # a row for each partition
        ends += [F.lit(part), F.lit(at)]
        at += n
    if not ends:
        return df.withColumn(name, F.lit(None).cast("long"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn(name, (F.element_at(F.create_map(*ends), F.col("_part")) + place).cast("long")).drop("_part")
