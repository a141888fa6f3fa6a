"""Sinks: checked entities, shards, reports, compact payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators import ranges
from tallyspark.operators.gates import require
from tallyspark.plans.lineage import numbered_in_order


def write_entities(rows: DataFrame, schema: T.StructType, path: str, *gates: DataFrame, kind: str = "parquet") -> None:
    """Write rows of just these columns and types once every gate has passed."""
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"expected {schema.simpleString()}, found {rows.schema.simpleString()}")
    if gates:
        require(*gates)
    rows.write.mode("overwrite").format(kind).save(path)


def write_shards(rows: DataFrame, path: str, key: str) -> DataFrame:
    """One folder for each key, those of other keys left alone; the number of rows of each."""
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def with_dictionary(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """rows with numbers in place of a column's values, and the table of both; numbers go by frequency, then value."""
    table = rows.filter(F.col(column).isNotNull()).groupBy(column).count()
    table = numbered_in_order(table, "code", F.desc("count"), F.asc(column)).select(column, F.col("code").cast("int").alias("code"))
    return rows.join(table, column, "left").withColumn(column, F.col("code")).drop("code"), table


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def summary(**counts: DataFrame) -> DataFrame:
    """One row of the numbers of rows of several tables."""
    first, *rest = (df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(0)) for name, df in counts.items())
    for df in rest:
        first = first.join(df, "_k")
    return first.drop("_k")


def encoded(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of a key as a list of positional tuples."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("payload"))


def decoded(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.inline("payload"))


def coded_shards(rows: DataFrame, key: str, coded: list[str], plain: list[str], order: list[str], most: int = 10_000) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Shards of a key as dense arrays, with numbers in place of some columns' values, and a dictionary for each such column.

    The shards: (key, chunk, n, an array for each column); rows stand in a total order, ``most`` at most in a chunk, so that a shard of any size is many rows. The
    dictionaries: (key, code, value, n); codes are dense from 0 within their shard, the commonest value first, then by value, so that small numbers are the common ones.
    Numbers are given by ranges of the order (see ranges.py): no task holds a shard. A null has no code. Columns in ``order`` must be in coded or plain.
    """
    tables = {}
    placed = ranges.numbered(rows.select(key, *dict.fromkeys([*coded, *plain])), [key], order, "_n")
    for c in coded:
        counts = rows.filter(F.col(c).isNotNull()).groupBy(key, F.col(c).alias("value")).agg(F.count("*").alias("n"))
        table = ranges.numbered(counts.withColumn("_less", -F.col("n")), [key], ["_less", "value"], "_code")
        tables[c] = table.select(key, (F.col("_code") - 1).cast("int").alias("code"), "value", "n")
        to = tables[c].select(F.col(key).alias("_key"), F.col("value").alias("_value"), F.col("code").alias("_code"))
        placed = placed.join(to, F.col(key).eqNullSafe(F.col("_key")) & (F.col(c) == F.col("_value")), "left").withColumn(c, F.col("_code")).drop("_key", "_value", "_code")
    columns = list(dict.fromkeys([*coded, *plain]))
    packed = placed.withColumn("chunk", F.expr(f"(_n - 1) div {most}").cast("int")).groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct("_n", *columns))).alias("_rows"))
    return packed.select(key, "chunk", F.size("_rows").alias("n"), *(F.col("_rows").getField(c).alias(c) for c in columns)), tables


def decoded_shards(shards: DataFrame, dictionaries: dict[str, DataFrame], key: str, most: int = 10_000) -> DataFrame:
    """The rows of coded_shards(), with their place (from 0) in their shard's order."""
    columns = [c for c in shards.columns if c not in (key, "chunk", "n")]
    rows = shards.select(key, "chunk", F.posexplode(F.arrays_zip(*columns)).alias("_at", "_row")).select(key, (F.col("chunk").cast("long") * most + F.col("_at")).alias("place"), "_row.*")
    for c, table in dictionaries.items():
        of = table.select(F.col(key).alias("_key"), F.col("code").alias("_code"), F.col("value").alias("_value"))
        rows = rows.join(of, F.col(key).eqNullSafe(F.col("_key")) & (F.col(c) == F.col("_code")), "left").withColumn(c, F.col("_value")).drop("_key", "_code", "_value")
    return rows
