"""JSON documents of any shape, parsed once into VARIANT and walked level by level: a level is a table, its children the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.lineage import checkpointed


def nodes(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys, path, depth, name, node) of every value anywhere in a document: its root ($), members of objects by name, elements of arrays by place.

    A round makes one level of all documents; there are as many as the deepest has. Values of one document are rows like any others, so a
    long document needs no task of its own after its first level. Texts that aren't JSON have no nodes.
    """
    level = rows.select(*keys, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), F.try_parse_json(document).alias("node")).filter("node IS NOT NULL")
    levels, tvf = [], rows.sparkSession.tvf
    while True:
        level = checkpointed(level)
        if not level.head(1):
            break
        levels.append(level)
        inner = level.select(*keys, F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("node").alias("_node"))
        met = inner.lateralJoin(tvf.variant_explode(F.col("_node").outer()))
        step = F.when(F.col("key").isNull(), F.format_string("[%d]", "pos")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = met.select(*keys, F.concat("_path", step).alias("path"), (F.col("_depth") + 1).alias("depth"), F.col("key").alias("name"), F.col("value").alias("node"))
    return reduce(DataFrame.unionAll, levels or [level])


def members_named(rows: DataFrame, keys: list[str], document: str, name: str) -> DataFrame:
    """(keys, path, value as JSON) of every member of that name, whatever its value and wherever it stands."""
    return nodes(rows, keys, document).filter(F.col("name") == name).select(*keys, "path", F.to_json("node").alias("value"))


def objects_where(rows: DataFrame, keys: list[str], document: str, member: str, value: Column, fields: dict[str, str]) -> DataFrame:
    """(keys, path, fields) of every object that has a member of that value (as text); fields: the object's members to take, with their types. A member that doesn't fit its type is null."""
    of = lambda name, kind: F.try_variant_get("node", f"$['{name}']", kind)
    return nodes(rows, keys, document).filter(of(member, "string") == value).select(*keys, "path", *(of(c, kind).alias(c) for c, kind in fields.items()))
