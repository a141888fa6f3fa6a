"""Connected components by hooking and contraction, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), the smallest node of its component, for every node on an edge.

    Each round every label hooks onto its smallest neighbour, chains of hooks are followed by joins that double
    their reach, and edges within a label go. Stars, however large, take one round; paths take about log(length).
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while left.head(1):
        hooks = written(left.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("root")))
        while True:
            far = hooks.select(F.col("label").alias("root"), F.col("root").alias("far"))
            longer = written(hooks.join(far, "root", "left").select("label", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
            forget(hooks)
            hooks = longer
            if not hooks.filter("moved").head(1):
                break
            hooks = hooks.drop("moved")
            hooks._written = longer._written
        to = hooks.select("label", "root")
        new = written(labels.join(to, labels.component == to.label, "left").select("node", F.coalesce("root", "component").alias("component")))
        forget(labels)
        labels = new
        first, second = to.toDF("a", "ra"), to.toDF("b", "rb")
        moved = left.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        new = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
        forget(left)
        forget(hooks)
        left = new
    return labels
