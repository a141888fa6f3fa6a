"""Lanes and clusters packed in parts, against one loop over each group."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import places, ranges

SPANS = "g string, k int, a int, b int"


def plain_lanes(rows):
    by, out = defaultdict(list), {}
    for g, k, a, b in rows:
        if a is not None:
            by[g].append((a, k, math.inf if b is None else b))
    for g, spans in by.items():
        lanes = []
        for a, k, b in sorted(spans):
            at = next((i for i, e in enumerate(lanes) if e <= a), len(lanes))
            lanes[at : at + 1] = [b]
            out[g, k] = at
    return out


def plain_clusters(rows, radius):
    by, out = defaultdict(list), {}
    for g, k, x, y in rows:
        if x is not None and y is not None:
            by[g].append((k, x, y))
    for g, points in by.items():
        sums, of = [], {}
        for k, x, y in sorted(points):
            at = next((i for i, (sx, sy, n) in enumerate(sums) if math.hypot(sx / n - x, sy / n - y) <= radius), len(sums))
            if at == len(sums):
                sums.append([0, 0, 0])
            sums[at] = [sums[at][0] + x, sums[at][1] + y, sums[at][2] + 1]
            of[k] = at
        out |= {(g, k): (at, round(sums[at][0] / sums[at][2], 9), round(sums[at][1] / sums[at][2], 9)) for k, at in of.items()}
    return out


@pytest.mark.parametrize("open_ends", [False, True])
def test_lanes_equal_one_loop(spark, open_ends):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), k, None if rng.random() < 0.03 else (a := rng.randint(0, 2000)), None if open_ends and rng.random() < 0.02 else (a or 0) + rng.choice([0, 1, 5, 60])) for k in range(500)]
    got = {(r["g"], r["k"]): r["lane"] for r in places.packed_lanes(spark.createDataFrame(rows, SPANS), "g", "k", "a", "b").collect()}
    assert got == plain_lanes(rows)
    assert max(got.values()) > 2


def test_a_hot_group_is_packed_in_many_parts(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("g"), F.col("id").cast("int").alias("k"), (F.col("id") * 3).cast("int").alias("a"), (F.col("id") * 3 + 1 + F.col("id") % 7).cast("int").alias("b"))
    sizes = ranges.parts(rows, ["g"], ["a", "k"], "b").groupBy("_of").count().collect()
    assert len(sizes) > 300
    assert max(r["count"] for r in sizes) < 20
    assert places.packed_lanes(rows, "g", "k", "a", "b").count() == 3000
    assert places.packed_lanes(rows.limit(0), "g", "k", "a", "b").count() == 0


@pytest.mark.parametrize("spread", [30.0, 300.0])
def test_clusters_equal_one_loop(spark, spread):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "x", None]), k, None if rng.random() < 0.02 else rng.uniform(0, spread), rng.uniform(0, spread)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    got = {(r["g"], r["k"]): (r["cluster"], round(r["x"], 9), round(r["y"], 9)) for r in places.clustered(df, "g", "k", 4.0).collect()}
    assert got == plain_clusters(rows, 4.0)
    if spread > 100:
        bands = places.apart(df.dropna(), "g", "x", 4.0).groupBy("g", "_of").count()
        assert bands.agg(F.max("count")).first()[0] < 60


def test_numbers_within_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i) for i in range(300)]
    want, seen = {}, defaultdict(int)
    for k, i in rows:
        seen[k] += 1
        want[i] = seen[k]
    assert {r["i"]: r["n"] for r in ranges.numbered(spark.createDataFrame(rows, "k int, i int").repartition(5), ["k"], ["i"], "n").collect()} == want
