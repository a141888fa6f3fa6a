"""Runs, last readings and medians over ranges of the order, against plain loops, and where their rows go."""

import random
import re
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates, joins, ranges, windows
from tallyspark.plans.inspect import explained


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows each."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def made_rows(rng, n):
    """Most rows of one key, some of none, values in runs short and long."""
    rows, value = [], 0
    for i in range(n):
        value = value if rng.random() < 0.9 else rng.choice([None, 1, 2, 3])
        rows.append((rng.choice([7, 7, 7, 7, 1, 2, None]), i, value))
    rng.shuffle(rows)
    return rows


def plain_runs(rows, keyed, gap=None):
    by, out = defaultdict(list), Counter()
    for k, i, v in rows:
        by[k if keyed else 0].append((i, v))
    for k, seq in by.items():
        run, found = 0, []
        for i, v in sorted(seq):
            if found and found[-1][1] == v and not (gap and i - found[-1][3] > gap):
                found[-1][3:] = [i, found[-1][4] + 1]
            else:
                run += 1
                found.append([run, v, i, i, 1])
        out.update((k, *x) if keyed else tuple(x) for x in found)
    return out


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("gap", [None, 4])
@pytest.mark.parametrize("by_range", [True, False])
def test_runs_equal_a_plain_loop(many_ranges, keyed, gap, by_range):
    rows = made_rows(random.Random(2), 400)
    df = many_ranges.createDataFrame(rows, "k int, i int, v int").repartition(4)
    got = windows.runs(df, ["k"] if keyed else [], ["i"], "v", None if gap is None else F.col("i") - F.col("_before.i") > gap, by_range=by_range)
    got = got.select(*(["k"] if keyed else []), "run", "v", "first.i", "last.i", "length").collect()
    assert Counter(map(tuple, got)) == plain_runs(rows, keyed, gap)


def test_one_run_over_all_ranges(many_ranges):
    df = many_ranges.range(500).select("id", F.lit("x").alias("v"))
    assert [tuple(r) for r in windows.runs(df, [], ["id"], "v").select("run", "v", "first.id", "last.id", "length").collect()] == [(1, "x", 0, 499, 500)]
    assert windows.runs(df.limit(0), [], ["id"], "v").count() == 0


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("by_range", [True, False])
def test_last_readings_equal_a_plain_loop(many_ranges, keyed, by_range):
    rng = random.Random(6)
    key = lambda: rng.choice([5, 5, 5, 5, 1, None]) if keyed else 5
    readings = [(key(), rng.randint(0, 300), rng.randint(0, 9)) for _ in range(60)]
    facts = [(key(), rng.randint(-20, 900), i) for i in range(300)]
    stamp = F.timestamp_seconds("t")
    a = many_ranges.createDataFrame(facts, "k int, t long, f int").withColumn("t", stamp)
    b = many_ranges.createDataFrame(readings, "k int, t long, r int").withColumn("t", stamp)
    got = {r["f"]: r["matched_r"] for r in joins.as_of(a, b, ["k"] if keyed else [], "t", "t", ["r"], "r", 200, by_range=by_range).collect()}
    want = {}
    for k, t, f in facts:
        past = [(u, r) for q, u, r in readings if q == k and u <= t]
        want[f] = max(past)[1] if past and t - max(past)[0] <= 200 else None
    assert got == want
    assert sum(x is not None for x in want.values()) > 50


@pytest.mark.parametrize("keys", [["k"], [], ["k", "j"]])
def test_medians_are_exact(many_ranges, keys):
    rng = random.Random(9)
    rows = [(rng.choice([7, 7, 7, 1, None]), rng.randint(0, 1), rng.choice([None, rng.random(), 3.5, 3.5, -2.0])) for _ in range(500)]
    rows += [(50, 0, None), (51, 0, 1.0), (52, 1, 1.0), (52, 1, 4.0)]
    by = defaultdict(list)
    for k, j, v in rows:
        by[tuple({"k": k, "j": j}[c] for c in keys)].append(v)
    got = {tuple(r[c] for c in keys): (r["median"], r["mean"], r["n"]) for r in aggregates.median_stats(many_ranges.createDataFrame(rows, "k int, j int, v double"), keys, "v").collect()}
    assert set(got) == set(by)
    for k, values in by.items():
        some = [v for v in values if v is not None]
        assert got[k][2] == len(some)
        if some:
            assert got[k][0] == pytest.approx(statistics.median(some), rel=1e-12)
            assert got[k][1] == pytest.approx(statistics.fmean(some), rel=1e-12)
        else:
            assert got[k][:2] == (None, None)
    empty = aggregates.median_stats(many_ranges.createDataFrame([], "k int, j int, v double"), ["k"], "v")
    assert empty.count() == 0


def test_one_key_is_many_tasks(many_ranges):
    """Rows of one key, or of none, in order: ranges of about one size, no window over all rows, no percentile buffer."""
    df = many_ranges.range(20_000).select("id", (F.col("id") % 10).alias("v"), F.lit(1).alias("k"))
    sizes = sorted(r["count"] for r in ranges.in_ranges(df, ["k"], ["id"]).groupBy("_part").count().collect())
    assert len(sizes) == 13
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    for found in (windows.runs(df, [], ["id"], "v"), ranges.last_known(df, [], ["id"], "v", "x")):
        of_rows = [w for w in re.findall(r"windowspecdefinition\(([^)]*)\)", explained(found)) if "_part" not in w.split(",")[0] and "_keys" not in w]
        assert all("_part" in w for w in of_rows)  # only the rows that stand for ranges are in one order
    plan = explained(aggregates.median_stats(df, ["k"], "v"))
    assert not re.search(r"percentile|median\(|collect_", plan)


@pytest.mark.parametrize("by_range", [True, False])
def test_ages_of_readings_count_parts_of_seconds(spark, by_range):
    """A reading is too old by a microsecond, and null times match nothing."""
    at = lambda c: F.timestamp_micros(F.col(c))
    readings = spark.createDataFrame([(1, 900_000, 1), (2, 900_000, 2), (3, None, 4)], "k int, t long, r int").withColumn("t", at("t"))
    facts = spark.createDataFrame([(1, 10_900_000, 1), (2, 10_900_001, 2), (3, 5, 4), (1, 11_899_999, 5)], "k int, t long, f int").withColumn("t", at("t"))
    got = {r["f"]: r["matched_r"] for r in joins.as_of(facts, readings, ["k"], "t", "t", ["r"], "r", 10, by_range=by_range).collect()}
    assert got == {1: 1, 2: None, 4: None, 5: None}
    assert {r["f"]: r["matched_r"] for r in joins.as_of(facts, readings, ["k"], "t", "t", ["r"], "r", by_range=by_range).collect()} == {1: 1, 2: 2, 4: None, 5: 1}
