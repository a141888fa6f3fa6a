"""Joins of spans against all pairs compared, and what their plans and tasks do."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cells, classes, joins
from tallyspark.plans.inspect import explained

D0 = dt.date(2000, 1, 1)


def day(n):
    return None if n is None else D0 + dt.timedelta(days=n)


def made_spans(rng, n, keys=3):
    rows = []
    for i in range(n):
        a = None if rng.random() < 0.05 else rng.choice([rng.randint(-400, 3000), rng.randint(0, 20)])
        b = None if a is None or rng.random() < 0.1 else a + rng.choice([0, 1, 30, 400, 3000, -2])
        rows.append((None if rng.random() < 0.05 else rng.randrange(keys), i, a, b))
    return rows


def in_days(spark, rows, names):
    return spark.createDataFrame([(k, i, day(a), day(b)) for k, i, a, b in rows], f"{names[0]} int, {names[1]} int, {names[2]} date, {names[3]} date")


def meet(a, b, x, y):
    """Closed spans (a, b) and (x, y), ends of None being open."""
    return a is not None and x is not None and (y is None or a <= y) and (b is None or x <= b)


@pytest.mark.parametrize("most", [0, cells.MOST])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlaps_equal_all_pairs(spark, most, keys, monkeypatch):
    monkeypatch.setattr(cells, "FLOOR", 50)  # wide cells, so that spans share some
    rng = random.Random(len(keys) + most)
    one, two = made_spans(rng, 120), made_spans(rng, 90)
    good = lambda r: r[2] is not None and (r[3] is None or r[2] <= r[3])
    got = cells.meeting(in_days(spark, one, ["k", "i", "a", "b"]), in_days(spark, two, ["k", "j", "x", "y"]), keys, ("a", "b"), ("x", "y"), most=most)
    want = Counter((p[1], q[1]) for p in one for q in two if good(p) and good(q) and meet(*p[2:], *q[2:]) and (not keys or (p[0] == q[0] and p[0] is not None)))
    assert Counter((r["i"], r["j"]) for r in got.collect()) == want


@pytest.mark.parametrize("most", [0, cells.MOST])
@pytest.mark.parametrize("closed", [True, False])
def test_days_in_spans_equal_all_pairs(spark, most, closed, monkeypatch):
    monkeypatch.setattr(cells, "FLOOR", 50)
    monkeypatch.setattr(joins, "MOST", most)
    rng = random.Random(5)
    spans = made_spans(rng, 80)
    facts = [(i, None if rng.random() < 0.05 else rng.randint(-500, 9000)) for i in range(300)]
    df = spark.createDataFrame([(i, day(d)) for i, d in facts], "f int, d date")
    got = joins.interval_join(df, in_days(spark, spans, ["k", "j", "x", "y"]), "d", "x", "y", closed, how="left")
    want = Counter()
    for i, d in facts:
        hits = [j for _, j, x, y in spans if d is not None and x is not None and x <= d and (y is None or (d <= y if closed else d < y))]
        want.update((i, j) for j in hits or [None])
    assert Counter((r["f"], r["j"]) for r in got.collect()) == want


def brute_shared(rows):
    found = {}
    for k1, i, a, b in rows:
        for k2, j, x, y in rows:
            if i != j and k1 == k2 and k1 is not None and meet(a, b, x, y) and (b is None or a <= b) and (y is None or x <= y):
                to = min((e for e in (b, y) if e is not None), default=None)
                found.setdefault((k1, i, j), []).append((max(a, x), to))
    edge = {}
    for k, i, _, b in rows:
        edge.setdefault((k, i), []).append(b)
    edge = {k: None if None in v else max(v) for k, v in edge.items()}
    out = Counter()
    for (k, i, j), spans in found.items():
        open_ = any(e is None for _, e in spans)
        last = None if open_ else max(e for _, e in spans)
        out[k, i, j, None if open_ else sum(e - s + 1 for s, e in spans), min(s for s, _ in spans), last, len(spans), last == edge[k, i]] += 1
    return out


@pytest.mark.parametrize("most", [0, cells.MOST])
def test_shared_spans_equal_all_pairs(spark, most):
    """Whole numbers as the axis, several spans of one key."""
    rng = random.Random(11)
    rows = [(k, i, a, b) for k, n, a, b in made_spans(rng, 60) for i in [n // 2]]
    df = spark.createDataFrame(rows, "k int, i int, a int, b int")
    got = joins.shared_spans(df, "i", "a", "b", ["k"], most=most).select("k", "i", "peer", "shared", "first", "last", "n_spans", "ends_at_edge")
    assert Counter(map(tuple, got.collect())) == brute_shared(rows)
    assert joins.shared_spans(df.limit(0), "i", "a", "b").count() == 0


def test_peers_alongside_tell_neighbours(spark):
    rows = spark.createDataFrame([("g", 1, 0.0, 1950, 1960), ("g", 2, 0.1, 1960, 1970), ("g", 3, 0.5, 1955, None), ("g", 4, 0.2, 1975, 1980), ("h", 5, 0.0, 1950, 1990)], "g string, k int, v double, t0 int, t1 int")
    got = {(r["k"], r["peer"]): (r["shared"], r["ends_at_edge"], r["is_neighbor"]) for r in joins.peers_alongside(rows, ["g"], "k", "v", "t0", "t1", 2).collect()}
    assert got == {(1, 2): (1, True, True), (2, 1): (1, False, True), (1, 3): (6, True, False), (3, 1): (6, False, False), (2, 3): (11, True, False), (3, 2): (11, False, True), (3, 4): (6, False, True), (4, 3): (6, True, False)}


def test_large_span_tables_meet_by_narrow_cells(spark):
    """Spans too many to broadcast: an equality by cell, no year, and no task with far more rows than the others."""
    facts = spark.range(40_000).select("id", F.date_add(F.lit(D0), (F.col("id") * 7919 % 3650).cast("int")).alias("d"))
    spans = spark.range(2_000).select(F.col("id").alias("who"), F.date_add(F.lit(D0), (F.col("id") * 37 % 3600).cast("int")).alias("a"))
    spans = spans.withColumn("b", F.when(F.col("who") % 500 > 0, F.date_add("a", (F.col("who") % 40).cast("int"))))
    partitions, broadcast = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = cells.meeting(facts, spans, [], ("d", "d"), ("a", "b"), most=0)
        plan = explained(found)
        assert not re.search("NestedLoop|CartesianProduct|BroadcastHashJoin", plan)
        assert re.search("hashpartitioning\\(_cell", plan)
        sizes = sorted(Counter(r[0] for r in found.select(F.spark_partition_id()).collect()).values())
        assert len(sizes) == 16
        assert sizes[-1] < 2 * sizes[8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    small = explained(cells.meeting(facts, spans.limit(20), [], ("d", "d"), ("a", "b")))
    assert "BroadcastHashJoin" in small
    assert "NestedLoop" not in small


def test_facts_are_read_once(spark, tmp_path):
    """Only the spans are looked at before the join: a table of facts that can't be read doesn't stop the plan."""
    spark.range(5).select(F.lit(D0).alias("d")).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts")).withColumn("d", F.when(F.raise_error(F.lit("read")).isNull(), F.col("d")))
    spans = spark.createDataFrame([(1, D0, None)], "j int, a date, b date")
    assert "d" in joins.interval_join(facts, spans, "d", "a", "b", closed=True).columns


@pytest.mark.parametrize(("room", "size"), [(5, 1), (5, 3), (cells.ROOM, 3)])
def test_shared_spans_of_single_and_several_spans(spark, room, size, monkeypatch):
    """Classes of equal spans in short lists, crowded keys cut into cells and others not, keys of one span beside keys of several."""
    monkeypatch.setattr(cells, "ROOM", room)
    monkeypatch.setattr(cells, "FLOOR", 50)
    monkeypatch.setattr(classes, "LIST", size)
    rng = random.Random(room + size)
    made = [(k, i, a, b) for k, i, a, b in made_spans(rng, 70)] + [(0, 100 + i, 5, 8) for i in range(9)] + [(4, 200 + i, 5, None) for i in range(3)]
    for rows in (made, made + [(k, i, b + 50, b + 60) for k, i, _, b in made[::9] if b is not None]):
        df = spark.createDataFrame(rows, "k int, i int, a int, b int")
        got = joins.shared_spans(df, "i", "a", "b", ["k"], most=0).select("k", "i", "peer", "shared", "first", "last", "n_spans", "ends_at_edge")
        assert Counter(map(tuple, got.collect())) == brute_shared(rows)


def test_pairs_of_single_spans_are_not_moved(spark):
    """Of 200 rows in two classes, 39,800 pairs come: what is shuffled is lists, and no pair is grouped or joined."""
    rows = spark.range(200).selectExpr("id AS k", "1 AS g", "CAST(id AS DOUBLE) AS v", "CAST(1990 + id % 2 AS INT) AS a", "1999 AS b")
    found = joins.peers_alongside(rows, ["g"], "k", "v", "a", "b", 3)
    assert found.count() == 200 * 199
    assert found.filter("is_neighbor").count() == 600
    above = explained(found).split("Exchange")[0]
    assert above.count("Generate") == 2
    assert not re.search("Join|Aggregate", above)


def test_small_keys_meet_without_cells(spark):
    """Long spans whose keys have few rows: one row a span, whatever their length."""
    rows = spark.range(3000).selectExpr("CAST(id DIV 3 AS INT) AS k", "id AS i", "CAST(id AS INT) AS a", "CAST(id + 2000 AS INT) AS b")
    found = cells.meeting(rows, rows.withColumnsRenamed({"i": "j", "a": "x", "b": "y"}), ["k"], ("a", "b"), ("x", "y"), most=0)
    assert found.count() == 9000
    assert "sequence" not in explained(found)


def test_pairs_of_lists_are_handed_on_one_member_at_a_time(spark):
    """Of two lists' 900 pairs the first comes without those of the last member, which stop a run that makes them: they aren't held together."""
    pairs = spark.range(1).selectExpr("id", "sequence(0, 29) AS x", "sequence(0, 29) AS y")
    found = classes.unpacked(pairs, "x", "y").withColumn("made", F.when(F.col("x") < 29, F.col("x")).otherwise(F.raise_error(F.lit("made"))))
    assert found.first()["made"] == 0
    assert classes.unpacked(pairs, "x", "y").distinct().count() == 900


def test_peers_alongside_work_their_rows_out_once(spark, tmp_path):
    spark.range(40).selectExpr("id AS k", "1 AS g", "CAST(id AS DOUBLE) AS v", "CAST(id % 3 AS INT) AS a", "9 AS b").write.parquet(str(tmp_path / "rows"))
    found = joins.peers_alongside(spark.read.parquet(str(tmp_path / "rows")), ["g"], "k", "v", "a", "b", 3)
    assert "Scan parquet" not in explained(found)
    assert found.count() == 40 * 39
