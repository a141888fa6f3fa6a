"""Filters and unions on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, numbers, text
from tallyspark.operators import filters, places, unions, windows
from tallyspark.sources import readers

D = dt.date


def test_scope_counts_unknown_as_out(spark):
    kept, tally = filters.in_scope(spark.createDataFrame([(1,), (5,), (None,)], "n int"), F.col("n") > 3)
    assert [r["n"] for r in kept.collect()] == [5]
    assert tuple(tally.first()) == (1, 2)


def test_facets_skip_their_own(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], ["p", "q"])
    got = {(r["facet"], r["value"]): r["n"] for r in filters.facet_counts(rows, {"p": "p", "q": "q"}, {"p": F.col("p") == "a", "q": F.col("q") == "x"}).collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 1, ("q", "x"): 1, ("q", "y"): 1}


def test_seats_areas_search(spark):
    rows = spark.createDataFrame([("PR", 100), ("AK", 80), ("AK", 90), ("NY", 9)], ["s", "n"])
    assert [tuple(r) for r in rows.filter(filters.has_vote(F.col("s"), F.col("n"), ["PR"], [("NY", 9)], {"AK": 86})).collect()] == [("AK", 90)]
    areas = spark.createDataFrame([("tax",), ("war",), (None,)], "a string")
    assert [r["a"] for r in filters.of_area(areas, "a", "OTHER", ["tax"]).collect()] == ["war", None]
    assert [r["a"] for r in filters.find(areas, "WA", ["a"], ["a"], 5).collect()] == ["war"]


def test_splice_and_sources(spark):
    old = spark.createDataFrame([(1, 10), (2, None)], "y int, v int")
    new = spark.createDataFrame([(2, 99), (3, 30)], "y int, v int")
    fixes = spark.createDataFrame([(2, 20)], "y int, v int")
    assert {tuple(r) for r in unions.spliced(old, new, fixes, ["y"], "v").collect()} == {(1, 10), (2, 20), (3, 30)}
    both = unions.with_provenance(a=old, b=new)
    assert unions.one_source_each(both, ["y"]).count() == 1


def test_tenures_and_shares(spark):
    spans = spark.createDataFrame([("x", D(2020, 1, 1), D(2020, 7, 1)), ("y", D(2020, 7, 1), D(2020, 12, 31))], ["who", "s", "e"])
    days = spark.createDataFrame([(D(2020, 7, 1),), (D(2021, 5, 1),), (D(2019, 1, 1),)], ["d"])
    assert {r["d"]: r["who"] for r in unions.tenure_or_last(days, spans, "d", "s", "e", "who").collect()} == {D(2020, 7, 1): "y", D(2021, 5, 1): "y", D(2019, 1, 1): None}
    closed = spark.createDataFrame([("x", D(2019, 10, 1), D(2020, 6, 30)), ("y", D(2020, 7, 1), D(2021, 9, 30))], ["who", "s", "e"])
    year = spark.createDataFrame([(2020, D(2019, 10, 1), D(2020, 9, 30))], ["fy", "a", "b"])
    got = {r["who"]: (r["days"], r["has_last_day"], r["blended"]) for r in unions.day_shares(year, closed, "fy", "who", ("a", "b"), ("s", "e")).collect()}
    assert got == {"x": (274, False, True), "y": (92, True, True)}


def test_representatives_and_nested_totals(spark):
    rows = spark.createDataFrame([(2020, "t1", "a", 1, 0.5), (2020, "t2", "a", 2, 0.9), (2020, "t1", "b", 3, 0.1)], ["y", "term", "topic", "id", "score"])
    assert [(r["topic"], r["id"]) for r in unions.representatives(rows, "topic", "score", "id", 2).collect()] == [("a", 2), ("b", 3)]
    row = unions.totals_and_items(rows, "y", "term", "topic", "id").first()
    assert (row["n"], row["items"], [tuple(x) for x in row["topics"]]) == (3, [1, 2, 3], [("a", 2), ("b", 1)])


def test_rules_that_no_query_shows(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("code  name\nA1  first \nnot a row\nB2  second\n")
    rows = readers.pattern_lines(spark, str(tmp_path / "lines.txt"), r"^([A-Z]\d)\s+(.*)$", ["code", "name"], 2)
    assert {tuple(r) for r in rows.collect()} == {("A1", "first"), ("B2", "second")}
    with pytest.raises(ValueError, match="fewer"):
        readers.pattern_lines(spark, str(tmp_path / "lines.txt"), r"^([A-Z]\d)\s+(.*)$", ["code", "name"], 3)
    spans = spark.createDataFrame([("g", 1, 0, 5), ("g", 2, 3, 8), ("g", 3, 5, 6), ("g", 4, 6, 9), ("g", 5, 7, 7), ("h", 1, 0, 1)], "g string, k int, a int, b int")
    got = {(r["g"], r["k"]): r["lane"] for r in places.packed_lanes(spans, "g", "k", "a", "b").collect()}
    lanes = {}
    for g, k, a, b in [tuple(r) for r in spans.orderBy("g", "a", "k").collect()]:  # the lowest lane that is free
        ends = lanes.setdefault(g, [])
        want = next((i for i, e in enumerate(ends) if e <= a), len(ends))
        ends[want : want + 1] = [b]
        assert got[g, k] == want
    one = spark.range(1).select(
        text.child_id(F.lit("HSAG"), F.lit("01")).alias("child"), text.number_in(F.lit(1234567), F.lit("of 1,234,567 cases")).alias("sep"), text.number_in(F.lit(12), F.lit("1 and 2")).alias("no"),
        numbers.clip_band(F.lit(9), 4).alias("band"), numbers.signed_log_inverse(numbers.signed_log(F.lit(-250.0))).alias("back"), dates.month_of_index(F.lit(13), 1991).alias("month"), dates.convening_day(F.lit(73)).alias("old"), dates.convening_day(F.lit(119)).alias("new"),
    ).first()
    assert (one["child"], one["sep"], one["no"], one["band"]) == ("HSAG01", True, False, 4)
    assert abs(one["back"] + 250) < 1e-6
    assert [str(one[c]) for c in ("month", "old", "new")] == ["1992-02-01", "1933-03-04", "2025-01-03"]
    names = spark.createDataFrame([("b",), (None,), ("a",)], "n string")
    assert [[r["n"] for r in names.orderBy(windows.nulls_last("n", d)).collect()] for d in (False, True)] == [["a", "b", None], ["b", "a", None]]
    assert [r["n"] for r in spark.createDataFrame([("b",), ("É",), ("a",), ("F",)], "n string").orderBy(windows.by_name("n")).collect()] == ["a", "b", "É", "F"]
