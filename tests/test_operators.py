"""Operators on small hand-made rows with the edge cases of their rules."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, numbers, text
from tallyspark.operators import aggregates, gates, joins, nested, places, windows
from tallyspark.plans import inspect, lineage
from tallyspark.plans.inspect import explained
from tallyspark.plans.lineage import numbered_in_order

D = dt.date


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2.0), (2.5, 3.0), (-0.04, 0.0)])
def test_half_up(spark, x, want):
    assert one(spark, numbers.half_up(F.lit(x))) == want


def test_missing_markers_and_bad_numbers(spark):
    rows = spark.createDataFrame([(".",), ("",), ("Withheld",), (" 12.5 ",), (None,)], "t string")
    assert [r[0] for r in rows.select(numbers.number_or_missing(F.col("t"))).collect()] == [None, None, None, 12.5, None]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([("12x",)], "t string").select(numbers.number_or_missing(F.col("t"))).collect()


def test_sentinel_pair(spark):
    x, y = numbers.sentinel_to_null(F.col("x"), F.col("y"))
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 0.3), (None, 0.0)], "x double, y double").select(x.alias("x"), y.alias("y")).collect()
    assert [tuple(r) for r in rows] == [(None, None), (0.0, 0.3), (None, 0.0)]


def test_leap_day_birthday_and_sessions(spark):
    born = F.lit(D(2000, 2, 29))
    assert one(spark, dates.age(born, F.lit(D(2023, 2, 28)))) == 22
    assert one(spark, dates.age(born, F.lit(D(2023, 3, 1)))) == 23
    assert one(spark, dates.session_of(F.lit(D(2023, 1, 2)))) == 117
    assert one(spark, dates.session_of(F.lit(D(2023, 1, 3)))) == 118
    assert one(spark, dates.fiscal_year(F.lit(D(2023, 10, 1)))) == 2024
    assert one(spark, dates.mixed_date(F.lit("3/7/1999"))) == D(1999, 3, 7)
    assert one(spark, dates.mixed_date(F.lit("1999-02-30"))) is None
    assert one(spark, dates.month_label(F.lit("1999-13"))) is None


def test_text_rules(spark):
    assert one(spark, text.references(F.lit("Amends: EO 11246, EO 11375; Revokes: EO 9981"), "Amends")) == [11246, 11375]
    assert one(spark, text.references(F.lit("Amended by: EO 5; Revokes: EO 9"), "Amends")) == []
    assert tuple(one(spark, text.tally(F.lit("passed by 284 - 135 (Roll no. 12)")))) == (284, 135)
    assert one(spark, text.roll_number(F.lit("(Roll no. 12)"))) == 12
    assert one(spark, text.sentences(F.lit("Sen. Smith of the U.S. Senate spoke. He left. It was v. late."))) == ["Sen. Smith of the U.S. Senate spoke.", "He left.", "It was v. late."]
    assert one(spark, text.html_text(F.lit("<p>A &amp; B</p><script>x</script> c"))) == "A & B c"
    assert one(spark, text.last_name_variants(F.lit("Van Der Berg"))) == ["vanderberg", "van", "berg", "bergdervan"]
    assert one(spark, text.strip_marks(F.lit("Nuñéz"))) == "Nunez"
    assert one(spark, text.exact_dollars(F.lit("$20,140"))) == 20140
    assert one(spark, text.exact_dollars(F.lit("$1,001 - $15,000"))) is None
    assert one(spark, text.party_group(F.lit("Republican"), F.lit(32))) == "O"
    assert one(spark, text.caucus_group(F.lit("Democrat-Farmer"))) == "D"
    assert one(spark, text.occurrences(F.lit("$1 - $2; $1 - $2"), "$1 - $2")) == 2


@pytest.mark.parametrize(
    ("words", "found"),
    [
        ('He said "Stop." Then he left. (It was late.) J. Smith agreed!  So did Mr. Lee.', ['He said "Stop."', "Then he left.", "(It was late.)", "J. Smith agreed!", "So did Mr. Lee."]),
        ("In 5 U.S. 137 the Court ruled. \n 4 dissented.", ["In 5 U.S. 137 the Court ruled.", "4 dissented."]),
        ("no stop", ["no stop"]),
    ],
)
def test_sentences_know_quotes_and_initials(spark, words, found):
    assert one(spark, text.sentences(F.lit(words))) == found


def test_leads_are_whole_sentences(spark):
    body = "Lead: A (broken one. The court held that the rule (of 1999) stands. It ruled so again."
    assert one(spark, text.lead(F.lit(body), "Lead:", says="(?i)held")) == "The court held that the rule (of 1999) stands."
    assert one(spark, text.lead(F.lit("Plain is the word here. And more."))) == "Plain is the word here."
    assert one(spark, text.lead(F.lit("lower case start. <b>It</b> has markup left in it."))) is None
    assert one(spark, text.lead(F.lit(None).cast("string"))) is None


def test_entities_are_decoded(spark):
    assert one(spark, text.decoded_entities(F.lit("&lt;&amp;lt; caf&eacute; &#8217;&#x1F389;&#0;&nosuch; &copy &euro;&"))) == "<&lt; café ’🎉&#0;&nosuch; &copy €&"
    assert one(spark, text.html_text(F.lit("<p>A&nbsp;&nbsp;B&mdash;C</p>"))) == "A B—C"


def test_targets_are_graded(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("v"))
    found = gates.reconciled(rows, {"n": (F.count("*"), 100), "sum": (F.sum("v"), 5000), "odd": (F.sum("v"), 9000), "none": (F.sum(F.lit(None).cast("double")), 5), "seen": (F.count("*"), 1)}, 0.5, 5, sanity=("seen",))
    assert {r["label"]: (r["status"], r["diff_pct"]) for r in found.collect()} == {"n": ("pass", 0.0), "sum": ("investigate", pytest.approx(-1.0)), "odd": ("stop", pytest.approx(-45.0)), "none": ("stop", None), "seen": ("sanity", 9900.0)}
    with pytest.raises(gates.GateError, match="odd"):
        gates.require(gates.reconciles(found))


def test_tallies_are_counted_again(spark):
    votes = [(1, m, "majority" if m < 6 else "dissent") for m in range(9)] + [(2, m, "divided") for m in range(8)] + [(3, 0, "majority"), (3, 0, "majority"), (9, 1, "majority"), (5, 1, "majority"), (5, 2, "divided")]
    cases = spark.createDataFrame([(1, 6, 3), (2, 4, 4), (3, 2, 0), (4, 5, 4), (5, 1, 1)], "c int, told int, against int")
    found = gates.tallies(spark.createDataFrame(votes, "c int, m int, side string"), cases, "c", "m", "side", "told", "against").select("rule", F.get_json_object("detail", "$.c"))
    assert {tuple(r) for r in found.collect()} == {("tally", "5"), ("case without votes", "4"), ("two votes of one member", "3")}


def test_tallies_deal_votes_by_their_number(spark, monkeypatch):
    """Cases of few votes and one of many, with nulls; parts grow with the rows, so that none holds more for more votes."""
    monkeypatch.setattr(lineage, "PART", 500)
    plain = spark.range(6000).select((F.col("id") % 1500).cast("int").alias("c"), F.col("id").cast("int").alias("m"), F.when(F.col("id") % 2 == 0, "majority").otherwise("dissent").alias("side"))
    hot = spark.range(3000).select(F.lit(-1).alias("c"), F.col("id").cast("int").alias("m"), F.lit("majority").alias("side"))
    odd = spark.createDataFrame([(-1, 7, "majority"), (8, 9001, "none"), (8, 9001, "none"), (None, 1, "majority"), (None, 1, "majority"), (-5, 1, "majority"), (-5, 1, "majority"), (12, None, "none"), (12, None, "none")], "c int, m int, side string")
    cases = spark.range(1500).select(F.col("id").cast("int").alias("c"), F.when(F.col("id") % 2 == 0, 4).otherwise(0).alias("told"), F.when(F.col("id") % 2 == 0, 1).otherwise(4).alias("against"))
    cases = cases.unionByName(spark.createDataFrame([(-1, 3001, 0), (-2, 0, 0), (None, 0, 0)], "c int, told int, against int"))
    found = gates.tallies(plain.unionByName(hot).unionByName(odd), cases, "c", "m", "side", "told", "against")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        rows = found.select("rule", F.get_json_object("detail", "$.c").cast("int").alias("c"), "detail", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    wrong = {("tally", c) for c in range(0, 1500, 2)}
    assert {(r["rule"], r["c"]) for r in rows} == wrong | {("case without votes", -2), ("case without votes", None)} | {("two votes of one member", c) for c in (-1, 8, 12)}
    assert len(rows) == len(wrong) + 5
    assert {r["detail"] for r in rows if r["c"] in (-2, 6, 12)} == {'{"c":-2}', '{"c":6,"maj":4,"min":0,"div":0,"told":4,"against":1}', '{"c":12,"maj":4,"min":0,"div":0,"told":4,"against":1}', '{"c":12,"count":2}'}
    by_part = Counter(r["part"] for r in rows if r["rule"] == "tally")
    assert len(by_part) > 15  # 10,512 rows in parts of 500
    assert max(by_part.values()) < 100


def test_dense_periods(spark):
    rows = spark.createDataFrame([("a", D(2020, 2, 5)), ("a", D(2020, 8, 1)), (None, D(2021, 1, 1)), ("b", None)], "k string, d date")
    got = {(r["k"], r["period"]): r["n"] for r in aggregates.dense_periods(rows, ["k"], "d", "quarter").collect()}
    assert got == {("a", D(2020, 1, 1)): 1, ("a", D(2020, 4, 1)): 0, ("a", D(2020, 7, 1)): 1, (None, D(2021, 1, 1)): 1}
    weeks = [r["n"] for r in aggregates.dense_periods(rows.filter("k = 'a'"), [], "d", "week").orderBy("period").collect()]
    assert len(weeks) == 26
    assert sum(weeks) == 2
    assert tuple(one(spark, numbers.nice_domain(F.lit(3.2), F.lit(17.9)))) == (0.0, 20.0, 5.0)


def test_months_before_leaves_gaps_null(spark):
    rows = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 3, 1), 3.0), (D(2020, 4, 1), 4.0)], ["month", "v"])
    got = {r["month"].month: r["p"] for r in joins.months_before(rows, [], "month", "v", 1, "p").collect()}
    assert got == {1: None, 3: None, 4: 3.0}


def test_interval_end_rules(spark):
    spans = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 6, 30)), ("b", D(2020, 6, 30), None)], "who string, s date, e date")
    day = spark.createDataFrame([(D(2020, 6, 30),)], ["d"])
    assert {r["who"] for r in joins.interval_join(day, spans, "d", "s", "e", closed=True).collect()} == {"a", "b"}
    assert {r["who"] for r in joins.interval_join(day, spans, "d", "s", "e", closed=False).collect()} == {"b"}


def test_as_of_with_tolerance_and_ties(spark):
    t0 = dt.datetime(2024, 1, 1)
    seen = spark.createDataFrame([(1, t0, 9), (1, t0, 10), (1, t0 + dt.timedelta(hours=5), 11)], ["u", "ts", "r"])
    asks = spark.createDataFrame([(1, t0 + dt.timedelta(hours=1), "x"), (1, t0 + dt.timedelta(hours=9), "y"), (2, t0, "z")], ["u", "ts", "q"])
    got = {r["q"]: r["matched_r"] for r in joins.as_of(asks, seen, ["u"], "ts", "ts", ["r"], "r", 2 * 3600).collect()}
    assert got == {"x": 10, "y": None, "z": None}


def test_cascade_needs_a_single_candidate(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], ["k", "cite", "n"])
    right = spark.createDataFrame([(10, "a", 1), (20, "b", 6), (21, "b", 6), (30, "z", 7)], ["m", "cite", "n"])
    got = joins.cascade(left, right, "k", "m", [("cite", lambda a, b: a.join(b.drop("n"), "cite")), ("n", lambda a, b: a.join(b.drop("cite"), "n"))])
    assert {tuple(r) for r in got.select("k", "m", "via").collect()} == {(1, 10, "cite"), (3, 30, "n")}


def test_crosswalk_conflicts_and_id_resolution(spark):
    good, bad = joins.crosswalk(spark.createDataFrame([("p", [1, 2]), ("q", [2, 3])], ["person", "codes"]), "person", "codes")
    assert {tuple(r) for r in good.collect()} == {(1, "p"), (3, "q")}
    assert [r["code"] for r in bad.collect()] == [2]
    ids = spark.createDataFrame([(1, 1), (1, None), (None, 2), (1, 2), (None, None)], "a int, b int")
    assert [r["id_status"] for r in joins.resolve_ids(ids, F.col("a"), F.col("b")).collect()] == ["agree", "first", "second", "mismatch", "unmapped"]


def test_inheritance_goes_by_the_first_parent_that_has_or_inherits_a_value(spark):
    rows = spark.createDataFrame([(1, "tax", None), (2, None, [1]), (3, None, []), (5, "war", None), (6, None, [5, 2]), (7, None, [2, 5]), (8, None, [3, 99]), (9, None, [3, 7]), (10, None, [8]), (11, None, [12]), (12, None, [11]), (13, None, None)], "id int, topic string, parents array<int>")
    got = {r["id"]: (r["topic"], r["from_key"], r["review"]) for r in joins.inherit(rows, "id", "parents", "topic").collect()}
    assert got == {1: ("tax", 1, False), 2: ("tax", 1, False), 5: ("war", 5, False), 6: ("war", 5, True), 7: ("tax", 1, True), 9: ("tax", 1, False)}
    assert joins.inherit(rows.limit(0), "id", "parents", "topic").count() == 0


def test_open_ends_count_in_every_interval_operator(spark):
    spans = spark.createDataFrame([("x", D(2019, 5, 1), D(2020, 2, 1)), ("y", D(2020, 2, 2), None), ("z", None, None)], "who string, s date, e date")
    year = spark.createDataFrame([(2020, D(2020, 1, 1), D(2020, 12, 31)), (2030, D(2030, 1, 1), D(2030, 12, 31)), (2031, D(2031, 1, 1), None)], "fy int, a date, b date")
    assert {(r["fy"], r["who"]): r["days"] for r in joins.overlaps(year, spans, [], ("a", "b"), ("s", "e")).collect()} == {(2020, "x"): 32, (2020, "y"): 334, (2030, "y"): 365, (2031, "y"): None}
    assert {r["fy"]: (r["who"], r["days"]) for r in joins.most_days(year, spans, "fy", "who", ("a", "b"), ("s", "e")).collect()} == {2020: ("y", 334), 2030: ("y", 365), 2031: ("y", None)}
    facts = spark.createDataFrame([(D(2020, 2, 1),), (D(2040, 1, 1),), (D(2018, 1, 1),), (None,)], "d date")
    assert {(r["d"], r["who"]) for r in joins.interval_join(facts, spans, "d", "s", "e", closed=True).collect()} == {(D(2020, 2, 1), "x"), (D(2040, 1, 1), "y")}
    assert joins.interval_join(facts, spans, "d", "s", "e", closed=False, how="left").count() == 4
    assert joins.interval_join(facts.limit(0), spans, "d", "s", "e", closed=True).count() == 0


def test_interval_joins_go_by_an_equality(spark):
    """No operator over spans compares all with all."""
    a = spark.range(10).select("id", F.expr("date_add(DATE '2000-01-01', cast(id as int))").alias("s"), F.lit(None).cast("date").alias("e"))
    plan = joins.overlaps(a, a.toDF("other", "s2", "e2"), [], ("s", "e"), ("s2", "e2"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    assert "CartesianProduct" not in plan


def test_a_tenure_that_has_ended_stops_the_run(spark):
    tenures = spark.createDataFrame([("c", "x", D(2000, 1, 1), D(2000, 12, 31)), ("c", "y", D(2002, 1, 1), None)], "k string, who string, s date, e date")
    facts = lambda *days: spark.createDataFrame([("c", d) for d in days], "k string, d date")
    assert {(r["d"], r["who"]) for r in joins.as_of_strict(facts(D(2000, 12, 31), D(2050, 1, 1)), tenures, "d", "s", "e", "who", "k").collect()} == {(D(2000, 12, 31), "x"), (D(2050, 1, 1), "y")}
    for day in (D(2001, 1, 1), D(1999, 1, 1)):
        with pytest.raises(gates.GateError, match="no tenure"):
            joins.as_of_strict(facts(day), tenures, "d", "s", "e", "who", "k")


def test_peaks_by_date_and_missing_numbers_in_blocks(spark):
    rows = spark.createDataFrame([("a", D(2020, 1, 2), 5.0), ("a", D(2020, 1, 1), 5.0), ("a", D(2020, 1, 3), 1.0), ("a", D(2020, 1, 4), None), ("b", D(2020, 1, 1), 2.0)], "k string, d date, v double")
    got = {r["k"]: (r["high"], r["at_high"], r["low"], r["at_low"]) for r in aggregates.peak_and_low(rows, ["k"], "d", "v").collect()}
    assert got == {"a": (5.0, D(2020, 1, 1), 1.0, D(2020, 1, 3)), "b": (2.0, None, 2.0, None)}
    numbers_ = spark.createDataFrame([(n,) for n in (-5, -3, 0, 1, 7)], ["n"])
    for block in (1, 3, 100):
        assert sorted(int(r["detail"].split(":")[1][:-1]) for r in gates.contiguous(numbers_, "n", block=block).collect()) == [-4, -2, -1, 2, 3, 4, 5, 6]


def test_who_joined_and_who_left(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 3, "b"), ("g", 3, "c"), ("g", 3, "c"), ("h", 1, "a"), ("g", 3, None)], "g string, p int, m string")
    assert {tuple(r) for r in joins.joined_and_left(rows, "g", "p", "m").collect()} == {("g", 3, "c", "joined"), ("g", 3, "a", "left")}


def test_repaired_text(spark):
    bad = "café — naïve".encode().decode("latin-1")
    assert one(spark, text.repaired(F.lit(bad))) == "café — naïve"
    assert one(spark, text.repaired(F.lit("café"))) == "café"


def test_differences_and_failing_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "k int, v string")
    assert {(r["k"], r["left_value"], r["right_value"]) for r in joins.differences(a, b, ["k"], ["v"]).collect()} == {(1, "x", "y"), (3, None, "z")}
    with pytest.raises(gates.GateError):
        joins.inner_or_fail(b, a, ["k"])


def test_runs_islands_and_spans(spark):
    rows = spark.createDataFrame([(y, w) for y, w in zip(range(2000, 2006), "aabbba", strict=True)], ["y", "w"])
    assert sorted((r["first"]["y"], r["last"]["y"], r["w"]) for r in windows.runs(rows, [], ["y"], "w").collect()) == [(2000, 2001, "a"), (2002, 2004, "b"), (2005, 2005, "a")]
    flags = spark.createDataFrame([(D(2020, m, 1), int(m in (2, 3, 6))) for m in range(1, 7)], ["m", "f"])
    assert {tuple(r) for r in windows.flag_spans(flags, [], "m", "f").collect()} == {(D(2020, 2, 1), D(2020, 4, 1)), (D(2020, 6, 1), D(2020, 7, 1))}
    spans = spark.createDataFrame([(1, 3, "x"), (3, 5, "x"), (6, None, "x")], "s int, e int, p string")
    assert {tuple(r) for r in windows.merged_spans(spans, [], "s", "e", "p").select("s", "e").collect()} == {(1, 5), (6, None)}


def test_like_for_like_guards(spark):
    rows = spark.createDataFrame([(2000, 10.0, False, "a"), (2001, 20.0, False, "a"), (2002, 30.0, False, "b"), (2004, 40.0, False, "b"), (2005, 50.0, True, "b")], ["y", "v", "p", "b"])
    assert {r["y"]: r["change"] for r in windows.like_for_like(rows, [], "y", "v", "p", "b").collect()} == {2000: None, 2001: 1.0, 2002: None, 2004: None, 2005: None}


def test_top_and_other_keeps_nulls_outside(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "g string")
    assert {r["g"]: r["count"] for r in aggregates.top_and_other(rows, "g", 2).groupBy("g").count().collect()} == {"a": 2, "b": 1, "Other": 2}


def test_fold_peak_revisions(spark):
    rows = spark.createDataFrame([("x", None, "v"), ("x", None, "v"), ("y", 1, "v"), ("y", None, "v")], "k string, n int, s string")
    assert {r["k"]: r["n"] for r in aggregates.folded(rows, ["k"], ["n"], ["s"]).collect()} == {"x": None, "y": 1}
    flat = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 2.0), ("b", 2, 3.0), ("b", 3, 3.0)], ["k", "t", "v"])
    got = {r["k"]: (r["at_high"], r["at_low"]) for r in aggregates.peak_and_low(flat, ["k"], "t", "v").collect()}
    assert got == {"a": (None, None), "b": (2, 1)}
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "k int, v double")
    new = spark.createDataFrame([(1, 1.001, "preliminary"), (2, 2.001, "final"), (4, 4.0, "final"), (5, 5.0, "final")], "k int, v double, s string")
    assert {r["k"]: r["change"] for r in aggregates.revisions(old, new, ["k"], "v", "s", 0.01).collect()} == {2: "revised", 3: "removed", 4: "missing", 5: "new"}


def test_banded_value(spark):
    rows = spark.createDataFrame([("m", {"1-15": 2, "50+": 1})], "id string, c map<string,int>")
    bands = spark.createDataFrame([("1-15", 8.0, False), ("50+", 50.0, True)], ["band", "middle", "open"])
    assert tuple(aggregates.banded_value(rows, "id", "c", bands).first()) == ("m", 66.0, True, 0)


@pytest.mark.parametrize("break_it", [False, True])
def test_gates_pass_and_fail(spark, break_it):
    rows = [(1, "a", 5), (2, "b", 6), (3, "a", 7)] + ([(3, "z", 9), (6, "a", 1)] if break_it else [])
    df = spark.createDataFrame(rows, ["n", "c", "v"])
    codes = spark.createDataFrame([("a",), ("b",)], ["c"])
    totals = spark.createDataFrame([("a", 12), ("b", 6)], ["c", "t"])
    checks = [gates.unique(df, ["n"]), gates.references(df, codes, ["c"]), gates.contiguous(df, "n"), gates.sums_match(df, totals, ["c"], "v", "t"), gates.anchors(df, {"rows": (F.count("*"), 3)}), gates.within(df, "v", F.lit(5), F.lit(7), "n")]
    assert [bool(g.count()) for g in checks] == [break_it] * len(checks)
    if break_it:
        with pytest.raises(gates.GateError):
            gates.require(*checks)
    else:
        gates.require(*checks)


def test_status_order_and_tripwire(spark):
    rows = spark.createDataFrame([("s", 1, "final"), ("s", 2, "preliminary"), ("s", 3, "final")], ["k", "d", "st"])
    assert gates.status_order(rows, ["k"], "d", "st").count() == 1
    pairs = spark.createDataFrame([(1, "lo", 5.0), (1, "hi", 4.0), (2, "lo", 1.0)], ["k", "s", "v"])
    assert gates.ordered_pair(pairs, "k", "s", "v", "lo", "hi").count() == 1


def test_nested_rules(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 3, 7.0)], ["k", "m", "v"])
    assert nested.month_slots(rows, ["k"], "m", "v").first()["months"][:4] == [5.0, None, 7.0, None]


def test_places(spark):
    ring = spark.createDataFrame([("r", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0.01), (2, 0), (2, 2)])], ["r", "i", "x", "y"])
    assert [p["i"] for p in places.thinned(ring, "r", "i", 0.1).orderBy("i").collect()] == [0, 2, 3]
    points = spark.createDataFrame([("c", 1, 0.0, 0.0), ("c", 2, 0.5, 0.0), ("c", 3, 9.0, 0.0)], ["g", "k", "x", "y"])
    assert {r["k"]: r["cluster"] for r in places.clustered(points, "g", "k", 1.0).collect()} == {1: 0, 2: 0, 3: 1}
    assert one(spark, places.shade_signed(F.lit(-7.0), [5, 10])) == -2


def test_pushdown_and_pruning(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity > 10").select("l_orderkey")
    assert "GreaterThan(l_quantity,10.0)" in inspect.pushed_filters(lines)[0]
    assert inspect.read_columns(lines) == ["l_orderkey:bigint,l_quantity:double"]
    assert inspect.exchanges(lines) == 0
    assert inspect.exchanges(aggregates.band_counts(lines, ["l_orderkey"], F.lit(0), 1)) == 1


def test_nearest_peers_with_ties(spark):
    """The advice's case, then values of which many rows share one, against all pairs."""
    rows = [("a", 1, 9.0), ("a", 2, 9.0), ("a", 3, 9.5), ("a", 4, 9.6), ("a", 5, 9.7), ("a", 6, 10.0)]
    rows += [("b", 10 + i, float(i * i % 7)) for i in range(40)] + [("c", 60, 1.0), ("c", 61, 1.0)]
    got = {}
    for r in joins.nearest_peers(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "k", "v", 4).orderBy("k", "rank").collect():
        got.setdefault(r["k"], []).append(r["peer"])
    assert got[6] == [5, 4, 3, 1]
    assert got == {k: [p for _, p in sorted((abs(v - w), p) for h, p, w in rows if h == g and p != k)[:4]] for g, k, v in rows}


def test_nearest_peers_are_put_in_order_for_values_not_for_rows(spark):
    """Rows that share values, nulls among them: what is sorted stands before the join with rows, and each row has the n first without itself."""
    rows = [("a", i, None if i % 9 == 0 else float(i % 4)) for i in range(60)] + [("b", 70, None), ("b", 71, 1.0)]
    found = joins.nearest_peers(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "k", "v", 3)
    assert "posexplode(slice(filter(" in explained(found)
    got = {}
    for r in found.orderBy("k", "rank").collect():
        got.setdefault(r["k"], []).append(r["peer"])
    far = lambda v, w: (1, 0.0) if v is None or w is None else (0, abs(v - w))
    known = {k: v for _, k, v in rows if v is not None}
    assert {k: got[k] for k in known} == {k: [p for _, p in sorted((far(v, w), p) for h, p, w in rows if h == g and p != k)[:3]] for g, k, v in rows if k in known}
    assert got[70] == [71]


@pytest.mark.parametrize("stage", [3, -1, None])
def test_stage_counts_drop_no_row(spark, stage):
    schema = "k string, s int"
    whole = aggregates.stage_counts(spark.createDataFrame([("a", 0), ("a", 2)], schema), ["k"], "s", 2).orderBy("s")
    assert [(r["stopped"], r["reached"]) for r in whole.collect()] == [(1, 2), (0, 1), (1, 1)]
    with pytest.raises(gates.GateError, match="s is 0 to 2"):
        aggregates.stage_counts(spark.createDataFrame([("a", 0), ("a", stage)], schema), ["k"], "s", 2)


def test_numbers_in_order_and_nearest_points_without_single_tasks(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = numbered_in_order(rows, "n", F.desc("v"))
    assert {r["v"]: r["n"] for r in got.collect()} == {v: 499 - v for v in range(500)}
    assert numbered_in_order(rows.limit(0), "n", F.desc("v")).count() == 0
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, -1.0), (4, None, 0.0), (5, 9.0, 9.0)], "k int, x double, y double")
    near = joins.nearest_points(points, points, "k", ["x", "y"], 2)
    assert {(r["k"], r["rank"], r["neighbour"], r["distance"]) for r in near.collect() if r["k"] == 1} == {(1, 1, 2, 1.0), (1, 2, 3, 1.0)}
    assert near.filter("k = 4 OR neighbour = 4").count() == 0
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
