"""Data-quality gates. Each gives its violations as rows (rule, detail); require() stops the run if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans import lineage


class GateError(ValueError):
    """A gate found violations."""


def _out(df: DataFrame, rule: str, *detail: Column | str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.to_json(F.struct(*detail)).alias("detail"))


def require(*gates: DataFrame) -> None:
    """Raise with the first violations of all gates together."""
    found = reduce(DataFrame.unionByName, gates).limit(10).collect()
    if found:
        raise GateError("; ".join(f"{r['rule']}: {r['detail']}" for r in found))


def valid(df: DataFrame, rule: str, condition: Column, *detail: str) -> DataFrame:
    """Rows for which a condition doesn't hold, or is unknown."""
    return _out(df.filter(~F.coalesce(condition, F.lit(False))), rule, *(detail or df.columns))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return _out(df.groupBy(*keys).count().filter("count > 1"), "unique", *keys, "count")


def references(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return _out(df.filter(F.col(on[0]).isNotNull()).join(other, on, "left_anti").select(*on).distinct(), "references", *on)


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    several = lambda x, y: _out(df.groupBy(x).agg(F.count_distinct(y).alias("n")).filter("n > 1"), f"one {y} for each {x}", x, "n")
    return several(a, b).unionByName(several(b, a))


def sums_match(parts: DataFrame, totals: DataFrame, on: list[str], part: str, total: str, tolerance: float = 0.0) -> DataFrame:
    """Sums of parts that differ from the printed total by more than a share of it, or lack one."""
    both = parts.groupBy(*on).agg(F.sum(part).alias("_sum")).join(totals.select(*on, F.col(total).alias("_total")), on, "full_outer")
    off = F.abs(F.col("_sum") - F.col("_total")) > tolerance * F.abs(F.col("_total"))
    return _out(both.filter(F.coalesce(off, F.lit(True))), "sums match", *on, "_sum", "_total")


def worst_gap(parts: DataFrame, totals: DataFrame, on: list[str], part: str, total: str) -> DataFrame:
    """One row: the key with the largest relative gap, and the gap."""
    both = parts.groupBy(*on).agg(F.sum(part).alias("_sum")).join(totals, on).withColumn("gap", F.try_divide(F.abs(F.col("_sum") - F.col(total)), F.abs(total)))
    return both.agg(F.max_by(F.struct(*on), F.struct("gap", *on)).alias("at"), F.max("gap").alias("gap"))


def known_exceptions(found: DataFrame, documented: DataFrame, on: list[str]) -> DataFrame:
    """Deviations that aren't documented, and documented ones that are gone."""
    return _out(found.join(documented, on, "left_anti"), "undocumented", *on).unionByName(_out(documented.join(found, on, "left_anti"), "no longer found", *on))


def anchors(df: DataFrame, expected: dict[str, tuple[Column, object]]) -> DataFrame:
    """Known numbers: name -> (aggregate, value)."""
    row = df.agg(*(e.alias(name) for name, (e, _) in expected.items()))
    checks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("found"), F.lit(v).cast("string").alias("expected")) for name, (_, v) in expected.items())))
    return _out(row.select(checks.alias("c")).select("c.*").filter(~F.col("found").eqNullSafe(F.col("expected"))), "anchor", "name", "found", "expected")


def contiguous(df: DataFrame, number: str, keys: list[str] | None = None, block: int = 1 << 16) -> DataFrame:
    """Whole numbers missing between the first and the last, per key. Numbers are laid out in blocks, so no row holds a whole range."""
    keys = keys or []
    have = df.select(*keys, F.col(number).cast("long").alias("n")).distinct()
    span = have.groupBy(*keys).agg(F.min("n").alias("a"), F.max("n").alias("b")).filter("a IS NOT NULL")
    blocks = span.select(*keys, "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))).alias("i")).repartition("i")
    every = blocks.select(*keys, F.explode(F.sequence(F.greatest("a", F.col("i") * block), F.least("b", F.col("i") * block + block - 1))).alias("n"))
    return _out(every.join(have, [*keys, "n"], "left_anti"), "contiguous", *keys, "n")


def within(df: DataFrame, value: str, low: Column, high: Column, *detail: str) -> DataFrame:
    return valid(df, "within", F.col(value).between(low, high), value, *detail)


def same_period(df: DataFrame, *periods: str) -> DataFrame:
    """File name, header and manifest name one period."""
    return valid(df, "same period", reduce(lambda a, b: a & b, (F.col(periods[0]).eqNullSafe(F.col(p)) for p in periods[1:])), *periods)


def ordered_pair(df: DataFrame, key: str, series: str, value: str, low: str, high: str) -> DataFrame:
    """Wherever both series have a value, the low one isn't above the high one."""
    side = lambda name, out: df.filter(F.col(series) == name).select(key, F.col(value).alias(out))
    return _out(side(low, "low").join(side(high, "high"), key).filter("low > high"), "ordered pair", key, "low", "high")


def status_order(df: DataFrame, keys: list[str], day: str, status: str) -> DataFrame:
    """No final row after a preliminary one."""
    grouped = df.groupBy(*keys).agg(F.max(F.when(F.col(status) == "final", F.col(day))).alias("last_final"), F.min(F.when(F.col(status) == "preliminary", F.col(day))).alias("first_preliminary"))
    return _out(grouped.filter("last_final > first_preliminary"), "status order", *keys, "last_final", "first_preliminary")


def match_floor(df: DataFrame, matched: Column, least: float) -> DataFrame:
    return _out(df.agg(F.avg(matched.cast("double")).alias("share")).filter(F.coalesce(F.col("share") < least, F.lit(False))), "match rate", "share")


def reaggregates(rows: DataFrame, counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """A list counted again equals the published counts, cell by cell; a missing cell is 0."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("_again")).join(counts.select(*keys, F.col(count).alias("_told")), keys, "full_outer")
    return _out(again.filter(F.coalesce("_again", F.lit(0)) != F.coalesce("_told", F.lit(0))), "reaggregates", *keys, "_again", "_told")


def arbitrate(a: Column, b: Column, minor: int, excepted: Column) -> Column:
    """Of two tallies: exact, minor, exception or fatal."""
    gap = F.abs(a - b)
    return F.when(gap == 0, "exact").when(gap <= minor, "minor").when(excepted, "exception").otherwise("fatal")


def grade_gap(gap: Column, investigate: float, stop: float) -> Column:
    """A relative gap as pass, investigate or stop."""
    return F.when(gap.isNull(), "stop").when(F.abs(gap) >= stop, "stop").when(F.abs(gap) >= investigate, "investigate").otherwise("pass")


def reconciled(df: DataFrame, targets: dict[str, tuple[Column, float]], investigate: float, stop: float, sanity: tuple[str, ...] = ()) -> DataFrame:
    """(label, expected, actual, diff_pct, status) of published numbers against aggregates of the rows, in one pass.

    targets: label -> (aggregate, published number). status: pass, investigate from one gap in percent on, stop from another on (and where there is no
    aggregate, or nothing to compare with); sanity for labels that are only to be looked at.
    """
    row = df.agg(*(F.struct(F.lit(label).alias("label"), F.lit(float(expected)).alias("expected"), actual.cast("double").alias("actual"), F.lit(label in sanity).alias("sane")).alias(f"_{i}") for i, (label, (actual, expected)) in enumerate(targets.items())))
    each = row.select(F.explode(F.array(*(f"_{i}" for i in range(len(targets))))).alias("t")).select("t.*")
    gap = F.try_divide(F.col("actual") - F.col("expected"), F.col("expected")) * 100
    graded = F.when(F.col("sane"), "sanity").otherwise(grade_gap(F.col("diff_pct"), investigate, stop))
    return each.withColumn("diff_pct", gap).withColumn("status", graded).drop("sane")


def reconciles(found: DataFrame) -> DataFrame:
    """Gate over reconciled(): what stops the run."""
    return _out(found.filter(F.col("status") == "stop"), "reconciles", "label", "expected", "actual", "diff_pct")


def tallies(votes: DataFrame, cases: DataFrame, key: str, member: str, side: str, majority: str, minority: str, parts: int | None = None) -> DataFrame:
    """Votes counted again against each case's printed tally. votes: (key, member, side); cases: (key, majority, minority).

    side is majority, dissent, divided or anything else (no side). An equally divided case has no sides: its divided votes make both numbers together.
    Violations are cases whose votes give other numbers, cases without votes, and members with two votes in a case. Votes in no case are out of scope.
    parts: into how many parts votes are dealt, by case and by member (lineage.parts; else both tables' rows are counted for it), so that no task holds more for more votes.
    """
    n = parts or lineage.parts(votes.sparkSession, votes.count() + cases.count())
    is_ = lambda name: F.count_if(F.col(side) == name)
    found = votes.select(key, side).repartition(n, key).groupBy(key).agg(is_("majority").alias("_maj"), is_("dissent").alias("_min"), is_("divided").alias("_div"))
    both = cases.select(key, F.col(majority).alias("_told"), F.col(minority).alias("_against")).join(found, key, "left")
    whole = F.when(F.col("_div") > 0, (F.col("_div") == F.col("_told") + F.col("_against")) & (F.col("_maj") + F.col("_min") == 0)).otherwise((F.col("_maj") == F.col("_told")) & (F.col("_min") == F.col("_against")))
    names = [F.col(c).alias(c[1:]) for c in ("_maj", "_min", "_div", "_told", "_against")]
    none = F.col("_maj").isNull()
    off = both.filter(none | ~F.coalesce(whole, F.lit(False)))  # both rules in one pass over the join
    off = off.select(F.when(none, "case without votes").otherwise("tally").alias("rule"), F.when(none, F.to_json(F.struct(key))).otherwise(F.to_json(F.struct(key, *names))).alias("detail"))
    twice = votes.select(key, member).repartition(n, key, member).groupBy(key, member).count().filter("count > 1").join(cases.select(key), key, "left_semi")
    return off.unionByName(_out(twice, "two votes of one member", key, member, "count"))


def curated(actions: DataFrame, known: DataFrame, key: str, day: str, first: Column, last: Column, kinds: list[str]) -> DataFrame:
    """Hand-made rows (key, day, kind, quote): of known keys, within a window, of a known kind and with a quote."""
    missing = references(actions, known, [key])
    early = valid(actions, "day within window", F.col(day).between(first, last), key, day)
    odd = valid(actions, "known kind", F.col("kind").isin(kinds), key, "kind")
    return reduce(DataFrame.unionByName, [missing, early, odd, valid(actions, "quote", F.length(F.trim("quote")) > 0, key)])
