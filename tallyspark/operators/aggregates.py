"""Aggregations under named rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.operators import gates, ranges
from tallyspark.plans.lineage import small


def band_counts(rows: DataFrame, keys: list[str], band: Column, bands: int) -> DataFrame:
    """Per key: n, and the numbers of each band 0 to bands - 1 in columns d0, d1, ..."""
    return rows.withColumn("_band", band).groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col("_band") == b).alias(f"d{b}") for b in range(bands)))


def with_all_row(counts: DataFrame, keys: list[str], group: str, numbers: list[str]) -> DataFrame:
    """The rows of each group, and before them one of all groups together (group is null there)."""
    totals = counts.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in numbers)).withColumn(group, F.lit(None).cast(counts.schema[group].dataType))
    return totals.unionByName(counts.select(*keys, group, *numbers))


def top_and_other(rows: DataFrame, group: str, n: int, label: str = "Other") -> DataFrame:
    """rows with the n largest groups (by number of rows, then name) kept and all others, null among them, under one label.

    Which groups are the largest is settled on all rows, before any filter.
    """
    largest = rows.filter(F.col(group).isNotNull()).groupBy(group).count().orderBy(F.desc("count"), group).limit(n).select(group, F.lit(True).alias("_top"))
    return rows.join(F.broadcast(largest), group, "left").withColumn(group, F.when(F.col("_top"), F.col(group)).otherwise(F.lit(label))).drop("_top")


def sum_or_null(x: Column) -> Column:
    """Null only if nothing is there to sum."""
    return F.sum(x)


def measures_by_kind(rows: DataFrame, keys: list[str], kind: str, value: str, kinds: dict[str, str]) -> DataFrame:
    """One column for each kind of transaction, as kinds names them."""
    return rows.groupBy(*keys).agg(*(F.sum(F.when(F.col(kind) == k, F.col(value))).alias(name) for k, name in kinds.items()))


def merged_codes(rows: DataFrame, codes: DataFrame, keys: list[str], code: str, target: str, values: list[str], name: str) -> DataFrame:
    """Several source codes of one target add up; the names they had are listed."""
    return rows.join(codes, code).groupBy(target, *keys).agg(*(F.sum(v).alias(v) for v in values), F.sort_array(F.collect_set(name)).alias("names"))


def ratio_of_sums(part: Column, whole: Column) -> tuple[Column, Column]:
    """Sum of parts over sum of wholes where both are there, and how many rows had both."""
    both = part.isNotNull() & whole.isNotNull()
    return F.try_divide(F.sum(F.when(both, part)), F.sum(F.when(both, whole))), F.count_if(both)


def window_change(rows: DataFrame, keys: list[str], day: str, value: str, before: tuple[str, str], after: tuple[str, str], least: int) -> DataFrame:
    """Sums within two half-open windows and the change in percent, null unless each has so many rows."""
    inside = lambda w: (F.col(day) >= F.lit(w[0]).cast("timestamp")) & (F.col(day) < F.lit(w[1]).cast("timestamp"))
    sums = rows.groupBy(*keys).agg(*(x for name, w in (("before", before), ("after", after)) for x in (F.sum(F.when(inside(w), F.col(value))).alias(name), F.count_if(inside(w)).alias(f"n_{name}"))))
    full = (F.col("n_before") >= least) & (F.col("n_after") >= least) & (F.col("before") > 0)
    return sums.withColumn("change", F.when(full, 100 * (F.col("after") - F.col("before")) / F.col("before")))


def spread(x: Column) -> Column:
    return F.when(F.count(x) >= 2, F.max(x) - F.min(x))


def median_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median, mean and number of the values of each key; keys without any have nulls and 0. No task holds a key's values (see ranges.py)."""
    whole = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return with_median(whole, rows, keys, value, "median").select(*keys, "median", "mean", "n")


def with_median(by_key: DataFrame, rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """by_key, a row for each of the keys, with the exact median of a value of rows."""
    if not keys:
        one = {"_one": F.lit(1)}
        return with_median(by_key.withColumns(one), rows.withColumns(one), ["_one"], value, name).drop("_one")
    found = ranges.medians(rows, keys, value).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("median").alias(name))
    return by_key.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))


def pair_gap(rows: DataFrame, group: str, key: str, value: str, weight: str) -> DataFrame:
    """Of each group the two rows of most weight: the gap and mean of their values; groups with fewer aren't listed."""
    order = W.partitionBy(group).orderBy(F.desc_nulls_last(weight), key)
    two = rows.withColumn("_place", F.row_number().over(order)).filter("_place <= 2")
    return two.groupBy(group).agg(F.count("*").alias("_n"), (F.max(value) - F.min(value)).alias("gap"), F.avg(value).alias("mean")).filter("_n = 2").drop("_n")


def most_common(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key, the smallest of equals."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_last(value))
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def best_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in an order that leaves no ties."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def stage_counts(rows: DataFrame, keys: list[str], stage: str, last: int) -> DataFrame:
    """How many stopped at each stage and how many reached it; stages without rows are there.

    A gate stops the run if a row's stage is null or not one of 0 to last: it would be in no count.
    """
    gates.require(gates.valid(rows, f"{stage} is 0 to {last}", F.col(stage).isin(list(range(last + 1))), *keys, stage))
    stops = rows.groupBy(*keys, stage).agg(F.count("*").alias("stopped"))
    grid = rows.select(*keys).distinct().withColumn(stage, F.explode(F.sequence(F.lit(0), F.lit(last))))
    full = grid.join(stops, [*keys, stage], "left").withColumn("stopped", F.coalesce("stopped", F.lit(0).cast("long")))
    return full.withColumn("reached", F.sum("stopped").over(W.partitionBy(*keys).orderBy(F.desc(stage)).rowsBetween(W.unboundedPreceding, 0)))


def dense_months(rows: DataFrame, day: str) -> DataFrame:
    """Rows a month from the first to the last, months without any as 0."""
    counts = rows.groupBy(F.trunc(F.col(day).cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return span.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def dense_periods(rows: DataFrame, keys: list[str], day: str, unit: str) -> DataFrame:
    """(keys, period, n): rows a week, month, quarter or year of each key, from its first to its last, periods without any as 0; period is its first day.

    Keys are null-safe; rows without a day count nowhere, and a key with none has no periods.
    """
    steps = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}
    counts = rows.filter(F.col(day).isNotNull()).groupBy(*keys, F.date_trunc(unit, F.col(day)).cast("date").alias("period")).agg(F.count("*").alias("n"))
    every = counts.groupBy(*keys).agg(F.min("period").alias("_a"), F.max("period").alias("_b")).filter("_a IS NOT NULL").select(*keys, F.explode(F.sequence("_a", "_b", F.expr(steps[unit]))).alias("period"))
    have = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("period").alias("_p"), "n")
    same = [F.col("period") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
    return every.join(have, same, "left").select(*keys, "period", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def decades(x: Column) -> Column:
    return (F.floor(x / 10) * 10).cast("int")


def clipped_decades(year: Column, first: int, last: int) -> Column:
    """The decade of a year as a span cut to a window; null for a year outside."""
    start = decades(year)
    return F.when(year.between(first, last), F.struct(F.greatest(start, F.lit(first)).alias("from"), F.least(start + 9, F.lit(last)).alias("to")))


def year_range(rows: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    return rows.groupBy(*keys, F.year(day).alias("year")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, day).alias("last"))


def periods_served(rows: DataFrame, key: str, period: str) -> DataFrame:
    """How many different periods a key had up to each."""
    return rows.select(key, period).distinct().withColumn("served", F.count("*").over(W.partitionBy(key).orderBy(period).rowsBetween(W.unboundedPreceding, 0)))


def banded_value(rows: DataFrame, key: str, counts: str, bands: DataFrame) -> DataFrame:
    """A map of band -> number as a total of middles; whether an open-ended band is among them. bands: (band, middle, open), a small table."""
    each = rows.select(key, F.explode(counts).alias("band", "n"))
    return each.join(small(bands), "band", "left").groupBy(key).agg(F.sum(F.col("n") * F.col("middle")).alias("total"), F.bool_or("open").alias("open_ended"), F.count_if(F.col("middle").isNull()).alias("unknown_bands"))


def peak_and_low(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First greatest and first least value with their places, which may be of any type with an order; no places if all are equal."""
    least, greatest = F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("at"))), F.min(F.struct((-F.col(value)).alias("v"), F.col(order).alias("at")))
    stats = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias("high"), F.min(value).alias("low"), greatest.alias("_high"), least.alias("_low"))
    flat = F.col("high") == F.col("low")
    return stats.select(*keys, "high", "low", F.when(~flat, F.col("_high.at")).alias("at_high"), F.when(~flat, F.col("_low.at")).alias("at_low"))


def least_of(rows: DataFrame, keys: list[str], share: str, parts: list[str]) -> DataFrame:
    """The least share among some columns of each row's key, nulls left out; null if there is none."""
    return rows.groupBy(*keys).agg(F.min(F.least(*parts) if len(parts) > 1 else F.col(parts[0])).alias(share))


def vote_stats(votes: DataFrame, keys: list[str], side: str, close: Column) -> DataFrame:
    """Per key: votes with a known side, with the majority and in dissent, how many were in close cases and of those with the majority, and the share of all with the majority."""
    known, won = F.col(side).isin("majority", "dissent"), F.col(side) == "majority"
    seen = votes.groupBy(*keys).agg(
        F.count_if(known).alias("took"), F.count_if(won).alias("majority"), F.count_if(F.col(side) == "dissent").alias("dissent"), F.count_if(known & close).alias("close"), F.count_if(won & close).alias("close_majority")
    )
    return seen.withColumn("share", F.when(F.col("took") > 0, F.col("majority") / F.col("took")))


def revisions(old: DataFrame, new: DataFrame, keys: list[str], value: str, status: str, tolerance: float) -> DataFrame:
    """What changed between two deliveries: new, removed, missing (a value came or went), revised.

    A change of a final row always counts, one of a preliminary row only above the tolerance.
    """
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new"), F.col(status).alias("status"), F.lit(True).alias("_b"))
    gap = F.abs(F.col("new") - F.col("old"))
    kind = (
        F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("old").isNull() != F.col("new").isNull(), "missing")
        .when((gap > 0) & ((F.col("status") == "final") | (gap > tolerance * F.abs("old"))), "revised")
    )
    return a.join(b, keys, "full_outer").withColumn("change", kind).filter("change IS NOT NULL").drop("_a", "_b")


def residual(rows: DataFrame, keys: list[str], series: str, value: str, whole: str, parts: list[str]) -> DataFrame:
    """A whole minus its named parts, where all of them are there."""
    wide = rows.groupBy(*keys).pivot(series, [whole, *parts]).agg(F.first(value))
    return wide.dropna(subset=[whole, *parts]).select(*keys, (F.col(whole) - sum((F.col(p) for p in parts), F.lit(0.0))).alias("residual"))


def net_and_drawn(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sum, and the sum of what is positive, which alone can be drawn."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("net"), F.sum(F.greatest(F.col(value), F.lit(0))).alias("drawn"))


def missed_by_reason(left: DataFrame, right: DataFrame, on: list[str], reason: Column) -> DataFrame:
    """Left rows without a match, counted by reason, and the number of right rows without one."""
    missed = left.join(right, on, "left_anti").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return missed.unionByName(right.join(left, on, "left_anti").agg(F.count("*").alias("n")).select(F.lit("right only").alias("reason"), "n"))


def folded(rows: DataFrame, keys: list[str], values: list[str], same: list[str]) -> DataFrame:
    """Rows of one key under several labels add up, null only if all are; columns that must agree stop the run if they don't."""
    agree = F.count_distinct(F.struct(*same)) == 1
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values), *(F.when(agree, F.first(c)).otherwise(F.raise_error(F.lit(f"{c} differs within a key"))).alias(c) for c in same))


def share_risen(rows: DataFrame, keys: list[str], change: str) -> DataFrame:
    """The share of changes above 0 and the exact median of the changes of each key."""
    shares = rows.groupBy(*keys).agg(F.avg(F.when(F.col(change) > 0, 1.0).when(F.col(change).isNotNull(), 0.0)).alias("share_risen"))
    return with_median(shares, rows, keys, change, "median_change")
