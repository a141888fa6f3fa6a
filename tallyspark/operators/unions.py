"""Several sources of one thing put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.operators import gates
from tallyspark.operators.joins import interval_join, overlaps


def with_provenance(**sources: DataFrame) -> DataFrame:
    """Rows of all sources, each with its source's name."""
    return reduce(DataFrame.unionByName, (df.withColumn("source", F.lit(name)) for name, df in sources.items()))


def one_source_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Gate: keys that rows of several sources share."""
    found = rows.groupBy(*keys).agg(F.count_distinct("source").alias("n"))
    return gates.valid(found, "one source", F.col("n") == 1, *keys, "n")


def spliced(history: DataFrame, current: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """History, then the current feed where history has no row; a missing value is taken from the overrides."""
    both = history.unionByName(current.join(history, keys, "left_anti"))
    return both.join(overrides.select(*keys, F.col(value).alias("_o")), keys, "left").withColumn(value, F.coalesce(value, "_o")).drop("_o")


def summed(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two series added where both have a value."""
    return a.select(*keys, value).join(b.select(*keys, F.col(value).alias("_b")), keys).select(*keys, (F.col(value) + F.col("_b")).alias(value))


def persons(*chambers: DataFrame, key: str, period: str) -> DataFrame:
    """Each person once a period, with the chambers they sat in."""
    rows = reduce(DataFrame.unionByName, chambers)
    return rows.groupBy(key, period).agg(F.sort_array(F.collect_set("chamber")).alias("chambers"))


def tenure_or_last(facts: DataFrame, spans: DataFrame, at: str, start: str, end: str, label: str) -> DataFrame:
    """Each fact with the half-open span that holds it; facts after all spans have begun, and in none, get the last."""
    held = interval_join(facts, spans.select(start, end, label), at, start, end, closed=False, how="left")
    last = spans.agg(F.max(start).alias("s"), F.max_by(label, start).alias("name")).first()
    after = F.col(at) >= F.lit(last["s"])
    return held.withColumn(label, F.coalesce(F.col(label), F.when(after, F.lit(last["name"])))).drop(start, end)


def day_shares(periods: DataFrame, spans: DataFrame, period: str, label: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Days that each label has in a period, its share, whose the last day is, and whether the period is shared."""
    both = overlaps(periods, spans, [], first, second)
    last = F.col(second[1]).isNull() | (F.col(second[1]) >= F.col(first[1]))
    days = both.groupBy(period, label).agg(F.sum("days").alias("days"), F.max(last).alias("has_last_day"))
    part = W.partitionBy(period)
    return days.withColumns({"share": F.col("days") / F.sum("days").over(part), "blended": F.count("*").over(part) > 1})


def representatives(rows: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """The best row of each of the n largest groups, the largest first."""
    size, best = W.partitionBy(group), W.partitionBy(group).orderBy(F.desc(score), key)
    one = rows.withColumns({"size": F.count("*").over(size), "_p": F.row_number().over(best)}).filter("_p = 1").drop("_p")
    return one.orderBy(F.desc("size"), group).limit(n)


def stacked_by(rows: DataFrame, keys: list[str], region: str, regions: list[str], value: str, state: str) -> DataFrame:
    """A column for each region, suppressed cells left out."""
    return rows.filter(F.col(state) == "value").groupBy(*keys).pivot(region, regions).agg(F.sum(value))


def totals_and_items(rows: DataFrame, year: str, term: str, topic: str, item: str) -> DataFrame:
    """A year's total, numbers by topic and by term, and its items in order."""
    by = lambda c, out: rows.groupBy(year, c).count().groupBy(year).agg(F.sort_array(F.collect_list(F.struct(c, "count"))).alias(out))
    whole = rows.groupBy(year).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    return whole.join(by(topic, "topics"), year).join(by(term, "terms"), year)
