"""Rules over ordered rows: ranks, changes, runs, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.operators import ranges


def ranked(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """A rank without ties; the order must be total."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_k(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return ranked(rows, keys, *order).filter(F.col("rank") <= k)


def ends(rows: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n greatest, and of the others the n least."""
    top = rows.orderBy(F.desc_nulls_last(value), key).limit(n).withColumn("end", F.lit("top"))
    bottom = rows.join(top.select(key), key, "left_anti").orderBy(F.asc_nulls_last(value), key).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def nulls_last(column: str, descending: bool) -> Column:
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def reversible(order: list[tuple[str, bool]], reverse: bool) -> list[Column]:
    """Sort keys (column, descending), all of them turned round together, nulls last either way."""
    return [nulls_last(c, d != reverse) for c, d in order]


def by_name(column: str) -> Column:
    """Names as readers expect them: without regard to case and accents first."""
    return F.collate(F.col(column), "UNICODE")


def like_for_like(rows: DataFrame, keys: list[str], year: str, value: str, partial: str, basis: str) -> DataFrame:
    """Change against the year just before, null unless both years are whole, of one basis, and the earlier is positive."""
    order = W.partitionBy(*keys).orderBy(year)
    before = F.lag(F.struct(year, value, partial, basis)).over(order)
    good = (F.col(year) - F.col(f"_b.{year}") == 1) & ~F.col(partial) & ~F.col(f"_b.{partial}") & F.col(basis).eqNullSafe(F.col(f"_b.{basis}")) & (F.col(f"_b.{value}") > 0)
    return rows.withColumn("_b", before).withColumn("change", F.when(good, F.col(value) / F.col(f"_b.{value}") - 1)).drop("_b")


def change_or_new(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Change against the year before; a key that year lacks counts as 0, if the year itself is there."""
    years = rows.select((F.col(year) + 1).alias(year), F.lit(True).alias("_there")).distinct()
    before = rows.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias("_before"))
    return rows.join(years, year, "left").join(before, [*keys, year], "left").withColumn("change", F.when(F.col("_there"), F.col(value) - F.coalesce("_before", F.lit(0)))).drop("_there", "_before")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, apart: Column | None = None, by_range: bool | None = None) -> DataFrame:
    """Runs of equal values in order: first and last place, length, and number within their keys. apart: whether a row, by _before (the place before it), starts anew.

    by_range: by ranges of the order (see ranges.py), for keys that may hold a large share of the rows; so it is without keys if nothing is said.
    """
    if by_range or (by_range is None and not keys):
        return ranges.runs(rows, keys, order, value, apart)
    by = W.partitionBy(*keys).orderBy(*order)
    same = F.lag(F.lit(True)).over(by).isNotNull() & F.col(value).eqNullSafe(F.lag(value).over(by))
    marked = rows.withColumns({"_same": same, "_before": F.lag(F.struct(*order)).over(by)})
    new = F.when(F.col("_same") & ~F.coalesce(apart, F.lit(False)), 0).otherwise(1) if apart is not None else F.when(F.col("_same"), 0).otherwise(1)
    marked = marked.withColumn("_new", new).withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    place = F.struct(*order)
    return marked.groupBy(*keys, "run", value).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("length"))


def flag_spans(rows: DataFrame, keys: list[str], month: str, flag: str) -> DataFrame:
    """Spans of months whose flag is 1, each ending at the month after its last."""
    found = runs(rows, keys, [month], flag).filter(F.col(flag) == 1)
    return found.select(*keys, F.col(f"first.{month}").alias("start"), F.add_months(F.col(f"last.{month}"), 1).alias("end"))


def year_runs(rows: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Runs of consecutive years."""
    island = F.col(year) - F.row_number().over(W.partitionBy(*keys).orderBy(year))
    return rows.select(*keys, year).distinct().withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(year).alias("first"), F.max(year).alias("last")).drop("_i")


def scaled_segments(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Values from 0 to 1 within their key (0.5 if all are equal), and whether the step to the next spans more than a year."""
    part, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(year)
    low, high = F.min(value).over(part), F.max(value).over(part)
    return rows.withColumns({"scaled": F.when(high == low, 0.5).otherwise((F.col(value) - low) / (high - low)), "gap_after": F.coalesce(F.lead(year).over(order) - F.col(year) > 1, F.lit(False))})


def merged_spans(rows: DataFrame, keys: list[str], start: str, end: str, label: str) -> DataFrame:
    """Neighbouring spans of one label as one; a gap or another label between parts them."""
    by = W.partitionBy(*keys).orderBy(start)
    on = F.lag(end).over(by).eqNullSafe(F.col(start)) & F.lag(label).over(by).eqNullSafe(F.col(label))
    marked = rows.withColumn("_new", F.when(on, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    open_ = F.max(F.col(end).isNull())
    return marked.groupBy(*keys, "_i", label).agg(F.min(start).alias(start), F.when(~open_, F.max(end)).alias(end)).drop("_i")


def contiguous_spans(rows: DataFrame, keys: list[str], start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Half-open spans cut to a window, with gap: days without a span since the one before (negative where they overlap), null for the first."""
    cut = rows.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.coalesce(F.col(end), high), high)}).filter(F.col(start) < F.col(end))
    before = F.max(end).over(W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    return cut.withColumn("gap", F.datediff(F.col(start), before))


def stack_edges(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Lower and upper edge of each band of a stack."""
    upper = F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col(value))


def long_gaps(rows: DataFrame, keys: list[str], day: str, nominal: int) -> DataFrame:
    """Dates more than twice the nominal days after the one before."""
    by = W.partitionBy(*keys).orderBy(day)
    return rows.withColumn("gap", F.datediff(day, F.lag(day).over(by))).filter(F.col("gap") > 2 * nominal)


def out_of_order(rows: DataFrame, number: str, day: str, keys: list[str]) -> DataFrame:
    """Rows whose day is before that of the number just below."""
    return rows.withColumn("_before", F.lag(day).over(W.partitionBy(*keys).orderBy(number))).filter(F.col(day) < F.col("_before")).drop("_before")


def trailing_status(rows: DataFrame, keys: list[str], month: str, months: int) -> DataFrame:
    """The last so many months of a key are preliminary."""
    last = F.max(month).over(W.partitionBy(*keys))
    return rows.withColumn("status", F.when(F.col(month) > F.add_months(last, -months), "preliminary").otherwise("final"))


def first_and_latest(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """First and latest value, total change and change a year."""
    both = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min_by(value, year).alias("first"), F.max_by(value, year).alias("last"))
    years = F.col("last_year") - F.col("first_year")
    return both.withColumn("change", F.col("last") - F.col("first")).withColumn("a_year", F.when(years > 0, F.col("change") / years))


def latest_known(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def trailing_window(last: Column, months: int, back_years: int) -> tuple[Column, Column]:
    """Half-open window of the last so many months, moved back by years."""
    end = F.add_months(F.trunc(last, "month"), 1 - 12 * back_years)
    return F.add_months(end, -months), end


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Repeated names get -2, -3, ... in order."""
    n = F.row_number().over(W.partitionBy(name).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat_ws("-", F.col(name), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def preferred_source(rows: DataFrame, keys: list[str], source: str, ranking: list[str]) -> DataFrame:
    """Per key the rows of the source that ranks first among those that have any."""
    rank = F.array_position(F.array(*(F.lit(s) for s in ranking)), F.col(source))
    return rows.withColumn("_r", F.when(rank > 0, rank)).withColumn("_b", F.min("_r").over(W.partitionBy(*keys))).filter("_r = _b").drop("_r", "_b")
