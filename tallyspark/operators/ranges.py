"""Ordered rules over ranges of the order, not over keys: what a row needs of rows before its range comes from a row for each range.

Rows are dealt out by ranges of (keys, order), so that a key with any share of the rows, or no key at all, falls into as many tasks as its
rows need. Within a range the rules are windows over (range, keys). Only the first key of a range can have begun before it, so one row a
range says what is carried into it: the end of the last range that had rows, as long as the keys are the same. Those rows, one for each
range, are put in order in one task and broadcast; they grow with the number of ranges and not with the data.

The order must be total but for rows that may stand in any order, and ascending with nulls first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.plans.lineage import checkpointed


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _part, the number of their range of (keys, order); the numbers ascend with the order, and are fixed by a checkpoint."""
    return checkpointed(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def within(keys: list[str], order: list[str]):
    """The window of a range's rows of equal keys."""
    return W.partitionBy("_part", *keys).orderBy(*order)


def carried_in(placed: DataFrame, ends: DataFrame, keys: list[str], state: str, chain: str | None = None) -> DataFrame:
    """placed with ``state`` as it was at the end of the ranges before, for rows whose keys began there, else null.

    ends: (_part, the keys of the range's last row as _keys, state of those keys). chain: how states of ranges with one last key add up: sum, max or last
    (the last that isn't null); without it, the last range's own counts.
    """
    over = W.partitionBy("_keys").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = {"sum": F.sum(state).over(over), "max": F.max(state).over(over), "last": F.last(state, ignorenulls=True).over(over), None: F.col(state)}[chain]
    before = F.lag(F.struct(F.col("_keys").alias("keys"), F.col("_whole").alias("state"))).over(W.orderBy("_part"))
    table = ends.withColumn("_whole", whole).select("_part", before.alias("_in"))
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_in.keys.{k}")), keys, F.col("_in").isNotNull())
    return placed.join(F.broadcast(table), "_part", "left").withColumn(state, F.when(same, F.col("_in.state"))).drop("_in")


def keys_of(keys: list[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 1 within their keys, in a total order."""
    placed = in_ranges(rows, keys, order)
    sizes = placed.groupBy("_part", *keys).agg(F.count("*").alias("_size")).groupBy("_part").agg(F.max(F.struct(keys_of(keys).alias("k"), F.col("_size").alias("n"))).alias("_end"))
    ends = sizes.select("_part", F.col("_end.k").alias("_keys"), F.col("_end.n").alias("_before"))
    return carried_in(placed, ends, keys, "_before", "sum").withColumn(name, F.row_number().over(within(keys, order)) + F.coalesce("_before", F.lit(0))).drop("_before", "_part")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, apart: Column | None = None) -> DataFrame:
    """windows.runs() by ranges: runs of equal values in order, their first and last place, length and number within their keys."""
    placed = in_ranges(rows, keys, order)
    place, by = F.struct(*order), within(keys, order)
    last = F.max_by(F.struct(keys_of(keys).alias("k"), F.struct(place.alias("at"), F.col(value).alias("value")).alias("s")), F.struct(*keys, *order))
    ends = placed.groupBy("_part").agg(last.alias("_end")).select("_part", F.col("_end.k").alias("_keys"), F.col("_end.s").alias("_state"))
    marked = carried_in(placed, ends, keys, "_state").withColumn("_last", F.coalesce(F.lag(F.struct(place.alias("at"), F.col(value).alias("value"))).over(by), F.col("_state")))
    marked = marked.withColumn("_before", F.col("_last.at"))
    goes_on = F.col("_last").isNotNull() & F.col(value).eqNullSafe(F.col("_last.value"))
    if apart is not None:
        goes_on = goes_on & ~F.coalesce(apart, F.lit(False))
    numbered = marked.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    pieces = checkpointed(numbered.groupBy("_part", *keys, "_run", value).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("length")))
    top = F.max(F.struct(keys_of(keys).alias("k"), F.col("_run").alias("r")))
    begun = pieces.groupBy("_part").agg(top.alias("_end")).select("_part", F.col("_end.k").alias("_keys"), F.col("_end.r").alias("_runs"))
    counted = carried_in(pieces, begun, keys, "_runs", "sum").withColumn("run", F.col("_run") + F.coalesce("_runs", F.lit(0)))
    return counted.groupBy(*keys, "run", value).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"))


def last_known(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the last value that isn't null at or before each, in order."""
    placed = in_ranges(rows, keys, order)
    known = F.col(value).isNotNull()
    ends = placed.groupBy("_part").agg(
        F.max(keys_of(keys)).alias("_keys"), F.max_by(F.struct(keys_of(keys).alias("k"), F.col(value).alias("v")), F.when(known, F.struct(*keys, *order))).alias("_known")
    )
    ends = ends.select("_part", "_keys", F.when(F.col("_known.k").eqNullSafe(F.col("_keys")), F.col("_known.v")).alias("_state"))
    own = F.last(value, ignorenulls=True).over(within(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return carried_in(placed, ends, keys, "_state", "last").withColumn(name, F.coalesce(own, "_state")).drop("_state", "_part")


def parts(rows: DataFrame, keys: list[str], order: list[str], end: str, gap: Column | None = None) -> DataFrame:
    """rows with _of, a number that rows of equal keys share if none of them, in order, begins after the greatest end of all before it in its keys.

    order begins with where a row starts. gap: how far beyond that end a row may start and still go on with what is before; without it, starting
    at the end begins a part. So parts share no place, however long a chain of rows is.
    """
    placed, by = in_ranges(rows, keys, order), within(keys, order)
    reach = placed.groupBy("_part", *keys).agg(F.max(end).alias("_reach")).groupBy("_part").agg(F.max(F.struct(keys_of(keys).alias("k"), F.col("_reach").alias("r"))).alias("_end"))
    ends = reach.select("_part", F.col("_end.k").alias("_keys"), F.col("_end.r").alias("_reach"))
    reached = carried_in(placed, ends, keys, "_reach", "max")
    before = F.greatest(F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    fresh = before.isNull() | ((F.col(order[0]) >= before) if gap is None else (F.col(order[0]) > before + gap))
    marked = checkpointed(reached.withColumn("_new", fresh.cast("int")).drop("_reach").withColumn("_n", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))))
    top = F.max(F.struct(keys_of(keys).alias("k"), F.col("_n").alias("n")))
    begun = marked.groupBy("_part").agg(top.alias("_end")).select("_part", F.col("_end.k").alias("_keys"), F.col("_end.n").alias("_before"))
    return carried_in(marked, begun, keys, "_before", "sum").withColumn("_of", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_new", "_n", "_before", "_part")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) of keys that have a value, exact, the mean of the two middle values where their number is even.

    Equal values are counted before they move; a range knows from the sizes of the ranges before which places in its key's order it holds, so
    the two in the middle are read off where they are, and no task or buffer holds a key's values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = in_ranges(counts, keys, [value])
    sizes = placed.groupBy("_part", *keys).agg(F.sum("_n").alias("_size"))
    order = W.partitionBy(*keys).orderBy("_part")
    sizes = sizes.withColumns({"_to": F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "_all": F.sum("_size").over(W.partitionBy(*keys))})
    middle = {"_low": F.expr("(_all - 1) div 2"), "_high": F.expr("_all div 2")}
    holds = lambda c: (F.col(c) >= F.col("_to") - F.col("_size")) & (F.col(c) < F.col("_to"))
    wanted = sizes.withColumns(middle).filter(holds("_low") | holds("_high")).select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.col("_to") - F.col("_size")).alias("_from"), "_low", "_high")
    at = placed.withColumn("_upto", F.sum("_n").over(within(keys, [value]).rowsBetween(W.unboundedPreceding, W.currentRow)))
    met = at.join(wanted, reduce(lambda c, x: c & F.col(x[1]).eqNullSafe(F.col(f"_k{x[0]}")), enumerate(keys), F.col("_part") == F.col("_p")))
    here = lambda c: F.max(F.when((F.col(c) >= F.col("_from") + F.col("_upto") - F.col("_n")) & (F.col(c) < F.col("_from") + F.col("_upto")), F.col(value)))
    found = met.groupBy(*keys).agg(here("_low").alias("_a"), here("_high").alias("_b"))
    return found.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) / 2).alias("median"))
