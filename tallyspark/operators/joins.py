"""Joins that named rules need: defaults, misses, intervals, as-of, cascades, neighbours.

Spans have a first day and a last one; an end of null is open in every operator here. Interval joins go by cells of days
(see cells.py), an equality, so that no operator compares all with all. A null key or day matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.operators import ranges
from tallyspark.operators.cells import MOST, length, meeting
from tallyspark.operators.classes import packed, unpacked
from tallyspark.operators.gates import GateError
from tallyspark.plans.lineage import checkpointed, small


def left_with_defaults(left: DataFrame, right: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join; the right side's columns named in defaults are filled where there is no match."""
    return left.join(right.withColumn("_hit", F.lit(True)), on, "left").select(*left.columns, *(F.when(F.col("_hit"), F.col(c)).otherwise(F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in right.columns if c not in on))


def matched_and_missed(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inner join, and the left rows without a match, for a report."""
    return left.join(right, on), left.join(right, on, "left_anti")


def inner_or_fail(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join; a left row without a match stops the run."""
    missed = left.join(right, on, "left_anti").select(*on).limit(5).collect()
    if missed:
        raise GateError(f"no match for {[tuple(r) for r in missed]}")
    return left.join(right, on)


def both_ways_missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of one side that the other lacks, with the side that has them."""
    return left.join(right, on, "left_anti").select(*on).distinct().withColumn("only_in", F.lit("left")).unionByName(right.join(left, on, "left_anti").select(*on).distinct().withColumn("only_in", F.lit("right")))


def differences(left: DataFrame, right: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison: a row for each key and field that differs, with both values as text; a key that a side lacks differs in all."""
    a, b = (df.select(*on, F.struct(*fields).alias(side)) for df, side in ((left, "l"), (right, "r")))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("left_value"), F.col(f"r.{f}").cast("string").alias("right_value")) for f in fields)))
    both = a.join(b, on, "full_outer")
    present = both.select(*on, F.col("l").isNull().alias("no_left"), F.col("r").isNull().alias("no_right"), rows.alias("d"))
    return present.filter(F.col("no_left") | F.col("no_right") | ~F.col("d.left_value").eqNullSafe(F.col("d.right_value"))).select(*on, "d.*")


def resolve_ids(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Two sources of one id: the id where they agree or one is missing, and how it was found."""
    status = F.when(first.isNull() & second.isNull(), "unmapped").when(first.isNull(), "second").when(second.isNull(), "first").when(first == second, "agree").otherwise("mismatch")
    return rows.withColumns({"id_status": status, "resolved_id": F.when(status != "mismatch", F.coalesce(first, second))})


def crosswalk(rows: DataFrame, target: str, codes: str) -> tuple[DataFrame, DataFrame]:
    """From (target, array of codes): (code, target) where a code has one target, and the codes that have several."""
    grouped = rows.select(F.col(target), F.explode(codes).alias("code")).groupBy("code").agg(F.sort_array(F.collect_set(target)).alias("targets"))
    return grouped.filter(F.size("targets") == 1).select("code", F.get("targets", F.lit(0)).alias(target)), grouped.filter(F.size("targets") > 1)


def _days(first: tuple[str, str], second: tuple[str, str]) -> Column:
    """Days that two closed spans share; null if neither has an end (least leaves nulls out)."""
    (s1, e1), (s2, e2) = first, second
    return F.datediff(F.least(e1, e2), F.greatest(s1, s2)) + 1


def shared_spans(rows: DataFrame, key: str, start: str, end: str, within: list[str] | None = None, most: int = MOST, listed: tuple[str, str] | None = None) -> DataFrame:
    """(within, key, peer, shared, first, last, n_spans, ends_at_edge): whose closed spans share days or whole numbers with whose, both ways round.

    shared sums the places in common over all pairs of their spans (spans of one key are taken not to overlap); first and last are the
    ends of what is shared; ends_at_edge: it ends where the last span of the key does. An end of null is open: shared and last are null where both are.
    listed: a column of lists of peers, and the name of a column that tells whether the peer is in the key's.

    Keys with one span go by classes of equal spans: those that meet are found once, and the pairs of their members are not moved again. Only pairs with a key
    of several spans have something to be summed over: they arise where spans meet, each once, are gathered, and are then turned round.
    """
    keys = within or []
    lists, name = listed or ("_listed", "_is_listed")
    rows = rows.select(*keys, key, F.col(start).alias("_s"), F.col(end).alias("_e"), *([lists] if listed else []))
    out = [*keys, key, "peer", "shared", "first", "last", "n_spans", "ends_at_edge", *([name] if listed else [])]
    own = rows.groupBy(*keys, key).agg(F.count("*").alias("_n"), F.when(F.count("_e") == F.count("*"), F.max("_e")).alias("_edge"), *([F.first(lists, ignorenulls=True).alias("_list")] if listed else []))
    several = own.filter("_n > 1").select(*keys, key, F.lit(True).alias("_several"))
    side = lambda df, i, k: df.select(*keys, F.col(key).alias(k), F.col("_s").alias(f"_s{i}"), F.col("_e").alias(f"_e{i}"))
    bounds = F.greatest("_s1", "_s2").alias("first"), F.least("_e1", "_e2").alias("last")
    has = lambda peers: F.coalesce(F.array_contains(peers, F.col("peer")), F.lit(False)).alias(name)
    meets = lambda a, b, **more: meeting(a, b, keys, ("_s1", "_e1"), ("_s2", "_e2"), most=most, **more)

    def alone(df: DataFrame) -> DataFrame:
        one = packed(df, [*keys, "_s", "_e"], F.struct(F.col(key).alias("key"), *([F.col(lists).alias("list")] if listed else [])), "_one").withColumnsRenamed({"_s": "_s1", "_e": "_e1"})
        two = packed(df, [*keys, "_s", "_e"], F.col(key), "_two").withColumnsRenamed({"_s": "_s2", "_e": "_e2"})
        met = meets(one, two, packed_from=(side(df, 1, key), side(df, 2, "peer"))).select(*keys, "_one", "_two", *bounds, "_e1")
        told = met.withColumns({"shared": length(met, "first", "last"), "ends_at_edge": F.col("last").eqNullSafe(F.col("_e1"))})
        pairs = unpacked(told.select(*keys, "_one", "_two", "shared", "first", "last", "ends_at_edge"), "_one", "_two")
        each = pairs.select(*keys, F.col("_one.key").alias(key), F.col("_two").alias("peer"), "shared", "first", "last", F.lit(1).cast("long").alias("n_spans"), "ends_at_edge", *([F.col("_one.list").alias("_list")] if listed else []))
        return each.filter(F.col(key) != F.col("peer")).select(*out[: len(keys) + 7], *([has(F.col("_list"))] if listed else []))

    if not several.head(1):
        return alone(rows)
    split = rows.join(several, [*keys, key], "left")
    single, rest = split.filter(F.col("_several").isNull()).drop("_several"), split.filter("_several").drop("_several")
    inner = meets(side(rest, 1, key), side(rest, 2, "peer")).filter(F.col(key) < F.col("peer"))
    met = inner.unionByName(meets(side(single, 1, key), side(rest, 2, "peer"))).select(*keys, key, "peer", *bounds)
    pairs = met.groupBy(*keys, key, "peer").agg(
        F.when(F.count("last") == F.count("*"), F.sum(length(met, "first", "last"))).alias("shared"), F.min("first").alias("first"), F.when(F.count("last") == F.count("*"), F.max("last")).alias("last"), F.count("*").alias("n_spans")
    )
    ways = F.explode(F.array(F.struct(F.col(key).alias("a"), F.col("peer").alias("b")), F.struct(F.col("peer").alias("a"), F.col(key).alias("b"))))
    both = pairs.withColumn("_way", ways).select(*keys, F.col("_way.a").alias(key), F.col("_way.b").alias("peer"), "shared", "first", "last", "n_spans")
    summed = both.join(own.drop("_n"), [*keys, key]).withColumn("ends_at_edge", F.col("last").eqNullSafe(F.col("_edge")))
    return alone(single).unionByName(summed.select(*out[: len(keys) + 7], *([has(F.col("_list"))] if listed else [])))


def peers_alongside(rows: DataFrame, group: list[str], key: str, value: str, start: str, end: str, n: int) -> DataFrame:
    """The rows of a group (one each key) that share places with a row, and for each whether it is among its n nearest by value too.

    rows are worked out once and written: they are looked at several times, to find who is near, how spans are to be cut, and who meets.
    """
    rows = checkpointed(rows.select(*group, key, value, start, end))
    near = nearest_peers(rows, group, key, value, n).groupBy(*group, key).agg(F.collect_list("peer").alias("_near"))
    return shared_spans(rows.join(near, [*group, key], "left"), key, start, end, group, listed=("_near", "is_neighbor"))


def interval_join(facts: DataFrame, spans: DataFrame, at: str, start: str, end: str, closed: bool, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Facts with the spans that hold their day. closed: the last day belongs to the span; an end of null is open."""
    spans = spans if closed else spans.withColumns({"_end": F.col(end), end: F.date_sub(F.col(end), 1)})
    found = meeting(facts, spans, keys or [], (at, at), (start, end), how, MOST)
    return found if closed else found.withColumn(end, F.col("_end")).drop("_end")


def as_of(facts: DataFrame, readings: DataFrame, keys: list[str], at: str, when: str, values: list[str], tie: str, tolerance: int | None = None, by_range: bool | None = None) -> DataFrame:
    """Each fact with the last reading of its keys at or before its time (of one time, the greatest tie), none older than the tolerance in seconds.

    Ages are told to the microsecond. A null time matches nothing; null keys are equal here.
    Both sides are put in one order and the last reading is carried on, so no pairs arise and one shuffle by keys does it. by_range: by ranges of
    that order (see ranges.py), for keys that may hold a large share of the rows; so it is without keys if nothing is said.
    """
    side = F.struct(F.col(when).alias("when"), *(F.col(v) for v in values))
    ties = F.col(tie).cast("string")
    one = readings.dropna(subset=[when]).select(*keys, F.col(when).alias("_t"), F.lit(0).alias("_side"), F.length(ties).alias("_long"), ties.alias("_tie"), side.alias("_reading"), F.lit(None).alias("_fact"))
    two = facts.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_long"), F.lit(None).cast("string").alias("_tie"), F.lit(None).alias("_reading"), F.struct(*(c for c in facts.columns if c not in keys)).alias("_fact"))
    order, both = ["_t", "_side", "_long", "_tie"], one.unionByName(two)
    if by_range or (by_range is None and not keys):
        found = ranges.last_known(both, keys, order, "_reading", "_last")
    else:
        found = both.withColumn("_last", F.last("_reading", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    close = F.lit(True) if tolerance is None else (micros("_t") - micros("_last.when") <= tolerance * 1_000_000)
    return found.filter("_side = 1").select(*keys, "_fact.*", *(F.when(close, F.col(f"_last.{v}")).alias(f"matched_{v}") for v in [*values]), F.when(close, F.col("_last.when")).alias("matched_at"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Rows of equal keys whose closed spans overlap, with the days in common (null if both are open)."""
    return meeting(a, b, keys, first, second).withColumn("days", _days(first, second))


def only_match(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have one candidate only."""
    return rows.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).filter("_n = 1").drop("_n")


def most_days(periods: DataFrame, spans: DataFrame, period: str, label: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Each period with the label it shares most days with (ties to the smaller label), the days and their share."""
    days = meeting(periods, spans, [], first, second).groupBy(period, label).agg(F.sum(_days(first, second)).alias("days"))
    order = W.partitionBy(period).orderBy(F.desc_nulls_last("days"), label)
    share = F.col("days") / F.sum("days").over(W.partitionBy(period))
    return days.withColumns({"_place": F.row_number().over(order), "share": share}).filter("_place = 1").drop("_place")


def as_of_strict(facts: DataFrame, tenures: DataFrame, at: str, start: str, end: str, label: str, key: str) -> DataFrame:
    """Each fact with the tenure that began last on or before its day; one that has ended by then, or none, stops the run.

    Tenures of one key (null keys are one) follow each other; an end of null is open, the end is the last day.
    """
    found = as_of(facts, tenures, [key], at, start, [label, end], label)
    bad = found.filter(F.col("matched_at").isNull() | (F.col(f"matched_{end}") < F.col(at))).select(key, at).limit(5).collect()
    if bad:
        raise GateError(f"no tenure for {[tuple(r) for r in bad]}")
    return found.withColumnRenamed(f"matched_{label}", label).drop("matched_at", f"matched_{end}")


def at_anchor(tenures: DataFrame, anchors: DataFrame, start: str, end: str, day: str) -> DataFrame:
    """Who holds office on fixed days: anchors (day and others) with the half-open tenures that hold each."""
    return interval_join(anchors, tenures, day, start, end, closed=False)


def exact_then_near(left: DataFrame, right: DataFrame, keys: list[str], key: str, match: str, at: str, when: str, days: int) -> DataFrame:
    """(key, match, via): by keys and day; what that leaves, by keys within so many days. A pairing counts if it has one candidate."""
    same = lambda a, b: a.join(b, [*(a[k] == b[k] for k in keys), a[at] == b[when]])

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        shifted = a.withColumn("_day", F.explode(F.sequence(F.date_sub(at, days), F.date_add(at, days))))
        return shifted.join(b, [*(shifted[k] == b[k] for k in keys), shifted["_day"] == b[when]])

    return cascade(left, right, key, match, [("exact", same), ("near", near)])


def in_probe_order(probe: DataFrame, build: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Inner join that keeps the probe side's order: place numbers its rows from 1 in a total order, those that match nothing too, by ranges of it (see ranges.py)."""
    return ranges.numbered(probe, [], order, "place").join(build, on)


def expand_years(rows: DataFrame, start: str, end: str, last: int) -> DataFrame:
    """A row for each year that a half-open span touches, up to the last; an open span runs to it."""
    to = F.least(F.coalesce(F.year(F.date_sub(F.col(end), 1)), F.lit(last)), F.lit(last))
    return rows.withColumn("year", F.explode(F.when(F.year(start) <= to, F.sequence(F.year(start), to)).otherwise(F.array().cast("array<int>"))))


def clip(rows: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Spans cut to a window; those without a day in it go."""
    return rows.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)}).filter(F.col(start) < F.col(end))


def months_before(rows: DataFrame, keys: list[str], month: str, value: str, months: int, name: str) -> DataFrame:
    """The value of the same keys so many calendar months earlier; null where that month is missing."""
    earlier = rows.select(*keys, F.add_months(month, months).alias(month), F.col(value).alias(name))
    return rows.join(earlier, [*keys, month], "left")


def cascade(left: DataFrame, right: DataFrame, key: str, match: str, rungs: list[tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]]) -> DataFrame:
    """(key, match, via): each rung pairs what the rungs before have left; a pairing counts if it has one candidate."""
    found, rest = [], left
    for name, rung in rungs:
        pairs = only_match(rung(rest, right).select(key, match).distinct(), [key]).withColumn("via", F.lit(name))
        found.append(pairs)
        rest = rest.join(pairs, key, "left_anti")
    return reduce(DataFrame.unionByName, found)


def first_known(rows: DataFrame, key: str, maps: list[tuple[DataFrame, str]], out: str) -> DataFrame:
    """The first of several code maps (code, name of target column) that knows a key; small maps are broadcast by size."""
    columns = []
    for i, (m, target) in enumerate(maps):
        rows = rows.join(m.select(F.col(m.columns[0]).alias(key), F.col(target).alias(f"_m{i}")), key, "left")
        columns.append(F.col(f"_m{i}"))
    return rows.withColumn(out, F.coalesce(*columns)).drop(*(f"_m{i}" for i in range(len(maps))))


def inherit(rows: DataFrame, key: str, parents: str, value: str) -> DataFrame:
    """(key, value, from_key, review) of the rows that have a value, or get that of their first parent (in order) that has or inherits one.

    A row is settled once each of its parents is (a parent that is no row has no value), so that the order in which rows
    are reached plays no part; a round settles one generation. review: parents have different values. Parents come before
    their rows; rows on a circle never settle and get nothing, nor do those that inherit from them alone.
    """
    base = rows.select(key, value, parents)
    settled = base.filter(F.col(value).isNotNull() | (F.coalesce(F.size(parents), F.lit(0)) <= 0)).select(key, value, F.when(F.col(value).isNotNull(), F.col(key)).alias("from_key"), F.lit(False).alias("review"))
    links = base.filter(F.col(value).isNull()).select(F.col(key), F.posexplode(parents).alias("place", "parent"))
    known = base.select(F.col(key).alias("parent"), F.lit(True).alias("_row"))
    links = checkpointed(links.join(known, "parent", "left"))
    settled = checkpointed(settled)
    while True:
        have = settled.select(F.col(key).alias("parent"), F.col(value).alias("_v"), F.col("from_key").alias("_from"), F.lit(True).alias("_settled"))
        hit = F.col("_v").isNotNull()
        reached = links.join(settled.select(key), key, "left_anti").join(have, "parent", "left")
        ready = reached.groupBy(key).agg(
            F.min_by(F.struct("_v", "_from"), F.when(hit, F.col("place"))).alias("_best"), (F.count_distinct("_v") > 1).alias("review"), F.bool_and(F.col("_settled").isNotNull() | F.col("_row").isNull()).alias("_ready")
        )
        ready = checkpointed(ready.filter("_ready").select(key, F.col("_best._v").alias(value), F.col("_best._from").alias("from_key"), "review"))
        if not ready.head(1):
            return settled.filter(F.col(value).isNotNull())
        settled = checkpointed(settled.unionByName(ready))


def nearest_peers(rows: DataFrame, group: list[str], key: str, value: str, n: int) -> DataFrame:
    """The n rows of a group nearest in one value (ties to the smaller key), whatever number of rows share a value.

    A value's n + 1 smallest keys are all that can be among the nearest, and n distinct values on each side hold n rows
    at least. They are put in order once for each value: its rows take the n first of n + 1, each without itself. A null value is farther than any other.
    """
    some = rows.withColumn("_place", F.row_number().over(W.partitionBy(*group, value).orderBy(key))).filter(F.col("_place") <= n + 1)
    values = some.groupBy(*group, value).agg(F.collect_list(F.struct(F.col(value).alias("v"), F.col(key).alias("k"))).alias("_own"))
    near = F.flatten(F.collect_list("_own").over(W.partitionBy(*group).orderBy(value).rowsBetween(-n, n)))
    apart = F.transform("_near", lambda x: F.struct((x["v"] - F.col("_value")).isNull().alias("unknown"), F.abs(x["v"] - F.col("_value")).alias("distance"), x["k"].alias("peer")))
    around = values.select(*(F.col(g).alias(f"_{g}") for g in group), F.col(value).alias("_value"), near.alias("_near")).withColumn("_near", F.slice(F.array_sort(apart), 1, n + 1))
    same = [F.col(g) == F.col(f"_{g}") for g in group] + [F.col(value).eqNullSafe(F.col("_value"))]
    others = F.filter("_near", lambda x: x["peer"] != F.col(key))
    best = rows.join(around, same).select(*group, key, F.posexplode(F.slice(others, 1, n)).alias("_at", "_p"))
    return best.select(*group, key, "_p.peer", "_p.distance", (F.col("_at") + 1).alias("rank"))


def nearest_points(points: DataFrame, pool: DataFrame, key: str, axes: list[str], n: int) -> DataFrame:
    """The n nearest rows of a small pool (checked: at most 10,000), by Euclidean distance, without the point itself; ties go to the smaller key.

    The pool is one literal in the plan, so that only a point's n rows ever exist and nothing is shuffled. Points and rows
    of the pool without all coordinates have no neighbours and are none.
    """
    rows = small(pool.select(key, *axes).dropna()).toJSON().collect()
    kinds = dict(pool.dtypes)
    struct = ", ".join(f"`{c}`: {kinds[c]}" for c in (key, *axes))
    others = F.filter(F.from_json(F.lit(f"[{','.join(rows)}]"), f"array<struct<{struct}>>"), lambda x: x[key] != F.col(key))
    distance = lambda x: F.sqrt(sum((F.pow(F.col(a) - x[a], 2) for a in axes), F.lit(0.0)))
    best = F.slice(F.array_sort(F.transform(others, lambda x: F.struct(distance(x).alias("distance"), x[key].alias("neighbour")))), 1, n)
    return points.dropna(subset=axes).select(key, F.posexplode(best).alias("_at", "_p")).select(key, "_p.neighbour", "_p.distance", (F.col("_at") + 1).alias("rank"))


def joined_and_left(rows: DataFrame, group: str, period: str, member: str) -> DataFrame:
    """(group, period, member, change): who joined and who left since the group's period before; its first period has neither."""
    have = rows.select(group, period, member).dropna().distinct()
    order = W.partitionBy(group).orderBy(period)
    periods = have.select(group, period).distinct().withColumns({"_before": F.lag(period).over(order), "_after": F.lead(period).over(order)})
    placed = have.join(periods, [group, period])
    was, next_ = (placed.filter(F.col(c).isNotNull()).select(group, F.col(c).alias(period), member, F.col(period).alias("_own")) for c in ("_before", "_after"))
    joined = was.join(have, [group, period, member], "left_anti").select(group, F.col("_own").alias(period), member, F.lit("joined").alias("change"))
    left = next_.join(have, [group, period, member], "left_anti").select(group, period, member, F.lit("left").alias("change"))
    return joined.unionByName(left)


def inverted(rows: DataFrame, member: str, item: str, role_rank: str) -> DataFrame:
    """Many to many the other way round: a member's items, each with the best role."""
    return rows.groupBy(member, item).agg(F.min(role_rank).alias("role")).groupBy(member).agg(F.sort_array(F.collect_list(F.struct(item, "role"))).alias("items"))


def drawn_and_totals(rows: DataFrame, shapes: DataFrame, key: str, value: str) -> DataFrame:
    """One row: totals of all, of those with a shape and of those without."""
    return rows.join(shapes.select(key, F.lit(True).alias("_drawn")), key, "left").agg(
        F.sum(value).alias("total"), F.sum(F.when(F.col("_drawn"), F.col(value))).alias("drawn"), F.sum(F.when(F.col("_drawn").isNull(), F.col(value))).alias("undrawn")
    )
