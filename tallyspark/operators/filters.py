"""Filters under named rules, as conditions or as frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows in scope, and one row that tells how many were kept and left out."""
    inside = F.coalesce(condition, F.lit(False))
    return rows.filter(inside), rows.agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("left_out"))


def usable(confidence: Column, flagged: Column, year: Column, first: int, last: int) -> Column:
    return (confidence == "high") & ~flagged & year.between(first, last)


def has_vote(state: Column, number: Column, territories: list[str], exceptions: list[tuple[str, int]], statehood: dict[str, int]) -> Column:
    """Seats that vote: no territory, none of the listed (state, session), no state before it was one."""
    listed = reduce(lambda a, b: a | b, ((state == s) & (number == n) for s, n in exceptions), F.lit(False))
    early = reduce(lambda a, b: a | b, ((state == s) & (number < n) for s, n in statehood.items()), F.lit(False))
    return ~state.isin(territories) & ~listed & ~early


def facets(conditions: dict[str, Column], skip: str | None = None) -> Column:
    """All conditions, or all but one, so that a facet's own chart does not follow its selection."""
    return reduce(lambda a, b: a & b, (c for name, c in conditions.items() if name != skip), F.lit(True))


def facet_counts(rows: DataFrame, columns: dict[str, str], conditions: dict[str, Column]) -> DataFrame:
    """(facet, value, n): each facet counted under the other facets' selections, in one pass over the rows."""
    flags = F.explode(F.array(*(F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value"), facets(conditions, name).alias("shown")) for name, c in columns.items()))).alias("f")
    return rows.select(flags).select("f.*").groupBy("facet", "value").agg(F.count_if("shown").alias("n")).filter("n > 0")


def votes_of(kind: str, side: Column, wrote: Column) -> Column:
    return {"all": side.isNotNull(), "majority": side == "majority", "dissent": side == "dissent", "wrote": wrote}[kind]


def plottable(rows: DataFrame, x: str, y: str, votes: str, least: int = 10) -> DataFrame:
    return rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.coalesce(votes, F.lit(0)) >= least)).orderBy(x, y)


def held_today(rows: DataFrame, keys: list[str], roles: str, titles: DataFrame) -> DataFrame:
    """Roles (array of title, end) without an end whose title a small table knows."""
    each = rows.select(*keys, F.explode(roles).alias("r")).filter("r.end IS NULL").select(*keys, F.col("r.title").alias("title"))
    return each.join(titles, "title")


def find(rows: DataFrame, query: str, columns: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows, in an order, one of whose columns contains the query, whatever the case."""
    hit = reduce(lambda a, b: a | b, (F.lower(c).contains(query.lower()) for c in columns))
    return rows.filter(hit).orderBy(*order).limit(n)


def of_area(rows: DataFrame, area: str, choice: str, top: list[str]) -> DataFrame:
    """ALL, one of the top areas, or OTHER: everything outside them, unknown areas too."""
    if choice == "ALL":
        return rows
    return rows.filter(~F.coalesce(F.col(area).isin(top), F.lit(False)) if choice == "OTHER" else F.col(area) == choice)


def clamped_years(year: Column, low: int, high: int, first: Column, last: Column) -> Column:
    """Years asked for, cut to those there are, both ends included."""
    return year.between(F.greatest(F.lit(low), first), F.least(F.lit(high), last))
