"""Printed grids out of workbooks: columns found by their headings, sections carried down to their totals, totals held against sums.

Rows are (keys, row, cells: column letter -> text), as readers.xlsx_sheets() gives them; keys name one sheet, which is small. Nothing is found by
row number or by a column's letter, so that sheets of many layouts are one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.operators.gates import GateError, _out
from tallyspark.sources.readers import tri_state


def plain(text: Column) -> Column:
    """Capitals, single spaces, no footnote stars behind."""
    return F.regexp_replace(F.upper(F.trim(F.regexp_replace(text, r"\s+", " "))), r"\s*\*+$", "")


def column_number(letters: Column) -> Column:
    """A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def headed_columns(rows: DataFrame, keys: list[str], group: str, names: dict[str, str], needed: Sequence[str] = ()) -> DataFrame:
    """(keys, header, column, field): the columns under a group heading, up to the next heading of its row, by the names printed in the row below.

    names: printed heading (as plain() has it) -> field. A sheet without the heading, a name that isn't known or comes twice, or a needed field that is missing, stops the run.
    """
    cells = rows.select(*keys, "row", F.explode("cells").alias("column", "text")).withColumns({"at": column_number(F.col("column")), "text": plain(F.col("text"))}).filter("text <> ''")
    tops = cells.filter(F.col("text") == group).groupBy(*keys).agg(F.min(F.struct("row", "at")).alias("_top"))
    missing = rows.select(*keys).distinct().join(tops, keys, "left_anti").limit(3).collect()
    if missing:
        raise GateError(f"no heading {group!r} in {[tuple(r) for r in missing]}")
    after = cells.join(tops, keys).filter((F.col("row") == F.col("_top.row")) & (F.col("at") > F.col("_top.at"))).groupBy(*keys).agg(F.min("at").alias("_next"))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    under = cells.join(tops, keys).join(after, keys, "left").filter((F.col("row") == F.col("_top.row") + 1) & (F.col("at") >= F.col("_top.at")) & (F.col("_next").isNull() | (F.col("at") < F.col("_next"))))
    found = under.select(*keys, F.col("row").alias("header"), "column", F.element_at(table, F.col("text")).alias("field"), "text")
    bad = found.groupBy(*keys, "field").agg(F.count("*").alias("n"), F.first("text").alias("text")).filter("field IS NULL OR n > 1").limit(3).collect()
    if bad:
        raise GateError(f"headings that aren't known or come twice: {[tuple(r) for r in bad]}")
    lacks = found.groupBy(*keys).agg(F.collect_set("field").alias("f")).filter(F.size(F.array_except(F.array(*map(F.lit, needed)).cast("array<string>"), "f")) > 0).limit(3).collect()
    if lacks:
        raise GateError(f"fields are missing of {list(needed)}: {[tuple(r) for r in lacks]}")
    return found.drop("text")


def sectioned(rows: DataFrame, keys: list[str], columns: DataFrame, label: str, sections: Sequence[tuple[str, str]], grand: str) -> DataFrame:
    """(keys, row, section, label, kind, field, state, n) of the cells under the headed columns.

    sections: (name, label of its total), in order; a row belongs to the section whose total comes next after it, so that a section's own heading, a
    row without numbers, plays no part. kind is row, total or grand (section null); rows after the grand total are footnotes and are left out. Totals that are missing, or in another order, stop the run.
    """
    marks = [plain(F.lit(total)) for _, total in sections] + [plain(F.lit(grand))]
    number = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(marks))):
        number = F.when(plain(F.col("cells")[label]) == m, i).otherwise(number)
    by = W.partitionBy(*keys).orderBy("row")
    heads = columns.select(*keys, "header").distinct()
    body = rows.join(heads, keys).filter(F.col("row") > F.col("header")).withColumn("_mark", number)
    body = body.withColumn("_passed", F.count("_mark").over(by.rowsBetween(W.unboundedPreceding, -1)))
    wrong = body.filter("_mark IS NOT NULL").groupBy(*keys).agg(F.bool_and(F.col("_mark") == F.col("_passed")).alias("_fine"), F.count("*").alias("_n")).filter(~F.col("_fine") | (F.col("_n") != len(marks)))
    none = rows.select(*keys).distinct().join(body.filter("_mark IS NOT NULL").select(*keys).distinct(), keys, "left_anti")
    bad = [tuple(r) for r in wrong.select(*keys).limit(3).collect() + none.limit(3).collect()]
    if bad:
        raise GateError(f"totals are missing or out of order in {bad}")
    name = F.get(F.array(*(F.lit(n) for n, _ in sections)), F.col("_passed").cast("int"))
    kind = F.when(F.col("_mark") == len(sections), "grand").when(F.col("_mark").isNotNull(), "total").otherwise("row")
    inside = body.filter(F.col("_passed") <= len(sections)).select(*keys, "row", F.when(kind != "grand", name).alias("section"), F.trim(F.col("cells")[label]).alias("label"), kind.alias("kind"), F.explode("cells").alias("column", "text"))
    cells = inside.join(columns.select(*keys, "column", "field"), [*keys, "column"]).withColumn("_cell", tri_state(F.col("text"))).filter("_cell.state IS NOT NULL")
    return cells.select(*keys, "row", "section", "label", "kind", "field", "_cell.state", "_cell.n")


def printed_totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Gate over sectioned(): sections whose rows don't sum to their printed total, and sheets whose totals don't sum to the grand one.

    Where numbers are suppressed the sum may be less than the total, but not more. A total that is printed for no rows, or rows without one, violate too.
    """
    value, hidden = F.when(F.col("state") == "value", F.col("n")), F.col("state") == "suppressed"

    def held(parts: DataFrame, whole: DataFrame, on: list[str], rule: str) -> DataFrame:
        sums = parts.groupBy(*on, "field").agg(F.coalesce(F.sum(value), F.lit(0)).alias("sum"), F.bool_or(hidden).alias("_hidden"))
        both = sums.join(whole.groupBy(*on, "field").agg(F.max(value).alias("printed")), [*on, "field"], "full_outer")
        fits = F.when(F.col("_hidden"), F.col("sum") <= F.col("printed")).otherwise(F.col("sum") == F.col("printed"))
        return _out(both.filter(~F.coalesce(fits, F.lit(False))), rule, *on, "field", "sum", "printed")

    rows, totals = cells.filter("kind = 'row'"), cells.filter("kind = 'total'")
    return held(rows, totals, [*keys, "section"], "section total").unionByName(held(totals, cells.filter("kind = 'grand'"), keys, "grand total"))
