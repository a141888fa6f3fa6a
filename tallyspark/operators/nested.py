"""Arrays, maps, wide and long forms, states of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """One row for each struct of an array, with its place."""
    return rows.select(*keys, F.posexplode(array).alias("place", "_s")).select(*keys, "place", "_s.*")


def melted(rows: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide to long, cells without a value left out."""
    return rows.unpivot(keys, columns, name, value).dropna(subset=[value])


def month_slots(rows: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Twelve slots a key, null where a month has no value."""
    by = F.map_from_entries(F.collect_list(F.struct(month, value)))
    return rows.groupBy(*keys).agg(by.alias("_m")).select(*keys, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at("_m", i)).alias("months"))


def zipped(a: Column, b: Column, f) -> Column:
    """Element by element; null where either is."""
    return F.zip_with(a, b, f)


def merged_lists(rows: DataFrame, key: str, array: str, order: str) -> DataFrame:
    """The arrays of a key one after the other, in an order."""
    return rows.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, array))), lambda s: s[array])).alias(array))


def first_day_matching(actions: Column, pattern: str) -> Column:
    """Earliest date among the structs (date, text) whose text matches."""
    return F.array_min(F.transform(F.filter(actions, lambda a: a["text"].rlike(pattern)), lambda a: a["date"]))


def any_matching(actions: Column, pattern: str) -> Column:
    return F.exists(actions, lambda a: a["text"].rlike(pattern))


def kept_actions(rows: DataFrame, keys: list[str], kinds: list[str], pattern: str) -> DataFrame:
    """Actions (date, type, src, text, place) of some types or texts, the first of repeated ones, in order of date and place."""
    keep = rows.filter(F.col("type").isin(kinds) | F.col("text").rlike(pattern))
    first = keep.groupBy(*keys, "date", "type", "src", "text").agg(F.min("place").alias("place"))
    return first.orderBy(*keys, "date", "place")


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)


def filing_state(spine: DataFrame, filings: DataFrame, keys: list[str]) -> DataFrame:
    """Each key and year as usable, needs_review, not_extractable or no_filing. filings: (keys, extractable, needs_review)."""
    state = F.when(F.col("_f").isNull(), "no_filing").when(~F.col("extractable"), "not_extractable").when(F.col("needs_review"), "needs_review").otherwise("usable")
    return spine.join(filings.select(*keys, "extractable", "needs_review", F.lit(True).alias("_f")), keys, "left").withColumn("state", state).drop("_f")


def vote_role(majority: Column, opinion: Column) -> Column:
    """A justice's part in a case: joined, wrote or dissented; null without a vote."""
    side = F.when(majority == 2, "majority").when(majority == 1, "dissent")
    return F.when(side.isNotNull(), F.struct(side.alias("side"), (opinion >= 2).alias("wrote")))


def compacted(rows: DataFrame, keys: list[str], optional: list[str]) -> DataFrame:
    """Optional fields as one JSON object that leaves out those without a value."""
    return rows.select(*keys, F.to_json(F.struct(*optional)).alias("fields"))


def reduced(document: Column, schema: str) -> Column:
    """Of a JSON text only the fields of a schema, as typed values; what does not fit a type is null."""
    return F.from_json(document, schema)


def bill_stage(chamber: Column, law: Column, passed_house: Column, passed_senate: Column, reported: Column, marked_up: Column, heard: Column) -> Column:
    """How far a bill got, 1 to 6: referred, heard, marked up, out of committee, past the committee's own chamber (either for a joint one), law. Unknown is no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    here = F.when(chamber == "house", yes(passed_house)).when(chamber == "senate", yes(passed_senate)).otherwise(yes(passed_house) | yes(passed_senate))
    return F.when(yes(law), 6).when(here, 5).when(yes(reported), 4).when(yes(marked_up), 3).when(yes(heard), 2).otherwise(1)


def bipartisan(party: Column, democrats: Column, republicans: Column) -> Column:
    """Whether a bill has cosponsors of the other party than its sponsor's; of both, for a sponsor of neither."""
    d, r = F.coalesce(democrats > 0, F.lit(False)), F.coalesce(republicans > 0, F.lit(False))
    return F.when(party == "R", d).when(party == "D", r).otherwise(d & r)


def waiting_days(stage: Column, last_step: Column, today: Column, least: int = 30) -> Column:
    """Days since the last step of a bill that is not past markup, if there are so many."""
    days = F.datediff(today, last_step)
    return F.when((stage <= 3) & (days >= least), days)
