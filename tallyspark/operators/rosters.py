"""Names of one source found in another: a roster's members by family name and place, first names where that leaves several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import last_name_variants, letters_key, strip_marks

#: How a row's place may be written: a state alone or with a district's two digits.
STATE = r"^([A-Z]{2})\d{2}$"


def state_of(place: Column, pattern: str = STATE) -> Column:
    """The state of a place, null if it is not written as the pattern has it."""
    return F.nullif(F.regexp_extract(F.trim(place), pattern, 1), F.lit(""))


def name_start(first: Column, letters: int) -> Column:
    return F.left(letters_key(strip_marks(first)), F.lit(letters))


def roster_match(rows: DataFrame, roster: DataFrame, key: str, last: str, first: str, place: str, member: str, member_last: str, member_first: str, state: str, letters: int = 3, pattern: str = STATE, salts: int = 8) -> DataFrame:
    """(key, member, reason) of every row: the one member whose family name, in any way of writing it, and state are the row's.

    reason is ok; ok_disambiguated, where of several members one has the row's first name as far as its first letters; ambiguous; no_candidate;
    or bad_state, where the place is not written as the pattern has it. A member is given in the first two cases only.

    The roster is an index of (variant, state) and of (variant, state, first letters), each entry with its least and greatest member: that
    tells none, one and several apart over any number of variants, so no entry holds a list, no row meets members by pairs, and a name
    that half the roster bears costs what any other does. Rows meet the index by an equality; each entry stands there ``salts`` times, so that
    a name that many rows bear is dealt out over as many tasks. key identifies a row: rows that share one are taken as several ways of writing one row. Null names are empty: an empty family name has no variants and finds nobody.
    """
    names = lambda c: F.array_compact(last_name_variants(strip_marks(F.coalesce(F.col(c), F.lit("")))))
    start = lambda c: name_start(F.coalesce(F.col(c), F.lit("")), letters)
    members = roster.select(F.explode(names(member_last)).alias("variant"), F.col(state).alias("state"), start(member_first).alias("start"), F.col(member).alias("m")).dropna()
    two = [F.min("m").alias("least"), F.max("m").alias("most")]
    by_start = members.groupBy("variant", "state", "start").agg(*two)
    by_name = by_start.groupBy("variant", "state").agg(F.min("least").alias("name_least"), F.max("most").alias("name_most"))
    salted = lambda index: index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = rows.select(F.col(key), state_of(F.col(place), pattern).alias("state"), start(first).alias("start"), F.pmod(F.hash(key), F.lit(salts)).alias("salt"), F.explode_outer(names(last)).alias("variant"))
    met = asked.join(salted(by_name), ["variant", "state", "salt"], "left").join(salted(by_start), ["variant", "state", "salt", "start"], "left")
    found = met.groupBy(key).agg(F.max("state").alias("state"), *(f(c).alias(c) for c, f in (("name_least", F.min), ("name_most", F.max), ("least", F.min), ("most", F.max))))
    reason = (
        F.when(F.col("state").isNull(), "bad_state").when(F.col("name_least").isNull(), "no_candidate").when(F.col("name_least") == F.col("name_most"), "ok")
        .when(F.col("least") == F.col("most"), "ok_disambiguated").otherwise("ambiguous")
    )
    return found.withColumn("reason", reason).select(key, F.when(F.col("reason") == "ok", F.col("name_least")).when(F.col("reason") == "ok_disambiguated", F.col("least")).alias(member), "reason")
