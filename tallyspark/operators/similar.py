"""Pairs of rows that share words, found by an index of rare words and not by comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.classes import packed, unpacked

#: A word is frequent if it makes this share of all words of all rows; so there are at most so many of them.
FREQUENT = 1000


def _words(df: DataFrame, words: str) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(F.col(words), F.array().cast(dict(df.dtypes)[words]))))


def frequent_words(sides: list[tuple[DataFrame, str]]) -> list[str]:
    """The words that make 1 / FREQUENT of all at least, the rarest first: FREQUENT at most."""
    each = None
    for df, words in sides:
        one = df.select(F.explode(_words(df, words)).alias("word"))
        each = one if each is None else each.unionAll(one)
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * FREQUENT >= max(total, FREQUENT)).orderBy("n", "word").collect()
    return [r["word"] for r in found]


def candidates(left: DataFrame, right: DataFrame, block: str, a: str, b: str, least: float) -> DataFrame:
    """(block, _l, _r, _short, _long): the pairs of classes that are to be compared, each once, with lists of the rows of each and its words.

    A class has the rows of one block with equal words; a large one is several lists (see classes.py). If the shorter of two rows has n words and must
    share k of them, one of its n - k + 1 rarest is among the other's: so a class is looked up by its rarest words only, among classes whose words are no fewer.
    """
    frequent = F.array(*map(F.lit, frequent_words([(left, a), (right, b)]))).cast("array<string>")

    def side(df: DataFrame, words: str, name: str) -> DataFrame:
        classes = packed(df, [block, words], F.struct(F.lit(0).alias("_row"), *(F.col(c) for c in df.columns if c not in (block, words))), name)
        ranked = F.array_sort(F.transform(_words(classes, words), lambda w: F.struct(F.array_position(frequent, w).alias("rank"), w.alias("word"))))
        return classes.select(block, F.struct(F.col(words), F.col(name).alias("rows")).alias(name), F.transform(ranked, lambda x: x["word"]).alias("words"))

    need = lambda w: F.ceil(F.size(w) * least - 1e-9)
    rarest = lambda w: F.slice(w, 1, F.greatest(F.size(w) - need(w) + 1, F.lit(0)).cast("int"))

    def looked_up(short: DataFrame, long: DataFrame, equal: bool) -> DataFrame:
        one = short.filter(F.size("words") > 0).withColumnRenamed("words", "_short").withColumn("_word", F.explode(rarest(F.col("_short"))))
        two = long.filter(F.size("words") > 0).withColumnRenamed("words", "_long").withColumn("_word", F.explode("_long"))
        met = one.join(two, [block, "_word"])
        fits = F.size("_short") <= F.size("_long") if equal else F.size("_short") < F.size("_long")
        first = F.get(F.array_intersect(rarest(F.col("_short")), F.col("_long")), F.lit(0)) == F.col("_word")  # of several words in common one tells
        return met.filter(fits & first).select(block, "_l", "_r", "_short", "_long")

    one, two = side(left, a, "_l"), side(right, b, "_r")
    return looked_up(one, two, True).unionByName(looked_up(two, one, False))


def token_overlap(left: DataFrame, right: DataFrame, block: str, a: str, b: str, least: float) -> DataFrame:
    """Pairs of a left and a right row of one block whose common words make a share of the shorter list, at least ``least`` (over 0), with that share as overlap.

    Repeated words count once; rows without words, or without a block, are in no pair. The two sides' columns but the block must differ in name.
    Classes of rows with equal words are compared; the pairs of their rows are made last, and are not moved again.
    """
    if not 0 < least <= 1:
        raise ValueError("the least share is over 0 and at most 1")
    pairs = candidates(left, right, block, a, b, least).withColumn("overlap", F.size(F.array_intersect("_short", "_long")) / F.size("_short"))
    found = pairs.filter(F.col("overlap") >= least).select(block, F.col(f"_l.{a}").alias(a), F.col(f"_r.{b}").alias(b), F.col("_l.rows").alias("_l"), F.col("_r.rows").alias("_r"), "overlap")
    own = lambda df, words, name: [F.col(words) if c == words else F.col(f"{name}.{c}").alias(c) for c in df.columns if c != block]
    return unpacked(found, "_l", "_r").select(block, *own(left, a, "_l"), *own(right, b, "_r"), "overlap")
