"""Quality rules under weak supervision: rules vote or abstain, and their accuracies come from the votes alone.

Method: each rule looks at counts of a text and votes good (1), bad (0) or abstains (null). Texts are good or bad, and
bad ones are mostly bad in one way: one kind of bad text for each rule, which that rule was written for. The model is

    P(votes) = good * prod over rules of P(vote | good)  +  sum over kinds j of weight[j] * P(vote of j | kind j) * prod over other rules of P(vote | bad in another way)

Expectation-maximisation over the numbers of each combination of votes (at most 3 ** rules rows, whatever the corpus)
estimates all of it. A rule whose bad votes are explained by a kind counts; where bad texts tend to hit several rules, one
whose bad votes fall on good and bad texts alike is found to be unreliable, and a text stays in spite of it. Votes alone
cannot tell a rule that hits good texts at random from one that hits a kind of bad text that no other rule knows: there
Beta priors, worth a share of all texts, say what a rule is taken for. A text stays if its posterior probability of being
good is a half or more. Everything runs in DataFrame expressions.

Defined cases: a null text has no words; a text without any vote (it has no words) has the prior share of good ones as
its quality; an empty table keeps the starting accuracies; a quality of exactly a half stays; repeated rows each give a
row and count each; a text of any length is counted whole; columns other than doc_id and text are ignored, whatever
their names. 3-word windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import forget, written

WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
PAUSES = ",;:"


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _number_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(without(text, characters))).cast("long")


def repeated_words(grams: Column, unique: Column, width: int) -> Column:
    """How many words lie in windows that are not unique.

    grams: a hash of each window in order; unique: those that occur once, in order. One pass goes through both:
    a window that is not the next unique one is a repeated one, and covers the words that none before has covered.
    """
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.lit(0).alias("covered"), F.lit(0).cast("long").alias("n"))

    def step(acc, gram):
        alone = F.coalesce(F.get(unique, acc["seen"]) == gram, F.lit(False))
        end = acc["at"] + width
        return F.struct(
            (acc["seen"] + F.when(alone, 1).otherwise(0)).alias("seen"),
            (acc["at"] + 1).alias("at"),
            F.when(alone, acc["covered"]).otherwise(end).alias("covered"),
            (acc["n"] + F.when(alone, 0).otherwise(end - F.greatest(acc["covered"], acc["at"]))).cast("long").alias("n"),
        )

    return F.aggregate(grams, start, step, lambda acc: acc["n"])


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row of docs (text and the columns to keep): counts of words, characters, symbols, lines and repeats."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(*keep, text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.char_length(without(x, BLANK)) > 0)
    two = one.select(
        *keep,
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        lines.alias("lines"),
        F.char_length(without(F.col("text"), BLANK)).cast("long").alias("word_chars"),
        _number_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        _number_of(F.col("text"), CAPITALS).alias("n_capitals"),
        _number_of(F.col("text"), "!").alias("n_bangs"),
        _number_of(F.col("text"), ".").alias("n_stops"),
        _number_of(F.col("text"), DIGITS).alias("n_digits"),
        _number_of(F.col("text"), PAUSES).alias("n_pauses"),
        F.right(F.rtrim(F.col("text"), F.lit(BLANK)), F.lit(1)).isin(*".!?").alias("ends"),
    )
    n = F.size("words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    counts = ("word_chars", "n_symbols", "n_capitals", "n_bangs", "n_stops", "n_digits", "n_pauses", "ends")
    three = two.select(*keep, *counts, n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), grams.alias("grams"))
    four = three.withColumn("ordered", F.sort_array("grams"))
    five = four.withColumn("twice", F.filter("ordered", lambda x, i: F.coalesce(F.get(F.col("ordered"), i - 1) == x, F.lit(False))))
    six = five.drop("ordered").withColumn("unique", F.array_except("grams", "twice"))
    repeats = F.when(F.size("twice") > 0, repeated_words(F.col("grams"), F.col("unique"), 3)).otherwise(F.lit(0).cast("long"))
    return six.select(*keep, "n_words", *counts, "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """The rules over text_counts(): 1 good, 0 bad, null abstains. Shares are whole-number percentages, so that engines agree."""

    def rule(bad: str, good: str) -> Column:
        return F.expr(f"CASE WHEN n_words = 0 THEN NULL WHEN {bad} THEN 0 WHEN {good} THEN 1 END")

    return {
        "symbols": rule("100 * n_symbols > 10 * n_words", "100 * n_symbols <= 3 * n_words"),
        "repeats": rule("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 20 * n_words"),
        "shouting": rule("100 * n_capitals > 40 * word_chars OR 100 * n_bangs > 20 * n_words", "100 * n_capitals <= 15 * word_chars AND 100 * n_bangs <= 5 * n_words"),
        "same_lines": rule("n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
        "word_length": rule("10 * word_chars < 25 * n_words OR word_chars > 15 * n_words", "10 * word_chars >= 30 * n_words AND word_chars <= 10 * n_words"),
        "stops": rule("1000 * n_stops < 5 * n_words", "1000 * n_stops >= 10 * n_words"),
        "ending": rule("NOT ends", "ends"),
        "length": rule("n_words < 100", "n_words >= 200"),
        "digits": rule("1000 * n_digits > 5 * word_chars", "1000 * n_digits <= 2 * word_chars"),
        "pauses": rule("1000 * n_pauses < 10 * n_words OR 1000 * n_pauses > 100 * n_words", "1000 * n_pauses BETWEEN 20 * n_words AND 90 * n_words"),
    }


#: Starting values and means of the priors: P(good vote | good), P(bad vote of its rule | kind), P(bad vote | bad in another way), share of good texts.
SPARES, CATCHES, STRAYS, GOOD = 0.97, 0.6, 0.03, 0.85


def start_model(rules: int) -> dict:
    return {"good": GOOD, "weight": [(1 - GOOD) / rules] * rules, "spares": [SPARES] * rules, "catches": [CATCHES] * rules, "strays": [STRAYS] * rules}


def _likelihoods(votes: Column, model: dict) -> Column:
    """Log of P(class and votes): good first, then each rule's kind of bad. votes: array of 1, 0, null."""
    table = lambda values: F.array(*(F.lit(float(x)) for x in values))
    pick = lambda one, zero: lambda v, i: F.when(v == 1, F.get(table(one), i)).when(v == 0, F.get(table(zero), i)).otherwise(0.0)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    log = lambda values: [math.log(x) for x in values]
    less = lambda values: [1 - x for x in values]
    strays = log(less(model["strays"])), log(model["strays"])
    own = [[x - y for x, y in zip(a, b, strict=True)] for a, b in zip((log(less(model["catches"])), log(model["catches"])), strays, strict=True)]
    good = F.lit(math.log(model["good"])) + total(F.transform(votes, pick(log(model["spares"]), log(less(model["spares"])))))
    bad = F.transform(votes, lambda v, i: F.get(table(log(model["weight"])), i) + pick(*own)(v, i))
    base = total(F.transform(votes, pick(*strays)))
    return F.concat(F.array(good), F.transform(F.arrays_zip(bad.alias("x"), F.array_repeat(base, len(model["weight"])).alias("y")), lambda z: z["x"] + z["y"]))


def with_posteriors(rows: DataFrame, model: dict, votes: str = "votes") -> DataFrame:
    """rows with p: the probability of good, and of each kind of bad, given the array of votes."""
    likely = rows.withColumn("_log", _likelihoods(F.col(votes), model))
    likely = likely.withColumn("_likely", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    return likely.withColumn("p", F.transform("_likely", lambda x: x / F.aggregate("_likely", F.lit(0.0), lambda a, y: a + y))).drop("_log", "_likely")


def fit_accuracies(patterns: DataFrame, rules: int, rounds: int = 60, tolerance: float = 1e-4, strength: float = 0.1) -> dict:
    """patterns (votes: array of each rule's, n) to the model: the share of good texts and, per rule, the weight of its kind, P(good vote | good)
    (spares), P(bad vote | its kind) (catches) and P(bad vote | another kind) (strays).

    Each round is one aggregation over patterns and rules. strength: the priors' weight as a share of all texts that vote
    (shared out among the kinds for catches), so that they mean the same at every size.
    """
    model = start_model(rules)
    n = patterns.agg(F.sum("n")).first()[0]
    if not n:
        return model
    at = F.sequence(F.lit(0), F.lit(rules - 1))
    for _ in range(rounds):
        seen = with_posteriors(patterns, model)
        entry = F.transform(at, lambda i: F.struct(i.alias("rule"), F.get("votes", i).alias("vote"), (F.col("n") * F.get("p", F.lit(0))).alias("good"), (F.col("n") * F.get("p", i + 1)).alias("own"), (F.col("n") * (1 - F.get("p", F.lit(0)))).alias("bad")))
        sums = seen.select(F.inline(entry)).groupBy("rule").agg(
            F.sum("own").alias("mass"), *(F.sum(F.when(F.col("vote") == v, F.col(c)).otherwise(0.0)).alias(f"{c}_{v}") for c in ("good", "own", "bad") for v in (0, 1))
        )
        found = sorted(sums.collect())  # a row for each rule
        s = strength * n
        rate = lambda hits, misses, mean, weight: (hits + mean * weight) / (hits + misses + weight)
        mass = [r["mass"] for r in found]
        new = {
            "good": (n - sum(mass) + 1) / (n + 1 + rules),
            "weight": [(x + 1) / (n + 1 + rules) for x in mass],
            "spares": [rate(r["good_1"], r["good_0"], SPARES, s) for r in found],
            "catches": [rate(r["own_0"], r["own_1"], CATCHES, s / rules) for r in found],
            "strays": [rate(r["bad_0"] - r["own_0"], r["bad_1"] - r["own_1"], STRAYS, s) for r in found],
        }
        moved = max(abs(new["good"] - model["good"]), *(abs(a - b) for k in new if k != "good" for a, b in zip(new[k], model[k], strict=True)))
        model = new
        if moved < tolerance:
            break
    return model


def judge_quality(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): the base counts, base_failed, kept and quality (posterior probability of good)."""
    rules = votes()
    counted = text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    counted = written(counted.select("*", F.array(*rules.values()).alias("votes")))
    patterns = written(counted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1))
    model = fit_accuracies(patterns, len(rules))
    forget(patterns)
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    quality = F.get("p", F.lit(0))
    return with_posteriors(counted, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= 0.5)).alias("kept"), quality.alias("quality"))
