"""Word overlap by an index of rare words, against all pairs compared."""

import random
import re
from collections import Counter

import pytest

from tallyspark.operators.similar import candidates, frequent_words, token_overlap
from tallyspark.plans.inspect import explained

LEFT, RIGHT = "g string, i int, w array<string>, more int", "g string, j int, v array<string>"


def made_rows(rng, n, vocabulary):
    """Words of very uneven frequency."""
    words = lambda: [f"w{int(rng.random() ** 3 * vocabulary)}" for _ in range(rng.randint(0, 7))]
    return [(rng.choice(["x", "x", "y", None]), i, words() if rng.random() > 0.05 else None) for i in range(n)]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 1.0])
def test_overlaps_equal_all_pairs(spark, least):
    rng = random.Random(3)
    one, two = made_rows(rng, 90, 40), made_rows(rng, 80, 40)
    one.append(("x", 1000, ["w1", None, "w1", "w2"]))
    left, right = spark.createDataFrame([(*r, 5) for r in one], LEFT), spark.createDataFrame(two, RIGHT)
    want = Counter()
    for g, i, w in one:
        for h, j, v in two:
            a, b = {*(w or [])} - {None}, {*(v or [])} - {None}
            if g == h and g and a and b and len(a & b) / min(len(a), len(b)) >= least:
                want[g, i, j, round(len(a & b) / min(len(a), len(b)), 9)] += 1
    found = token_overlap(left, right, "g", "w", "v", least)
    assert found.columns == ["g", "i", "w", "more", "j", "v", "overlap"]
    assert Counter((r["g"], r["i"], r["j"], round(r["overlap"], 9)) for r in found.collect()) == want
    assert want


def test_few_pairs_are_compared(spark):
    """A word that all rows have, and rare ones: what is compared is near what is found, not all pairs."""
    rng = random.Random(8)
    rows = [("x", i, ["all", f"r{i // 2}", f"s{i // 2}", f"t{rng.randrange(500)}"]) for i in range(1000)]
    left, right = spark.createDataFrame([(*r, 0) for r in rows], LEFT), spark.createDataFrame(rows, RIGHT)
    compared, found = candidates(left, right, "g", "w", "v", 0.75).count(), token_overlap(left, right, "g", "w", "v", 0.75)
    assert found.count() >= 2000  # each with itself and its twin, both ways round
    assert compared < 6 * found.count() < 50_000 < len(rows) ** 2
    assert not re.search("NestedLoop|Cartesian", explained(found))


def test_frequent_words_are_bounded(spark):
    rows = spark.createDataFrame([("x", i, [f"w{j}" for j in range(i % 50)]) for i in range(500)], RIGHT)
    words = frequent_words([(rows, "v")])
    assert 0 < len(words) <= 1000
    assert words.index("w30") < words.index("w1")
    assert token_overlap(spark.createDataFrame([], LEFT), rows, "g", "w", "v", 0.5).count() == 0
    with pytest.raises(ValueError, match="share"):
        token_overlap(rows, rows, "g", "v", "v", 0)


def test_equal_rows_are_compared_once(spark):
    """300 rows of two lists of words: two classes, whose pairs are made last and moved no more."""
    rows = [("x", i, ["a", "b"] if i % 2 else ["c", "b"]) for i in range(300)]
    left, right = spark.createDataFrame([(*r, 5) for r in rows], LEFT), spark.createDataFrame(rows, RIGHT)
    assert candidates(left, right, "g", "w", "v", 0.5).count() == 4
    found = token_overlap(left, right, "g", "w", "v", 0.5)
    assert found.count() == 300 * 300
    assert not re.search("Join|Aggregate", explained(found).split("Exchange")[0])
