"""Roster matches against every row compared with every member."""

import random
import re
import unicodedata
from collections import Counter

from tallyspark.operators.rosters import roster_match
from tallyspark.plans.inspect import explained

ROWS, ROSTER = "row long, written string, given string, place string", "member string, family string, first string, state string"


def letters(s):
    return re.sub("[^a-z]", "", "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower())


def variants(name):
    parts = [w for w in map(letters, (name or "").split()) if w]
    return {"".join(parts), "".join(reversed(parts)), parts[0], parts[-1]} - {""} if parts else set()


def brute(row, roster):
    _, last, first, place = row
    state = re.fullmatch(r"([A-Z]{2})\d{2}", (place or "").strip())
    if not state:
        return None, "bad_state"
    found = {m: f for m, family, f, s in roster if m is not None and s == state[1] and variants(family) & variants(last)}
    if not found:
        return None, "no_candidate"
    if len(found) == 1:
        return next(iter(found)), "ok"
    near = [m for m, f in found.items() if letters(f)[:3] == letters(first)[:3]]
    return (near[0], "ok_disambiguated") if len(near) == 1 else (None, "ambiguous")


def matched(spark, rows, roster):
    found = roster_match(spark.createDataFrame(rows, ROWS), spark.createDataFrame(roster, ROSTER), "row", "written", "given", "place", "member", "family", "first", "state")
    return {r["row"]: (r["member"], r["reason"]) for r in found.collect()}


def test_each_reason(spark):
    roster = [("a", "Watson Coleman", "Bonnie", "NJ"), ("b", "Velázquez", "Nydia", "NY"), ("c", "Smith", "Adam", "WA"), ("d", "Smith", "Adrian", "NE"), ("e", "Smith", "Jason", "MO"), ("f", "Smith", "Jacob", "MO"), ("g", "Smith", "Jasper", "MO")]
    rows = [
        (1, "Coleman", "B", "NJ12"), (2, "COLEMAN WATSON", "B", "NJ12"), (3, "WatsonColeman", None, " NJ12 "), (4, "Velazquez", "N", "NY07"), (5, "Smith", "Adam", "WA09"),
        (6, "Smith", "Jacob Q.", "MO08"), (7, "Smith", "Jason", "MO08"), (8, "Jones", "X", "MO08"), (9, "Smith", "Adam", "WA"), (10, None, "Adam", "WA09"), (11, "Smith", None, "MO01"), (12, "Smith", "Adam", None), (13, "O'Neil", "T", "WA09"),
    ]
    got = matched(spark, rows, roster)
    assert got == {r[0]: brute(r, roster) for r in rows}
    assert got[2] == ("a", "ok")
    assert got[6] == ("f", "ok_disambiguated")
    assert got[7] == (None, "ambiguous")  # Jason and Jasper
    assert got[9] == (None, "bad_state")


def test_against_every_member(spark):
    rng = random.Random(4)
    words = ["van", "der", "Berg", "Ng", "O'Hara", "Núñez", "Li-Wu", "", "Żak"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
    roster = [(f"m{i % 150}" if rng.random() > 0.03 else None, name(), rng.choice(["Ann", "Anna", "Bob", "", None]), rng.choice(["AA", "BB", None])) for i in range(150)]
    roster += [(f"x{i}", f"Rare{chr(97 + i)} Berg", "Cy", "AA") for i in range(10)]
    rows = [(1000 + i, f"rare{chr(97 + i)}", "Di", "AA07") for i in range(5)]
    rows += [(i, name() if rng.random() > 0.05 else None, rng.choice(["Ann", "Annette", "Bo", "", None]), rng.choice(["AA01", "BB22", "AA1", "", None])) for i in range(300)]
    got = matched(spark, rows, roster)
    assert got == {r[0]: brute(r, roster) for r in rows}
    assert set(Counter(x for _, x in got.values())) == {"ok", "ok_disambiguated", "ambiguous", "no_candidate", "bad_state"}


def test_a_name_that_all_bear_makes_no_pairs(spark):
    """A third of a large roster and of all rows share one name: rows met stay in proportion, and no list is kept."""
    roster = [(f"m{i}", "Smith" if i % 3 else f"Name{chr(97 + i % 26)}", f"First{chr(97 + i % 7)}", "AA") for i in range(3000)]
    rows = [(i, "Smith" if i % 3 else "Nobody", "Fir", "AA01") for i in range(3000)]
    rows, roster = spark.createDataFrame(rows, ROWS), spark.createDataFrame(roster, ROSTER)
    found = roster_match(rows, roster, "row", "written", "given", "place", "member", "family", "first", "state")
    plan = explained(found)
    assert "collect_" not in plan
    assert not re.search("NestedLoop|Cartesian", plan)
    assert Counter(r["reason"] for r in found.collect()) == {"ambiguous": 2000, "no_candidate": 1000}


def test_empty_tables(spark):
    assert matched(spark, [], [("a", "X", "Y", "AA")]) == {}
    assert matched(spark, [(1, "X", "Y", "AA01")], []) == {1: (None, "no_candidate")}
