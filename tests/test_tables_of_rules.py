"""Rule tables, transitions, document walks and coded shards."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.rules import Guard, Rule, Step, changes, final_state, first_rule, furthest_state, rule_report
from tallyspark.operators import documents
from tallyspark.sources import sinks

RULES = (
    Rule("naming", r"(?i)\bname\b", (Guard(r"(?i)\bpark\b", after=r"(?i)\bas\b"), Guard(r"(?i)\bsurvey\b"))),
    Rule("honor", r"(?i)\bmedal\b"),
    Rule("honor", r"(?i)^thanking\b", (Guard(r"\bAct$"),)),
    Rule("memorial", r"(?i)\bmemorial\b", (Guard(r"(?i)\bcouncil\b"),)),
)


@pytest.mark.parametrize(
    ("title", "found", "report"),
    [
        ("To name the park hall", "naming", [("naming", None)]),  # park stands before "as"
        ("To name the hall as a park", None, [("naming", 0)]),
        ("To name a survey after a medal", "honor", [("naming", 1), ("honor", None)]),
        ("Thanking the guard", "honor", [("honor", None)]),
        ("Thanking the guard Act", None, [("honor", 0)]),
        ("A memorial council medal", "honor", [("honor", None), ("memorial", 0)]),
        ("A memorial", "memorial", [("memorial", None)]),
        ("", None, []),
        (None, None, []),
    ],
)
def test_rules_in_order_with_exclusions(spark, title, found, report):
    df = spark.createDataFrame([(title,)], "t string").select(first_rule(F.col("t"), RULES).alias("f"), rule_report(F.col("t"), RULES).alias("r"))
    row = df.first()
    assert row["f"] == found
    assert [tuple(x) for x in row["r"]] == report


STEPS = (Step(None, "vetoed", "vetoed"), Step("vetoed", "override", "law"), Step("referred", "reported", "reported"), Step("reported", "passed", "passed"), Step("passed", "signed", "law"))


def test_transitions_fold_over_actions(spark):
    rows = [["reported", "passed", "signed"], ["passed", "reported"], ["reported", "passed", "vetoed"], ["reported", None, "vetoed", "signed", "override"], [], None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "i int, a array<string>")
    order = ("referred", "reported", "passed", "law")
    got = [tuple(r) for r in df.orderBy("i").select(final_state(F.col("a"), "referred", STEPS), furthest_state(F.col("a"), "referred", STEPS, order), F.transform(changes(F.col("a"), "referred", STEPS), lambda x: F.concat_ws(":", x["place"].cast("string"), x["state"]))).collect()]
    assert got == [
        ("law", "law", ["0:reported", "1:passed", "2:law"]), ("reported", "reported", ["1:reported"]), ("vetoed", "passed", ["0:reported", "1:passed", "2:vetoed"]),
        ("law", "law", ["0:reported", "2:vetoed", "4:law"]), ("referred", "referred", []), (None, None, None),
    ]


def walked(value, path="$", depth=0, name=None):
    yield path, depth, name, value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walked(v, f"{path}.{k}", depth + 1, k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked(v, f"{path}[{i}]", depth + 1)


def test_nodes_of_documents_equal_a_plain_walk(spark):
    rng = random.Random(5)

    def made(depth):
        kind = rng.random() if depth < 6 else 1
        if kind < 0.35:
            return {k: made(depth + 1) for k in rng.sample(["id", "b", "size", "item"], rng.randint(0, 4))}
        if kind < 0.6:
            return [made(depth + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, "x", None, True, "é", 2.5])

    docs = [(i, json.dumps({"id": i, "in": made(0)})) for i in range(60)] + [(90, None), (91, "not json"), (92, "[]"), (93, "3"), (94, '{"id": {"id": [1, {"id": null}]}}')]
    df = spark.createDataFrame(docs, "k int, doc string")
    got = Counter((r["k"], r["path"], r["depth"], r["name"]) for r in documents.nodes(df, ["k"], "doc").select("k", "path", "depth", "name").collect())
    want = Counter()
    for k, doc in docs:
        if doc and doc != "not json":
            want.update((k, p, d, n) for p, d, n, _ in walked(json.loads(doc)))
    assert got == want
    named = Counter((r["k"], r["path"], json.dumps(json.loads(r["value"]), sort_keys=True)) for r in documents.members_named(df, ["k"], "doc", "id").collect())
    wanted = Counter()
    for k, doc in docs:
        if doc and doc != "not json":
            wanted.update((k, p, json.dumps(v, sort_keys=True)) for p, _, n, v in walked(json.loads(doc)) if n == "id")
    assert named == wanted


def test_objects_anywhere(spark):
    doc = {"groups": [{"groupName": "g", "fileName": "a.xlsx", "size": 3}, {"in": {"groupName": "g", "fileName": "b.xlsx", "size": "x", "deeper": [{"groupName": "h"}]}}], "groupName": "g"}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"groupName": 5}')], "k int, doc string")
    got = {(r["k"], r["path"], r["fileName"], r["size"]) for r in documents.objects_where(df, ["k"], "doc", "groupName", F.lit("g"), {"fileName": "string", "size": "int"}).collect()}
    assert got == {(1, "$.groups[0]", "a.xlsx", 3), (1, "$.groups[1].in", "b.xlsx", None), (1, "$", None, None)}


def test_shards_give_their_rows_back(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.choice(["a", "b", "b", None, f"c{i % 50}"]), rng.choice([1.5, None])) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, s string, v double").repartition(5)
    shards, tables = sinks.coded_shards(df, "g", ["s"], ["i", "v"], ["i"], most=100)
    assert max(r["n"] for r in shards.collect()) == 100
    back = [tuple(r) for r in sinks.decoded_shards(shards, tables, "g", most=100).select("g", "place", "i", "s", "v").collect()]
    place, want = Counter(), []
    for g, i, s, v in sorted(rows, key=lambda r: r[1]):
        want.append((g, place[g], i, s, v))
        place[g] += 1
    assert Counter(back) == Counter(want)
    for g in ("hot", "x", None):
        of = Counter(s for k, _, s, _ in rows if k == g and s)
        codes = sorted((r["code"], r["value"], r["n"]) for r in tables["s"].collect() if r["g"] == g)
        assert codes == [(j, s, n) for j, (s, n) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0])))]
    empty, none = sinks.coded_shards(df.limit(0), "g", ["s"], ["i", "v"], ["i"])
    assert sinks.decoded_shards(empty, none, "g").count() == 0
