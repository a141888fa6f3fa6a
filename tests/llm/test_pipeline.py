"""The pipeline's stages: each works on what the one before kept, and its decisions take effect."""

import glob
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import stages
from tallyspark.llm.shared import shared_dir, tables_of, written
from tallyspark.llm.soft_mixing import drawn, fit_rates, label_domains, mix, token_shares
from tests.llm.conftest import words
from tests.llm.test_dedup import covered_by_earlier, expected_components

DIR = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark):
    """What the stages keep, drop and change at sf0.01, each on what the one before kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    with tables_of() as tables:
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, DIR))
            assert docs.columns == columns
            kept.append(docs)
        assert len(tables) > len(corpus_pipeline.STAGES)
    rows = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = {d for d, r in labels.items() if r["quality"] == 1 and d in rows[0]}
    assert len(good & rows[1].keys()) > 0.98 * len(good)
    assert sum(labels[d]["quality"] == 0 for d in rows[1].keys() & labels.keys()) < 0.1 * sum(r["quality"] == 0 for r in labels.values())
    components = expected_components_fast(rows[1])
    assert rows[2].keys() == {d for d, c in components.items() if d == c}
    tokens = [(d, words(t)) for d, t in sorted(rows[2].items())]
    want = {d: [w for w, g in zip(x, gone, strict=True) if not g] for (d, x), gone in zip(tokens, covered_by_earlier(tokens, 50), strict=True)}
    assert {d: words(t) for d, t in rows[3].items()} == {d: w for (d, x), w in zip(tokens, want.values(), strict=True) if w or not x}
    clean = {d for d in good & rows[3].keys() if not labels[d]["toxic"]}
    toxic = {d for d in rows[3].keys() & labels.keys() if labels[d]["toxic"]}
    assert len(clean & rows[4].keys()) > 0.98 * len(clean)
    assert len(toxic & rows[4].keys()) < 0.6 * len(toxic)
    assert rows[4].keys() <= rows[3].keys()
    final = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, DIR).collect()}
    assert final.keys() == rows[4].keys()
    plain = [d for d in final if rows[4][d].isascii() and "  " not in rows[4][d] and rows[4][d].strip() == rows[4][d] and rows[4][d].replace("\n", "").isprintable() and "\n" not in rows[4][d]]
    assert all(final[d] == hashlib.sha256(rows[4][d].encode()).hexdigest() for d in plain)


def expected_components_fast(texts):
    """Near duplicates of five-word shingles at 0.8, with an index in place of all pairs."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets, holders, parent = {}, {}, {d: d for d in texts}
    for d, t in texts.items():
        w = words((t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        for g in sets[d]:
            holders.setdefault(g, []).append(d)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def test_stages_on_odd_rows_and_clashing_names(spark, odd_docs):
    """Nulls, empty and repeated rows, shared ids, extra columns of any name; and an empty table."""
    names = ("gone", "kept_text", "score", "predicted", "held_out", "all", "others", "group", "component_id", "rate", "p", "id")
    docs = odd_docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    docs = docs.unionByName(docs)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, DIR)
            assert out.columns == rows.columns
            assert dict(out.dtypes) == dict(rows.dtypes)
            n = out.count()
            assert n <= rows.count()
            assert n % 2 == 0, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, DIR).count() == rows.count()
    left = stages.passages(spark, docs, DIR).collect()
    assert {r["text"] for r in left if r["doc_id"] == 2} == {"delta epsilon zeta"}
    assert {r["n_chars"] for r in left if r["doc_id"] == 2} == {18}
    assert all(r["score"] == names.index("score") for r in left)


def test_mixing_delivers_the_shares_it_was_asked_for(spark):
    """At sf0.1, of all documents: expected shares of the tokens that stay, and who stays, by length of text."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rates = written(mix(docs, label_domains(labels), stages.WANTED, fixed="good"))
    before, after = token_shares(rates, stages.WANTED, F.lit(True)), token_shares(rates, stages.WANTED, stages.stays())
    assert all(abs(after[d] - share) < 0.03 for d, share in stages.WANTED.items())
    assert after["toxic"] < 0.5 * before["toxic"]
    told = rates.join(labels, "doc_id").withColumn("stays", stages.stays().cast("int"))
    for low, high in ((0, 300), (300, 1000), (1000, 1 << 30)):
        rows = told.filter((F.col("n_tokens") >= low) & (F.col("n_tokens") < high))
        kept = {r["toxic"]: r["kept"] for r in rows.filter("quality = 1").groupBy("toxic").agg(F.avg("stays").alias("kept")).collect()}
        assert kept[0] > 0.97
        assert kept[1] < 0.7


def test_rates_equal_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    n, p = rng.integers(0, 400, 60), rng.dirichlet([1, 0.5, 0.3], 60)
    rows = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "i int, n_tokens long, p array<double>")
    targets, ridge = np.array([0.5, 0.3, 0.2]), 0.01
    got = {r["i"]: r["rate"] for r in fit_rates(rows, targets.tolist(), ridge, rounds=64, tolerance=0).collect()}
    share, natural = n / n.sum(), (n[:, None] * p).sum(axis=0) / n.sum()
    goal = lambda x: (((x * share) @ p - targets) ** 2 / natural).sum() + ridge * (share * (x - 1) ** 2).sum()
    x = np.ones(60)
    for _ in range(20000):  # plain projected gradient on the dense problem, preconditioned by the documents' sizes
        x = np.maximum(0, x - 0.5 * (p @ (((x * share) @ p - targets) / natural) + ridge * (x - 1)))
    found = np.array([got[i] for i in range(60)])
    assert goal(found) <= goal(x) * 1.02 + 1e-9
    assert np.abs((found * share) @ p - (x * share) @ p).max() < 2e-3
    kept = fit_rates(rows, [0.8, 0.1, 0.1], ridge, fixed=0).collect()
    assert sum(r["rate"] * r["n_tokens"] * r["p"][0] for r in kept) == pytest.approx(sum(r["n_tokens"] * r["p"][0] for r in kept), rel=0.02)


def test_draws_are_fair_and_always_alike(spark):
    rows = spark.range(20000).withColumn("rate", F.lit(0.3)).withColumn("in", drawn(F.col("id"), F.lit(5), F.col("rate")))
    assert rows.filter("in").count() == pytest.approx(6000, rel=0.05)
    assert rows.filter("in").exceptAll(rows.repartition(7).filter("in")).count() == 0


def test_run_leaves_one_table(spark):
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tallyspark-*"))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert len(set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tallyspark-*")) - before) == 1


def test_components_of_pipeline_and_operator_agree():
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"a{i}" for i in range(38))), (3, "x y"), (4, None)]
    assert {d: c for d, c in expected_components_fast(dict(rows)).items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert expected_components(rows, 5, 80)
