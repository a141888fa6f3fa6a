"""Encoding, licences, quality, scoring, mixing and search against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import block_knn, queries
from tallyspark.llm.block_knn import nearest
from tallyspark.llm.factor_machine import FactorMachine, features, score_quality
from tallyspark.llm.license_scan import PHRASES, TEMPLATES, scan_licenses
from tallyspark.llm.lm_scoring import pack_counts, read_counts, read_words, score_documents
from tallyspark.llm.quality_rules import CATCHES, GOOD, SPARES, STRAYS, fit_accuracies, judge_quality, text_counts, votes, with_posteriors
from tallyspark.llm.sentencepiece_bpe import encode_batch, encode_documents, load
from tallyspark.llm.soft_mixing import KINDS, MOST, PLACES, STRONG, TEMPER, label_domains, mix
from tests.llm.conftest import LOWER, words

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab xthe▁\n\té日́🎉ก‍<s>1ﬁ\x00")), max_size=30), max_size=4))
def test_encoding_equals_the_library(library, texts):
    model = load(P.path("piece_bpe_32k.model"))
    ids, bounds = encode_batch(model, pa.array(texts, pa.string()))
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert model.decode(ids[a:b]).decode() == library.decode(ids[a:b].tolist())


def test_decoding_any_ids_equals_the_library(library):
    model, rng = load(P.path("piece_bpe_32k.model")), random.Random(4)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 259]) for _ in range(rng.randint(1, 8))]
        assert model.decode(np.array(ids)).decode() == library.decode(ids)


def test_a_very_long_run_without_spaces(library):
    model, rng = load(P.path("piece_bpe_32k.model")), random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.perf_counter()
    ids, _ = encode_batch(model, pa.array([long, None, ""]))
    assert time.perf_counter() - began < 60
    assert ids.tolist() == library.encode(long, add_bos=True, add_eos=True) + 2 * library.encode("", add_bos=True, add_eos=True)


def test_encoding_an_empty_table(spark, odd_docs):
    assert encode_documents(odd_docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_encoded_documents(spark, odd_docs, library):
    got = Counter(tuple(r)[:4] for r in encode_documents(odd_docs, P.path("piece_bpe_32k.model")).collect())
    want = Counter()
    for r in odd_docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want


def test_license_phrases_and_templates(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = [(1, "Released under the MIT License! CC-BY-NC too, CC BY NC."), (2, mit + " whatever follows"), (3, "the software is free of charge for any person"), (4, None), (5, ""), (6, "Apache License, Version 2.0"), (7, "word " * 5000 + mit)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 9, "cc-by-nc,mit")
    assert got[2]["base_labels"] == ""
    assert "mit" in got[2]["labels"].split(",")
    assert got[2]["score"] > 0.6
    assert [got[i]["labels"] for i in (3, 4, 5, 6)] == ["", "", "", "apache-2"]
    assert got[7]["spans"][0]["start"] == 5000
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_run(window, body):
    """The longest run of the body's words in order, and the least end and then the greatest start of one so long."""
    best = [0] * (len(window) + 1)
    for w in body:
        new = [0]
        for j, x in enumerate(window):
            new.append(max(best[j + 1], new[j], best[j] + (x == w)))
        best = new
    end = best.index(best[-1])
    return best[-1], end


def plain_phrase(words, phrase, slack):
    """Whether all of a phrase's words stand in order with few others among them, or all but one of a long phrase."""
    ways = [phrase] + ([phrase[:j] + phrase[j + 1 :] for j in range(len(phrase))] if len(phrase) >= 6 else [])
    for way in ways:
        for i in (i for i, w in enumerate(words) if w == way[0]):
            at = i
            for w in way[1:]:
                at = next((j for j in range(at + 1, min(i + len(way) + slack, len(words))) if words[j] == w), None)
                if at is None:
                    break
            if at is not None:
                return True
    return False


def plain_licenses(words, cover=0.6, drift=8, slack=2):
    """(label, words in common, score) of the matches that stay, every template tried everywhere."""
    found = set()
    have = {w for t, _ in TEMPLATES.values() for w in t.split()}
    total = [0]
    for w in words:
        total.append(total[-1] + (w in have))
    for name, (text, keys) in TEMPLATES.items():
        body = text.split()
        for b in range(1 - len(body), len(words)):
            lo, hi = max(0, b - drift), min(len(words), b + len(body) + drift)
            if hi <= lo or total[hi] - total[lo] < cover * len(body) or sum((Counter(words[lo:hi]) & Counter(body)).values()) < cover * len(body):
                continue
            n, end = plain_run(words[lo:hi], body)
            if n < cover * len(body) - 1e-9:
                continue
            _, back = plain_run(words[lo : lo + end][::-1], body[::-1])
            start = lo + end - back
            if all(plain_phrase(words[start : lo + end], k.split(), slack) for k in keys):
                found.add((-n, -n / len(body), start, lo + end, list(TEMPLATES).index(name)))
    stays = []
    for n, score, lo, hi, t in sorted(found):
        if all(2 * (min(hi, y) - max(lo, x)) <= min(hi - lo, y - x) for x, y, *_ in stays):
            stays.append((lo, hi, list(TEMPLATES)[t].partition("#")[0], -score))
    return {(label, round(score, 9)) for _, _, label, score in stays}


def test_licenses_side_by_side(spark):
    """Two to seven templates in a text, stray rare words, changed and cut copies: against every template tried everywhere."""
    body = {k: t for k, (t, _) in TEMPLATES.items()}
    names, stray, rng = list(body), " ".join(w for t, _ in TEMPLATES.values() for w in t.split()[::-1]), random.Random(7)
    texts = [f"{body[a]} and {body[b]}" for a in names for b in names if a != b]
    texts += [" x ".join(body[k] for k in names[i : i + 7]) for i in range(0, len(names), 3)]
    texts += [f"{stray} {body[k]} {stray}" for k in names[:3]] + [" ".join(body[k].split()[5:]) for k in names]
    texts += [" ".join(w if rng.random() < 0.75 else "zzz" for w in body[k].split()) + " stray" for k in names for _ in range(4)]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    label = lambda k: k.partition("#")[0]
    pairs = [(a, b) for a in names for b in names if a != b]
    for r in got:
        have = {(x["label"], round(x["score"], 9)) for x in r["spans"]}
        if r["doc_id"] < len(pairs):
            assert {x for x, _ in have} == {label(k) for k in pairs[r["doc_id"]]}, pairs[r["doc_id"]]
        else:
            assert have == plain_licenses(texts[r["doc_id"]].split()), texts[r["doc_id"]]


def test_a_word_put_in_or_left_out_anywhere(spark):
    """Of every template, at every place; where a word of a short key phrase goes, its licence isn't told any more."""
    texts, want = [], []
    for k, (text, keys) in TEMPLATES.items():
        w, label = text.split(), k.partition("#")[0]
        texts += ["here is " + " ".join([*w[:i], "zzz", *w[i:]]) + " and more" for i in range(len(w) + 1)]
        want += [label] * (len(w) + 1)
        short = {i for key in keys if len(key.split()) < 6 for i in range(len(w)) if w[i : i + len(key.split())] == key.split() for i in range(i, i + len(key.split()))}
        texts += ["here is " + " ".join(w[:i] + w[i + 1 :]) + " and more" for i in range(len(w))]
        other = {t: k.partition("#")[0] for k, (t, _) in TEMPLATES.items()}  # without "lesser" it is the other licence's text
        want += [other.get(" ".join(w[:i] + w[i + 1 :]), None if i in short else label) for i in range(len(w))]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: got[i] for i, x in enumerate(want) if x} == {i: x for i, x in enumerate(want) if x}
    assert {got[i] for i, x in enumerate(want) if not x} == {"", "gpl", "apache-2"}  # apache-2 has a base phrase


def test_licenses_of_a_family_and_identifiers(spark):
    gpl = TEMPLATES["gpl"][0]
    texts = {
        "SPDX-License-Identifier: GPL-2.0-only": "gpl-2", "// SPDX-License-Identifier: (MIT)": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "SPDX-License-Identifier: something": "",
        gpl: "gpl", f"{gpl}, either version 2 of the License, or (at your option) any later version.": "gpl-2", f"{gpl}, either version 3 of the License": "gpl-3",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>": "gpl-3",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.": "lgpl-3",
        f"{TEMPLATES['bsd'][0]} {TEMPLATES['bsd-2'][0]}": "bsd,bsd-2", f"{TEMPLATES['bsd'][0]} x {TEMPLATES['bsd-3'][0]}": "bsd,bsd-3",
        "the general public may use this software, free of charge, under no license and without restriction": "", "version 2 of the license of the public": "",
    }
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts


def test_licenses_of_a_whole_table(spark, odd_docs):
    """Every template laid at every place of every text, and phrases by plain search; repeated rows, nulls and clashing names too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    mixed = odd_docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("Under the MIT License " + TEMPLATES["isc"][0].upper() + " " + TEMPLATES["cc0"][0][30:]).alias("text"))
    docs = docs.unionByName(mixed).withColumns({"labels": F.lit("x"), "score": F.lit(0)})
    want = Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        flat = f" {' '.join(w)} "
        places = sorted(i for p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base = sorted({label for p, label in PHRASES.items() if f" {p} " in flat})
        found = plain_licenses(w)
        labels, best = set(base) | {x for x, _ in found}, max((x for _, x in found), default=0.0)
        want[r["doc_id"], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), round(1.0 if base else best, 9)] += 1
    got = Counter((*tuple(r)[:7], round(r["score"], 9)) for r in scan_licenses(docs).collect())
    assert got == want
    assert {r[6] for r in got if r[0] == -1} == {"cc0,isc,mit"}


def test_quality_counts_and_verdicts(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = words(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        n, cover = Counter(grams), [0] * len(w)
        for i, g in enumerate(grams):
            if n[g] > 1:
                cover[i : i + 3] = [1] * 3
        lines = [x for x in t.split("\n") if words(x)]
        want[r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(cover), len(w) < 50 or 100 * sum(cover) > 50 * len(w)] += 1
    rows = judge_quality(docs).collect()
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert judge_quality(docs.limit(0)).count() == 0


def test_quality_verdicts_follow_labels_better_than_all_must_pass(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bad_votes = text_counts(docs, "doc_id").select("doc_id", sum((F.coalesce(1 - v, F.lit(0)) for v in votes().values()), F.lit(0)).alias("n_bad"))
    rows = judge_quality(docs).filter("NOT base_failed").drop("quality").join(bad_votes, "doc_id").join(labels, "doc_id", "left")
    share = lambda c: F.avg(F.expr(c).cast("int"))
    seen = {r["quality"]: r for r in rows.groupBy("quality").agg(share("kept").alias("kept"), share("n_bad = 0").alias("all_pass"), F.count_if(F.expr("kept AND n_bad > 0")).alias("in_spite")).collect()}
    assert seen[1]["kept"] > 0.98 > 0.9 > seen[1]["all_pass"]
    assert seen[0]["kept"] < 0.05
    assert seen[1]["in_spite"] > 20


def brute_force_em(rows, rules, rounds, strength):
    """The model of fit_accuracies text by text. rows: votes of each text."""
    model = (GOOD, [(1 - GOOD) / rules] * rules, [SPARES] * rules, [CATCHES] * rules, [STRAYS] * rules)

    def posterior(v):
        good, weight, spares, catches, strays = model
        of = lambda vote, yes, no: 1.0 if vote is None else yes if vote else no
        p = [good * math.prod(of(x, s, 1 - s) for x, s in zip(v, spares, strict=True))]
        for j in range(rules):
            p.append(weight[j] * math.prod(of(x, 1 - catches[i], catches[i]) if i == j else of(x, 1 - strays[i], strays[i]) for i, x in enumerate(v)))
        return [x / sum(p) for x in p]

    for _ in range(rounds):
        p, n = [posterior(v) for v in rows], len(rows)
        mass = [sum(x[j + 1] for x in p) for j in range(rules)]
        rate = lambda j, weigh, vote, mean, more: (sum(weigh(x) for x, v in zip(p, rows, strict=True) if v[j] == vote) + mean * more) / (sum(weigh(x) for x, v in zip(p, rows, strict=True) if v[j] is not None) + more)  # noqa: B023, E731
        model = (
            (n - sum(mass) + 1) / (n + 1 + rules), [(m + 1) / (n + 1 + rules) for m in mass],
            [rate(j, lambda x: x[0], 1, SPARES, strength * n) for j in range(rules)],
            [rate(j, lambda x, j=j: x[j + 1], 0, CATCHES, strength * n / rules) for j in range(rules)],
            [rate(j, lambda x, j=j: 1 - x[0] - x[j + 1], 0, STRAYS, strength * n) for j in range(rules)],
        )
    return model, [posterior(v)[0] for v in rows]


def test_quality_em_equals_brute_force_and_finds_the_unreliable_rule(spark):
    """Bad texts hit rule 0 and mostly rules 1 and 2 as well; rule 3 hits a fifth of all texts, good and bad."""
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        bad = i % 7 == 0
        rows.append([0 if bad else 1, 0 if bad and rng.random() < 0.6 else 1, 0 if bad and rng.random() < 0.6 else rng.choice([1, 1, None]), 0 if rng.random() < 0.2 else 1])
    patterns = spark.createDataFrame([(r,) for r in rows], "votes array<int>").groupBy("votes").agg(F.count("*").alias("n"))
    model = fit_accuracies(patterns, 4, rounds=8, tolerance=0)
    want, quality = brute_force_em(rows, 4, 8, 0.1)
    for name, values in zip(("good", "weight", "spares", "catches", "strays"), want, strict=True):
        assert model[name] == pytest.approx(values, abs=1e-9)
    got = {tuple(r["votes"]): r["p"][0] for r in with_posteriors(patterns, model).collect()}
    assert [got[tuple(r)] for r in rows] == pytest.approx(quality, abs=1e-9)
    assert model["spares"][3] < 0.85 < 0.98 < min(model["spares"][:3])
    assert got[1, 1, 1, 0] > 0.9 > 0.1 > got[0, 1, 1, 1]
    assert fit_accuracies(patterns.limit(0), 4)["spares"] == [SPARES] * 4


def test_factor_machine_on_held_out_rows(spark, odd_docs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scored = score_quality(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    odd = score_quality(odd_docs, labels.limit(0), keep=("names",)).collect()
    assert len(odd) == odd_docs.count()
    assert all(r["score"] == 0.5 for r in odd)


def test_factor_machine_is_the_double_loop(spark, odd_docs):
    """The sum-of-squares identity against all pairs of features, and clashing or empty input."""
    model = FactorMachine(4)
    model.bias, model.linear = 0.3, np.random.default_rng(1).normal(size=len(model.linear))
    texts = ["One two! 3 two # one", "", "a b c " * 5, "é日本\nX"]
    place, value, bounds = features(pa.array(texts))
    raw, _ = model.raw(place, value, bounds)
    for got, a, b in zip(raw, bounds[:-1], bounds[1:], strict=True):
        f = list(zip(place[a:b].tolist(), value[a:b].tolist(), strict=True))
        want = model.bias + sum(model.linear[p] * x for p, x in f) + sum(model.factors[p] @ model.factors[q] * x * y for i, (p, x) in enumerate(f) for q, y in f[:i])
        assert got == pytest.approx(want, abs=1e-9)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    assert score_quality(odd_docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError, match="score"):
        score_quality(odd_docs.withColumn("score", F.lit(1)), labels, keep=("score",))


def test_counts_beyond_32_bits_are_kept():
    counts = np.array([1, 2**31, 3 * 2**31 + 5, 7])
    assert read_counts([pack_counts(counts), pack_counts(np.array([4, 5]))], np.array([4, 2])).tolist() == [*counts.tolist(), 4, 5]


def test_neighbours_equal_sql_and_skip_unusable(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    found = queries.op8_block_knn(spark, str(DATA)).collect()
    assert sorted(map(tuple, found)) == sorted(c.sql(queries.ORACLE_SQL["op8_block_knn"]).fetchall())
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [float("inf"), 0.0]), (None, [1.0, 0.5])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 10, 2)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_neighbours_with_many_ties_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(block_knn, "FAN", 3)  # two levels of merging
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 6)), 1)
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, 5, 40).collect()
    for q in range(0, 300, 7):
        d = np.sqrt(((x - x[q]) ** 2).cumsum(axis=1)[:, -1])
        want = [i for _, i in sorted((d[i], i) for i in range(300) if i != q)[:5]]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_neighbours_of_repeated_ids_and_copies(spark):
    """Each row of an id asks for itself; a block of copies gives the smallest ids; clashing names are left alone."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [1.0, 0.3])] + [(i, [5.0, 1.0]) for i in range(200, 100, -1)]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, at string")
    for block in (3, 200):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest(docs, F.col("vec_id") == 0, 3, block).collect())
        near, far = [(0, 1, 1, 0.1), (0, 2, 2, 0.2), (0, 3, 3, 0.3)], [(0, j, 100 + j, 1.0) for j in (1, 2, 3)]
        assert got == sorted(near + near + far)


def expected_losses(docs, wanted, v, weight):
    """docs: (doc_id, words); v: the vocabulary's size. Each document is scored by a background without it, of the target's size or the other way round."""

    def model(texts, n_even):
        one, two, first = Counter(), Counter(), sum(map(bool, texts))
        for t in texts:
            one.update(t)
            two.update(zip(["^", *t], t, strict=False))
        n = sum(one.values())
        f = n_even / n if n_even else 1
        return lambda a, w: (f * two[a, w] + weight * (f * one[w] + 1) / (f * n + v)) / (f * (first if a == "^" else one[a]) + weight)

    want = []
    for i, (doc, t) in enumerate(docs):
        others = [x for j, (_, x) in enumerate(docs) if j != i]
        even = min(sum(map(len, others)), sum(map(len, wanted)))
        loss = [sum(-math.log(m(a, w)) for a, w in zip(["^", *t], t, strict=False)) / max(1, len(t)) for m in (model(wanted, even), model(others, even))]
        want.append((doc, len(t), *loss, loss[0] - loss[1]))
    return want


def test_language_models_equal_brute_force(spark, odd_docs):
    size, weight = 40, 20
    target = [("the w1 w2 w3 short one.",), ("w5 w6 W7",), (None,), ("",)]
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted(map(tuple, score_documents(odd_docs, spark.createDataFrame(target, "text string"), size, weight).collect()), key=str)
    tokens = lambda t: words((t or "").translate(LOWER))
    docs, wanted = [tokens(r["text"]) for r in rows], [tokens(t) for t, in target]
    count = Counter(w for t in docs for w in t)
    every = list(count)
    hashes = read_words(pa.record_batch([pa.array([" ".join(every)])], ["text"]))[0].view(np.int64).tolist()
    known = {w for _, _, w in sorted((-count[w], h, w) for w, h in zip(every, hashes, strict=True))[:size]}

    masked = lambda texts: [[w if w in known else None for w in t] for t in texts]
    want = expected_losses([(r["doc_id"], t) for r, t in zip(rows, masked(docs), strict=True)], masked(wanted), min(size, len(count)) + 1, weight)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:2] == b[:2]
        assert a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_language_models_tell_every_word_apart(spark):
    """66,000 words that occur once each, more than any table of 16-bit numbers holds, and pairs among them."""
    rare = [f"r{i}" for i in range(66_000)]
    texts, wishes, weight = [" ".join(rare), "r1 r2 common common", "r2 r1 common x", "x R65999 r65998"], ["r2 r1 r1 fresh", "common fresh fresh"], 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in score_documents(rows, spark.createDataFrame([(t,) for t in wishes], "text string")).collect()}
    docs, wanted = [words(t.translate(LOWER)) for t in texts], [words(t) for t in wishes]
    v = len({w for t in docs + wanted for w in t})

    for doc, n, *losses in expected_losses(list(enumerate(docs)), wanted, v, weight):
        assert list(got[doc][1:]) == [n, *(pytest.approx(x, abs=1e-9) for x in losses)]
    assert score_documents(rows.limit(0), spark.createDataFrame([], "text string")).count() == 0


def test_language_models_without_a_target_or_other_documents(spark):
    """Nothing is scaled; a text that stands alone has a uniform background, and one that is there twice is known by its copy."""
    weight, texts = 20, ["a b a c", None, "", "d d e", "d d e"]
    docs = list(enumerate((t or "").split() for t in texts))
    none = spark.createDataFrame([], "text string")
    for some, target, v in ((texts, [], 5), (texts, ["a d z", None], 6), (texts[:3], ["a b"], 3), (texts[:3], [], 3)):
        wishes = spark.createDataFrame([(t,) for t in target], "text string") if target else none
        got = sorted(map(tuple, score_documents(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), wishes).collect()))
        for a, b in zip(got, expected_losses(docs[: len(some)], [(t or "").split() for t in target], v, weight), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
        by_doc = {r[0]: r for r in got}
        assert len(some) < 5 or by_doc[3][3] < by_doc[0][3]


def test_mixing_meets_targets_and_ignores_what_it_must(spark, odd_docs):
    d = "/root/testdata/sf0.01"
    labels = label_domains(spark.read.parquet(f"{d}/labels.parquet"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    targets = {"good": 0.85, "low": 0.1, "toxic": 0.05}
    rows = mix(docs, labels, targets).collect()
    n = sum(r["n_tokens"] for r in rows)
    for j, share in enumerate(targets.values()):
        assert sum(r["rate"] * r["n_tokens"] * r["p"][j] for r in rows) / n == pytest.approx(share, abs=0.01)
    assert min(r["rate"] for r in rows) >= 0
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    odd = mix(odd_docs, labels, targets).collect()
    assert len(odd) == odd_docs.count()
    assert all(r["rate"] == 1 for r in odd if not r["n_tokens"])
    assert mix(odd_docs.limit(0), labels.limit(0), targets).count() == 0


def test_posteriors_equal_those_counted_by_hand(spark):
    """Weights, numbers of strong words and probabilities of a small labelled table, in plain Python."""
    rng = random.Random(5)
    own = {"good": "tree river stone path".split(), "low": "buy click now win".split(), "toxic": "vile foul rot scum".split()}
    rows = []
    for i in range(240):
        domain = ("good", "low", "toxic")[i % 3]
        words = [rng.choice(own[domain] if rng.random() < 0.4 else [f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 40))]
        rows.append((i, " ".join(words) + ("!!! ##" if domain == "low" else "."), domain))
    rows += [(240, None, "good"), (241, "", "low"), (242, "stone foul WIN", None), (243, "\u00e9t\u00e9 stone", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string")
    domains = list(own)
    every = {w for _, t, _ in rows for w in (t or "").split()}
    place = {r["w"]: r["p"] for r in spark.createDataFrame([(w,) for w in every], "w string").selectExpr("w", f"pmod(hash(w), {PLACES}) AS p").collect()}

    def found(text):
        bins = [("bin", i, sum(1000 * len(re.findall(kind, text)) > b * len(text) for b in bounds)) for i, (kind, bounds) in enumerate(KINDS)]
        return sorted({place[w] for w in text.split()}), bins

    seen = [(*found(t or ""), d) for _, t, d in rows if d]
    total = Counter(d for *_, d in seen)
    n, raised = len(seen), 4 + len(seen) / 200
    counts = Counter((at, d) for words, bins, d in seen for at in [*words, *bins])
    in_words = {d: sum(len(w) for w, _, e in seen if e == d) for d in domains}

    def weight(at, d):
        share = total[d] / n if isinstance(at, tuple) else in_words[d] / sum(in_words.values())
        return math.log((counts[at, d] + raised) / (sum(counts[at, e] for e in domains) * share + raised))

    odds = lambda at, d: weight(at, d) - weight(at, "good")
    strong = lambda words, d: min(sum(odds(w, d) >= STRONG for w in words), MOST)
    numbers = {d: Counter((e, strong(words, d)) for words, _, e in seen) for d in domains[1:]}
    assert max(m for d in numbers for _, m in numbers[d]) > 1  # else the test sees no strong words

    def expected(text):
        words, bins = found(text)
        out = {"good": 0.0}
        for d in domains[1:]:
            out[d] = math.log((total[d] + 1) / (total["good"] + 1)) + sum(odds(b, d) for b in bins) + sum(odds(w, d) for w in words) * TEMPER / (TEMPER + len(words))
            for e in domains[1:]:
                m = strong(words, e)
                out[d] += math.log((numbers[e][d, m] + 1) / (total[d] + MOST + 1)) - math.log((numbers[e]["good", m] + 1) / (total["good"] + MOST + 1))
        likely = [math.exp(out[d]) for d in domains]
        return [x / sum(likely) for x in likely]

    got = {r["doc_id"]: r["p"] for r in mix(docs, labels, dict.fromkeys(domains, 1 / 3)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i] == pytest.approx(expected(text or ""), abs=1e-9), text


def test_words_pattern_is_that_of_the_contract():
    text = "ab\x0bc\x1cd e é"
    assert words(text) == re.split(r"[\x20\x09-\x0D]", text)
