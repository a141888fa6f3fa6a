"""Tries of conversations, fill-in-middle forms and language identification: brute force, round trips, held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, prefix_trie, queries
from tallyspark.llm.fill_in_middle import END, ESCAPE, fill_in_middle, restored
from tallyspark.llm.language_id import PLACES, Centroids, clustered, counted, document_counts, fit_centroids, held_out, identify, vectors

DATA = Path("/root/testdata/sf0.01")
TURNS = "conv_id long, turn long, role string, text string"


def in_order(rows):
    found = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found[c].append((t is not None, t or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    return {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in found.items()}


def brute_trie(paths):
    members, ends, children = defaultdict(list), defaultdict(list), Counter()
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children.update(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1].encode()) if n else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def fork(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def made_conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é日", "", None, "a longer text"])) for c in range(60) for t in range(rng.randint(0, 6))]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 400) for t in range(3)]  # a group of copies
    rows += [(500, t, "user", "same") for t in range(300)] + [(501, t, "user", "same") for t in range(299)]  # long ones, one a beginning of the other
    rows += [(600, None, "user", "first"), (600, 2, None, None), (600, 2, "user", "tie"), (600, 2, "assistant", "tie"), (600, 1, "user", "x"), (600, 1, "user", "x")]  # nulls, ties, repeats
    rows += [(None, 1, "user", "nobody's"), (701, 1, "user", "without an origin"), (703, 0, "user", "q")]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = made_conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({"node": F.lit(1), "rank": F.lit("x"), "path": F.lit("y"), "depth": F.lit(2), "bucket": F.lit(0)})
    assert Counter(tuple(r)[:8] for r in prefix_trie.prefix_trie(prefix_trie.turn_paths(df)).collect()) == brute_trie(in_order(rows))
    assert Counter(tuple(r)[:8] for r in prefix_trie.prefix_trie(prefix_trie.forked(df)).collect()) == brute_trie(fork(in_order(rows)))


def test_subtrees_are_runs_of_the_preorder(spark):
    rows = prefix_trie.prefix_trie(prefix_trie.forked(spark.createDataFrame(made_conversations(), TURNS))).collect()
    rows.sort(key=lambda r: r["preorder"])
    assert [r["preorder"] for r in rows] == list(range(len(rows)))
    open_ = []
    for r in rows:
        while open_ and open_[-1]["subtree_end"] < r["preorder"]:
            open_.pop()
        assert len(open_) == r["depth"]
        assert (open_[-1]["conv_id"] if open_ else None) == r["parent_conv_id"]
        assert all(r["subtree_end"] <= x["subtree_end"] for x in open_)
        assert r["n_leaves"] == sum(x["n_children"] == 0 for x in rows[r["preorder"] : r["subtree_end"] + 1])
        open_.append(r)


def test_tries_of_few_conversations(spark):
    trie = lambda rows: Counter(tuple(r)[:8] for r in prefix_trie.prefix_trie(prefix_trie.forked(spark.createDataFrame(rows, TURNS))).collect())
    assert not trie([])
    assert not trie([(None, 1, "user", "x")])
    for rows in ([(3, 0, "user", "x")], [(0, 0, None, None)], [(5, 0, "user", "x"), (5, 1, "user", "y")], [(-7, 0, "user", "x"), (-5, 0, "user", "y")]):
        own = in_order(rows)
        built = {c: (own.get(c - int(np.fmod(c, 5)), [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[c][h:]) for c in own}
        assert trie(rows) == brute_trie(built)


def test_lists_of_ids_in_pieces(spark):
    """A list far longer than a piece, over many ranges."""
    ids = [7 * i % 100_003 for i in range(20_000)]
    df = spark.createDataFrame([(b"hot", i) for i in ids] + [(b"cold", 3), (b"one more", -2)], "path binary, conv_id long").repartition(7)
    got = {bytes(r["path"]): r["ends_sha256"] for r in prefix_trie.listed(df).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ((b"hot", ids), (b"cold", [3]), (b"one more", [-2]))}


def test_trie_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, queries.op11_prefix_trie(spark, str(DATA)).collect())) == brute_trie(fork(in_order(rows)))


def odd_texts():
    rng = random.Random(8)
    marks = ["<P>", "<S>", "<M>", "<", "P>", "<S", "M"]
    texts = [None, "", "\n", "\n\n\n", "no end", "one\n", "a\r\nb\r\n", f"{END}\n{ESCAPE}u{END}\n{ESCAPE}{ESCAPE}e\n{END}{END}", f"{ESCAPE}\nu\n", "é\n日本\n🎉 x", "x" * 300_000 + "\n" + "y\n" * 50_000, "<P>\n", "a<S>b", "<\nP>", "<\n<\n<M\n>", "$0\n\\1\n"]
    texts += ["".join(rng.choice([*marks[3:], "\n", " ", "word", END, ESCAPE, "u", "e"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return texts


@pytest.mark.parametrize("percent", [100, 40])
def test_forms_equal_brute_force_and_give_the_text_back(spark, percent):
    rows = [(i if i else None, t) for i, t in enumerate(odd_texts())] + [(5, "one\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y"), "_text": F.lit("z")})
    found = fill_in_middle(df, percent=percent)
    got = Counter(map(tuple, found.withColumn("back", restored(F.col("output"), F.col("form"))).collect()))
    want = Counter()
    for i, t in rows:
        t = t or ""
        u = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
            want[i, len(u), "plain", None, None, None, t, t] += 1
        elif h4 % 100 < 50:
            want[i, len(u), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}", t] += 1
        else:
            want[i, len(u), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}", t] += 1
    assert got == want
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_forms_of_an_empty_table_and_other_units(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "one two  three. four"), (2, "x")], "doc_id long, text string")
    rows = fill_in_middle(df, units=r"[^ ]* |[^ ]+", marks=("[p]", "[s]", "[mid]")).withColumn("back", restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[mid]"))).collect()
    assert [(r["n"], r["back"]) for r in rows] == [(5, "one two  three. four"), (1, "x")]


def test_forms_match_sql(spark):
    name = "op12_fill_in_middle"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    told = c.sql(queries.ORACLE_SQL[name])
    assert Counter(tuple(r[x] for x in told.columns) for r in queries.QUERIES[name](spark, str(DATA)).collect()) == Counter(told.fetchall())


def plain_grams(text):
    """n-grams of a text as strings, the plain way."""
    import unicodedata

    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    if not any(map(str.isalpha, text)):
        return Counter()
    return Counter(g for w in words for size in (1, 2, 3) for padded in [f" {w} "] for g in (padded[i : i + size] for i in range(len(padded) - size + 1)) if g != " ")


def test_grams_equal_the_plain_way(monkeypatch):
    rng = random.Random(1)
    texts = ["", "1 2 3 !!", "a", "The cat, the CAT.", "ß ẞ İstanbul ΣΑΣ", "हिन्दी भाषा", "日本語 x", "́́ 1", "x" * 50, "a\x00b"] + ["".join(rng.choice("abcé ,.\n1ñ") for _ in range(rng.randint(0, 400))) for _ in range(60)]

    def by_gram(texts):
        row, place, count = counted(texts)
        return [Counter(dict(zip(place[row == i].tolist(), count[row == i].tolist(), strict=True))) for i in range(len(texts))]

    whole, place_of = by_gram(texts), {}
    for t, have in zip(texts, whole, strict=True):
        want = Counter()
        for g, n in plain_grams(t).items():
            code = np.array([0 if c == " " else ord(c) for c in g], np.uint32)
            at = place_of.setdefault(g, int(language_id.grams(np.r_[np.zeros(3, np.uint32), code], len(code) + 2)[0][{1: 0, 2: 1, 3: 2}[len(g)] if g[-1] != " " else len(g) - 2]))
            want[at] += n
        assert have == want, t
    monkeypatch.setattr(language_id, "PIECE", 7)  # texts in pieces
    assert by_gram(texts) == whole


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op13_language_id(spark, str(DATA)).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r["held_out"]]
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in unseen]
    assert sum(right) / len(right) > 0.985
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["score"] for r, x in zip(unseen, right, strict=True) if x]) > 0.95
    assert np.mean([r["accepted"] for r in unseen]) > 0.95


def test_predictions_equal_a_plain_computation(spark):
    """Counts over all rows, and cosines with the same centroids by plain sums; held-out rows and languages of others play no part."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 150")
    learn = docs.filter(~held_out(F.col("doc_id")))
    model = fit_centroids(learn, sample=40, clusters=3)
    texts = [r["text"] for r in learn.collect() if r["text"] and r["lang"]]
    df, total = Counter(), 0
    for t in texts:
        row, place, _ = counted([t])
        df.update(place.tolist())
        total += len(row) > 0
    assert {r["place"]: r["n"] for r in document_counts(learn).collect()} == {-1: total, **df}
    assert np.allclose(model.idf, [np.log((1 + total) / (1 + df[p])) for p in range(PLACES)])
    again = fit_centroids(learn.repartition(7).withColumn("lang", F.when(F.col("lang") != "", F.col("lang"))).unionByName(learn.limit(3).withColumn("lang", F.lit(None).cast("string"))), sample=40, clusters=3)
    assert np.allclose(again.idf, model.idf)
    assert np.allclose(again.centres, model.centres)
    lang_of = [model.names[j] for j in model.of]
    for r in {r["doc_id"]: r for r in identify(docs, model).collect()}.values():
        text = docs.filter(F.col("doc_id") == r["doc_id"]).first()["text"] if r["doc_id"] < 12 else None
        if not text:
            continue
        _, place, count = counted([text])
        w = (1 + np.log(count)) * model.idf[place]
        cosines = {j: float((w / np.linalg.norm(w)) @ model.centres[j][place]) for j in range(len(lang_of))}
        best = max(cosines, key=cosines.get)
        assert r["lang_pred"] == lang_of[best]
        assert abs(r["cosine"] - cosines[best]) < 1e-5


def test_clusters_are_found():
    rng = np.random.default_rng(0)
    ways = np.eye(PLACES, dtype=np.float32)[:3]
    rows = np.concatenate([np.abs(w + 0.01 * rng.normal(size=(20, PLACES)).astype(np.float32)) for w in ways])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres, of = clustered(rows, 3)
    assert len({*of[:20]}) == len({*of[20:40]}) == len({*of[40:]}) == 1
    assert len(set(of)) == len(centres) == 3
    assert len(clustered(rows[:1].repeat(5, axis=0), 4)[0]) == 1


def test_odd_texts_have_defined_languages(spark, odd_docs):
    learn = spark.createDataFrame([("the cat sat on the mat with the hat", "en"), ("der hund und die katze sind im haus", "de"), (None, "en"), ("the dog", None), ("12 34", "xx")], "text string, lang string")
    model = fit_centroids(learn)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "the cat"), (4, "the cat"), (5, "und die katze"), (6, "Жили были старик со старухой у самого синего моря"), (None, "the mat " * 300_000)], "doc_id long, text string")
    got = [tuple(r)[:2] + (r["accepted"],) for r in identify(rows.withColumns({"score": F.lit(1), "accepted": F.lit(0)}), model).collect()]
    assert got[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert [x[1] for x in got[3:6]] == ["en", "en", "de"]
    assert got[6][2] is False  # rejected: no language that was learned
    assert got[7][1] == "en"
    assert identify(odd_docs, model).count() == odd_docs.count()
    assert identify(odd_docs.limit(0), model).count() == 0
    nothing = fit_centroids(learn.limit(0))
    assert {tuple(r)[1:3] for r in identify(rows, nothing).collect()} == {("und", 0.0)}
    assert isinstance(nothing, Centroids)
    with pytest.raises(ValueError, match="languages"):
        fit_centroids(spark.range(300).select(F.lit("x").alias("text"), F.col("id").cast("string").alias("lang")))


def test_vectors_have_unit_length():
    row, place, count = counted(["the cat", "", "der hund"])
    x = vectors(row, place, count, 3, np.ones(PLACES))
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 1], atol=1e-6)
