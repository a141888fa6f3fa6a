"""Exact and near dedup against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import debruijn_dedup, winnow
from tallyspark.llm.components import components
from tallyspark.llm.debruijn_dedup import compact_paths, place_on_unitigs, remove_repeated_passages, repeated_unitigs
from tallyspark.llm.minhash_dedup import near_duplicates
from tallyspark.llm.shared import Scratch
from tallyspark.llm.suffix_dedup import ENTRY, Bucket, lcp_intervals, remove_repeats, repeat_groups
from tallyspark.llm.winnow import document_groups
from tests.llm.conftest import LOWER, words

SMALL = "/root/testdata/sf0.001/documents.parquet"


def covered_by_earlier(rows, length):
    """For rows (doc_id, tokens), in order: which tokens lie in a window that starts in a smaller document too."""
    first = {}
    for doc, tokens in rows:
        if doc is not None:
            for p in range(len(tokens) - length + 1):
                w = tuple(tokens[p : p + length])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, tokens in rows:
        gone = [False] * len(tokens)
        for p in range(len(tokens) - length + 1):
            if doc is not None and first[tuple(tokens[p : p + length])] < doc:
                gone[p : p + length] = [True] * length
        out.append(gone)
    return out


def expected_bytes(rows, length):
    rows = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (doc, b), gone in zip(rows, covered_by_earlier(rows, length), strict=True):
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


def expected_words(rows, length):
    rows = [(d, words(t)) for d, t in rows]
    return sorted(str((doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())) for (doc, w), gone in zip(rows, covered_by_earlier(rows, length), strict=True))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_suffix_dedup_on_odd_rows(spark, odd_docs):
    got = sorted(str(tuple(r)[:5]) for r in remove_repeats(odd_docs, 50).drop("spans").collect())
    assert got == expected_bytes(pairs(odd_docs), 50)


def test_debruijn_dedup_on_odd_rows(spark, odd_docs):
    got = remove_repeated_passages(odd_docs, 50).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == expected_words(pairs(odd_docs), 50)
    text = {r["doc_id"]: r["kept_text"] for r in got if r["n_removed"]}
    assert text[2] == "delta epsilon zeta"


@pytest.mark.parametrize("f", [remove_repeats, remove_repeated_passages])
def test_dedup_on_an_empty_table(spark, odd_docs, f):
    assert f(odd_docs.limit(0), 50).count() == 0


def test_dedup_on_the_smallest_table(spark):
    docs = spark.read.parquet(SMALL)
    rows = pairs(docs)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in remove_repeated_passages(docs, 50).collect()) == expected_words(rows, 50)
    assert sorted(str(tuple(r)[:5]) for r in remove_repeats(docs, 50).drop("spans").collect()) == expected_bytes(rows, 50)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=2, max_size=40), st.integers(1, 4))
def test_interval_tree_is_that_of_a_naive_suffix_array(s, least):
    order = sorted(range(len(s)), key=lambda i: s[i:])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(s[a:], s[b:], strict=False)) if x != y), min(len(s) - a, len(s) - b))
    lcp = np.array([0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)])
    want = set()
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            v = lcp[i + 1 : j + 1].min()
            if v >= least and (i == 0 or lcp[i] < v) and (j + 1 == len(s) or lcp[j + 1] < v):
                want.add((int(v), i, j + 1))
    tree = lcp_intervals(lcp, least)
    assert {(v, a, b) for v, a, b, _ in tree} == want
    for v, a, b, parent in tree:
        outer = [(w, x, y) for w, x, y in want if x <= a and b <= y and (x, y) != (a, b)]
        assert (tree[parent][:3] == max(outer)) if outer else parent == -1


def test_repeat_groups_have_all_places_and_miss_no_repeat(spark, odd_docs):
    """Against every place of every string: groups are whole and maximal, and each string of 50 bytes that two documents have is in one with its places."""
    small = spark.read.parquet(SMALL).select("doc_id", "text").limit(60)
    for docs in (odd_docs.filter("doc_id <> 7 AND doc_id NOT IN (10, 11)").select("doc_id", "text"), small):
        text = {d: (t or "").encode() for d, t in pairs(docs)}
        groups = {}
        for r in repeat_groups(docs, 50).collect():
            groups.setdefault((r["group_id"], r["n_bytes"]), set()).add((r["doc_id"], r["start"]))
        strings = {}
        for (_, n), places in groups.items():
            found = {text[d][s : s + n] for d, s in places}
            assert len(found) == 1
            strings[found.pop()] = places
        assert len(strings) == len(groups)
        at = {}
        for d, b in text.items():
            for p in range(len(b) - 49):
                at.setdefault(b[p : p + 50], set()).add((d, p))
        for s, places in strings.items():
            assert len(places) > 1
            assert places == {(d, p) for d, p in at[s[:50]] if text[d][p : p + len(s)] == s}
        for w, places in at.items():
            if len({d for d, _ in places}) > 1:
                assert any(w in s and {(d, p + s.find(w)) for d, p in own} <= places and len(own) == len(places) for s, own in strings.items())
    assert repeat_groups(odd_docs.limit(0), 50).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 40), st.integers(0, 3)), min_size=2, max_size=30), st.integers(0, 5))
def test_a_bucket_settles_windows_as_brute_force(entries, seed):
    """Runs with one anchor cut from texts that share parts, each window looked at."""
    rng = np.random.default_rng(seed)
    base, length = rng.integers(97, 99, 200).astype(np.uint8), 16
    texts = [base.copy() for _ in range(4)]
    for i, x in enumerate(texts[1:], 1):
        x[rng.integers(60, 140, i)] = 120
    e, data = np.zeros(len(entries), ENTRY), []
    for i, (doc, start, which) in enumerate(entries):
        low = 80 + start % 9
        e[i] = (7, doc, 0, low, 95 - low, 1 + start % 8, texts[which][low - 1])
        data.append(texts[which][low : low + e["count"][i] + length - 1])
    first = {}
    for x, d in zip(e, data, strict=True):
        for j in range(x["count"]):
            w = (x["lead"] - j, d[j : j + length].tobytes())
            first[w] = min(first.get(w, 99), x["doc"])
    want = sorted((int(x["doc"]), int(x["start"]) + j) for x, d in zip(e, data, strict=True) for j in range(x["count"]) if first[x["lead"] - j, d[j : j + length].tobytes()] < x["doc"])
    got = Bucket(e, np.concatenate(data), length).lost()
    assert sorted((int(f["doc"]), int(f["span"]["start"]) + j) for f in got for j in range(f["span"]["count"])) == want


def test_paths_compact_where_their_source_goes_on(spark):
    """Node 12 branches, at 15 the source changes, edges 8 and 9 share a node but not a place in the source."""
    edges = [(1, 10, 11, 1, 5, 0), (2, 11, 12, 3, 5, 1), (3, 12, 13, 1, 5, 4), (4, 12, 14, 2, 5, 30), (5, 14, 15, 1, 5, 32), (6, 15, 16, 1, 6, 33), (8, 20, 21, 1, 5, 50), (9, 21, 22, 1, 5, 70)]
    rows = spark.createDataFrame([(e, u, v, w, d, 1, s) for e, u, v, w, d, s in edges], "edge long, u long, v long, windows int, doc long, row long, start int")
    scratch = Scratch()
    got = dict(map(tuple, compact_paths(rows, scratch).collect()))
    assert [got[i] for i in (1, 2, 3, 4, 5, 6, 8, 9)] == [1, 1, 3, 4, 4, 6, 8, 9]
    placed = {r["edge"]: (r["unitig"], r["offset"], r["doc"], r["start"]) for r in place_on_unitigs(rows, scratch).collect()}
    assert (placed[2], placed[5], placed[9]) == ((1, 1, 5, 0), (4, 2, 5, 30), (9, 0, 5, 70))


def test_unitigs_decide_what_goes(spark, odd_docs, monkeypatch):
    """With all edges on one unitig of the smallest source, other words would go, or verification would stop the run."""
    want = expected_words(pairs(odd_docs), 50)
    monkeypatch.setattr(debruijn_dedup, "compact_paths", lambda edges, scratch: edges.select("edge", F.lit(1).alias("unitig")))
    with pytest.raises(ValueError, match="128 bits"):
        remove_repeated_passages(odd_docs, 50).collect()
    assert want


def test_a_span_that_differs_from_its_source_stops_the_run(spark, odd_docs, monkeypatch):
    """Coordinates that are wrong by a word, and runs of a batch that differ in a byte."""
    own = debruijn_dedup.place_on_unitigs
    monkeypatch.setattr(debruijn_dedup, "place_on_unitigs", lambda edges, scratch: own(edges, scratch).withColumn("start", F.col("start") + 1))
    docs = spark.createDataFrame([(i, f"x{i} " + " ".join(f"p{j}" for j in range(70)) + f" y{i} z{i}") for i in (1, 2)], "doc_id long, text string").repartition(2, "doc_id")
    with pytest.raises(ValueError, match="128 bits"):
        remove_repeated_passages(docs, 50)
    text, at, _ = debruijn_dedup.words_of(pa.array(["a b c", "a b d", "a bc"]))
    same = lambda i, j, n: debruijn_dedup._same_words(text, at, np.array([i]), np.array([j]), np.array([n]))
    same(0, 3, 2)
    with pytest.raises(ValueError, match="128 bits"):
        same(0, 3, 3)
    with pytest.raises(ValueError, match="128 bits"):
        same(0, 6, 2)


def test_a_line_that_one_document_repeats(spark):
    """One row for each run of a document, with all its places."""
    line = " ".join(f"l{i}" for i in range(60))
    rows = [(i, f"{i} " + " ".join([line] * (40 if i == 2 else 1)) + f" z{i}") for i in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in remove_repeated_passages(docs, 50).collect())
    assert got == expected_words(rows, 50)


def test_components_of_a_path_a_star_and_a_pair(spark):
    path = [(i, i + 1) for i in range(20, 60)]
    star = [(100, i) for i in range(101, 140)]
    got = dict(map(tuple, components(spark.createDataFrame([*path, *star, (7, 3), (3, 7)], ["a", "b"])).collect()))
    assert {got[i] for i in range(20, 61)} == {20}
    assert {got[i] for i in range(100, 140)} == {100}
    assert got[7] == got[3] == 3


def expected_components(rows, width, percent):
    sets = {}
    for doc, t in rows:
        w = words((t or "").translate(LOWER))
        s = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        sets.setdefault(doc, []).append(s)
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    docs = [d for d in sets if d is not None]
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(str((d, len(s), None if d is None else find(d), d is None or find(d) == d)) for d, many in sets.items() for s in many)


def test_near_duplicates_on_odd_rows(spark, odd_docs):
    got = sorted(str(tuple(r)) for r in near_duplicates(odd_docs).collect())
    assert got == expected_components(pairs(odd_docs), 3, 85)
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_duplicates_where_stars_do_not_settle_a_bucket(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(w if j % 40 != i % 40 else f"z{i}" for j, w in enumerate(base))) for i in range(60)]
    rows += [(1000 + i, " ".join(base[: 120 - 6 * i])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in near_duplicates(docs).collect()) == expected_components(rows, 3, 85)


def test_near_duplicates_of_a_whole_table_miss_no_link(spark):
    """Every pair of sf0.01 that shares a shingle, by its full sets: recall of the bands and precision of the links are 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, holders, parent = {}, {}, {}
    for d, t in pairs(docs):
        w = words((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
        parent[d] = d
        for g in sets[d]:
            holders.setdefault(g, []).append(d)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = {(a, b) for group in holders.values() for i, a in enumerate(group) for b in group[:i]}
    for a, b in seen:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = sorted(tuple(r) for r in near_duplicates(docs).collect())
    assert got == sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def test_groups_of_documents_follow_their_bytes(spark, odd_docs, monkeypatch):
    """Far more groups than partitions: the same results, and a group has so many bytes on average at most."""
    docs = odd_docs.repartition(3)
    few = document_groups(docs)
    monkeypatch.setattr(winnow, "GROUP_BYTES", 1000)
    size = sum(len((t or "").encode()) for _, t in pairs(docs))
    assert document_groups(docs) == -(-size // 1000) > few
    assert document_groups(docs.limit(0)) == few
    got = sorted(str(tuple(r)[:5]) for r in remove_repeats(docs, 50).drop("spans").collect())
    assert got == expected_bytes(pairs(docs), 50)
    got = remove_repeated_passages(docs, 50).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == expected_words(pairs(docs), 50)


def test_unitigs_are_whole_shared_stretches(spark, odd_docs, monkeypatch):
    """A passage is one unitig however many minimizers it has, and ends where its source changes; without compaction it is many."""
    p, q = ([f"{x}{i}" for i in range(n)] for x, n in (("p", 200), ("q", 120)))
    rows = [(1, ["a1", *p, "z1"]), (2, ["a2", "b2", *p[:150], "z2"]), (3, [*q, "z3", *p[40:]]), (4, ["a4", *q]), (5, [f"own{i}" for i in range(90)])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3, "doc_id")
    unitigs = lambda: sorted((r["doc_id"], r["start"], r["n_words"]) for r in repeated_unitigs(docs).collect())
    assert unitigs() == [(1, 1, 200), (3, 0, 120)]
    assert repeated_unitigs(odd_docs.limit(0)).count() == 0
    monkeypatch.setattr(debruijn_dedup, "compact_paths", lambda edges, scratch: edges.select("edge", F.col("edge").alias("unitig")))
    alone = unitigs()
    assert len(alone) > 10 and max(n for *_, n in alone) < 120
