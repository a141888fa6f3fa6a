"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets.

Method: under each permutation both the smallest and the largest hash of a document's shingle set are kept, so
``bands * rows`` values need half as many permutations. Documents with equal sets are one class from the start
(pre-aggregated, so a group of copies of any size is one node). Classes that agree on all values of a band are
candidates. In a bucket each class is compared with the bucket's smallest first, the one with the best estimate
before the others; only where a bucket still holds classes of different components are the remaining pairs across
components looked at, in tiles of bounded size, and only possible links leave a tile. Links are confirmed on the sets, and components come from joins.
A link at the threshold is missed with a chance of (1 - threshold ** rows) ** bands, 6e-9 as set here.

Defined cases: words are lower-cased in A-Z only; a text of fewer words than a shingle is one shingle; without
words (or null) a document has no set, links with nothing and stays; rows that share a doc_id are one document and
each give a row; a null doc_id links with nothing, has no component and stays; columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import BASE64, LOWER, binaries, find_words, hash_words, mix64, slices, utf8
from tallyspark.llm.components import components
from tallyspark.llm.shared import written

SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary"
#: Members of a tile of a bucket whose pairs are compared by signature.
TILE = 1024


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, sorted, and the rows' bounds."""
    data, offs = utf8(batch.column("text"))
    data = LOWER[data]
    starts, ends, bounds = find_words(data, offs)
    x = hash_words(data, starts, ends)
    per = np.diff(bounds)
    n = np.where(per >= width, per - width + 1, np.minimum(per, 1))
    row = np.repeat(np.arange(len(per)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][row]
    h = np.zeros(len(row), np.uint64)
    for j in range(width):
        inside = at + j < bounds[1:][row]
        h = mix64(h * BASE64 + np.where(inside, x[np.minimum(at + j, max(len(x) - 1, 0))], 0) + np.uint64(j)) if len(x) else h
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(per) + 1))


class MinMax:
    """Signatures of ``bands * rows`` values from half as many permutations."""

    def __init__(self, bands: int, rows: int):
        if bands * rows % 2:
            raise ValueError("bands * rows must be even")
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(7)
        self.factors = rng.integers(0, 2**31, bands * rows // 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shifts = rng.integers(0, 2**32, bands * rows // 2, dtype=np.uint32)
        # The smallest and the largest of one permutation go to different bands.
        self.place = rng.permutation(bands * rows)

    def sign(self, h: np.ndarray, bounds: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """One row of values for each set; sets must not be empty."""
        n = len(bounds) - 1
        out = np.zeros((n, 2 * len(self.factors)), np.uint32)
        x = (h >> np.uint64(32)).astype(np.uint32)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1)
            part, cut = x[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
            for j, (f, s) in enumerate(zip(self.factors, self.shifts, strict=True)):
                y = part * f + s
                y ^= y >> np.uint32(15)
                y *= np.uint32(0x2C1B3C6D)
                y ^= y >> np.uint32(12)
                out[a:b, 2 * j] = np.minimum.reduceat(y, cut)
                out[a:b, 2 * j + 1] = np.maximum.reduceat(y, cut)
            a = b
        return out[:, self.place]

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key for each set and band."""
        v = signature.reshape(len(signature), self.bands, self.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), v.shape[:2])
        for j in range(self.rows):
            h = mix64(h * BASE64 + v[:, :, j])
        return h


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 40, rows: int = 6) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id and kept.

    Documents link where 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles.
    """
    minmax = MinMax(bands, rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches):
        for batch in slices(batches, limit=8 << 20):
            h, bounds = shingle_sets(batch, width)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            full = np.r_[bounds[:-1][some], len(h)]
            signature = minmax.sign(h, full)
            keys = minmax.keys(signature)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                f1[some], f2[some] = (mix64(np.add.reduceat(mix64(h ^ np.uint64(s)), full[:-1])) for s in (0x243F6A8885A308D3, 0x13198A2E03707344))
            at = np.zeros(len(n) + 1, np.int64)
            at[1:] = np.cumsum(n > 0)
            yield pa.record_batch(
                [batch.column("doc_id"), n.astype(np.int64), f1.view(np.int64), f2.view(np.int64), pa.ListArray.from_arrays(pa.array((at * bands).astype(np.int32)), pa.array(keys.ravel().view(np.int64))), binaries((signature & 255).astype(np.uint8).ravel(), at * bands * rows)],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
            )

    signed = written(docs.mapInArrow(sign, SIGNED))
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    ids = some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = written(ids)
    reps = some.join(classes.select("f1", "f2", F.col("rep").alias("doc_id")), ["f1", "f2", "doc_id"], "left_semi").dropDuplicates(["f1", "f2"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).filter("head < last").select("key", "head")
    member = written(buckets.join(heads, "key"))
    inside = member.select("rep").distinct()
    sketches = written(reps.join(inside, "rep", "left_semi"))
    stars = member.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    least = percent / 100 - 0.16
    stars = written(_estimated(stars, sketches, least))
    # Copies of one set share a class, so classes are few; their sets are made again from the texts.
    sets = written(docs.join(inside.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(width), "rep long, shingles binary, halves binary"))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    # A document of several rows with different sets ties their classes together.
    several = some.groupBy("doc_id").agg(F.count_distinct("f1", "f2").alias("sets")).filter("sets > 1").select("doc_id")
    ties = some.join(several, "doc_id").join(classes, ["f1", "f2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = written(_confirmed(best, sets, percent).unionByName(ties))
    label = components(links)
    rest = _apart(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), label)
    links = written(links.unionByName(_confirmed(rest, sets, percent)))
    label = components(links)
    # What the stars have not settled: buckets whose members are of different components.
    labelled = member.join(label, member.rep == label.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high AND size > 2").select("key", "size")
    members = sketches.join(sets.select("rep", "halves").dropDuplicates(["rep"]), "rep")
    pairs = _tiles(labelled.join(open_, "key"), members, percent, least)
    links = written(links.unionByName(_confirmed(pairs, sets, percent)))
    label = components(links)
    known = signed.join(classes.select("f1", "f2", "rep"), ["f1", "f2"], "left").join(label, F.col("rep") == label.node, "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return known.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not of one component yet."""
    first, second = label.toDF("a", "ca"), label.toDF("b", "cb")
    return pairs.join(first, "a", "left").join(second, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _estimated(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in a share of ``least`` values or more, six standard errors below the threshold, and that share."""
    first, second = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))

    def estimate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (utf8(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            share = (x == y).mean(axis=1)
            yield pa.record_batch([batch.column("a"), batch.column("b"), share], ["a", "b", "estimate"]).filter(pa.array(share >= least))

    return pairs.join(first, "a").join(second, "b").mapInArrow(estimate, "a long, b long, estimate double")


def _sets(width: int):
    """Sets in full, and by the upper halves of their hashes."""

    def make(batches):
        for batch in slices(batches, limit=8 << 20):
            h, bounds = shingle_sets(batch, width)
            yield pa.record_batch([batch.column("doc_id"), binaries(h, bounds), binaries((h >> np.uint64(32)).astype(np.uint32), bounds)], ["rep", "shingles", "halves"])

    return make


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their full sets."""

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = sets.select("rep", "shingles")
    first, second = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(first, "a").join(second, "b").mapInArrow(confirm, "a long, b long")


def _tiles(labelled: DataFrame, members: DataFrame, percent: int, least: float) -> DataFrame:
    """labelled (key, rep, component, size), members (rep, n, bands, sketch, halves): pairs of different components that may link.

    A bucket of more than TILE members is dealt into parts by a hash, and each two parts meet in a tile of their own. Within
    a tile a pair is looked at where its sizes and signatures leave a link possible and no earlier band has it too; only
    pairs whose half hashes allow the link leave the tile, so what leaves does not grow with the square of a bucket.
    """
    parts = F.ceil(F.col("size") / TILE).cast("int")
    tile = labelled.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    tile = tile.select("key", "rep", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tile = tile.select("key", "rep", "component", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    tile = tile.join(members, "rep")

    def compare(group: pa.Table) -> pa.Table:
        rep, component, part, n = (group.column(c).to_numpy() for c in ("rep", "component", "part", "n"))
        m = len(rep)
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(m, -1)
        keys = group.column("bands").combine_chunks()
        keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy().reshape(m, -1)
        halves = [np.unique(np.frombuffer(x.as_buffer(), np.uint32)) for x in group.column("halves")]
        key, across = group.column("key")[0].as_py(), group.column("p")[0].as_py() != group.column("q")[0].as_py()
        a, b = [], []
        for i in range(m - 1):
            fits = (component[i + 1 :] != component[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
            if across:
                fits &= part[i + 1 :] != part[i]
            other = i + 1 + np.flatnonzero(fits)
            other = other[(sketch[other] == sketch[i]).mean(axis=1) >= least]
            other = other[keys[i][(keys[other] == keys[i]).argmax(axis=1)] == key]
            for j in other.tolist():
                slack = n[i] + n[j] - len(halves[i]) - len(halves[j])
                both = min(len(np.intersect1d(halves[i], halves[j], assume_unique=True)) + slack, n[i], n[j])
                if 100 * both >= percent * (n[i] + n[j] - both):
                    a.append(max(rep[i], rep[j]))
                    b.append(min(rep[i], rep[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tile.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long").distinct()
