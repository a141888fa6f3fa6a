"""A quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Method: a document's features are its words, hashed into a fixed number of places and of unit length together, shares
of kinds of characters and repeats, and its size. The score is linear in the features plus the products of all pairs,
whose weights are inner products of short vectors; sum over pairs = half of (square of the sum - sum of the squares),
so that scoring is linear in the features. The model is fitted by Adagrad on a bounded sample of labelled rows
(``sample``, those with the smallest hashes of doc_id) and has a fixed size; scoring covers every whole text.

Defined cases: a null text is empty and has a score like any; labels that are null or whose doc_id is null or absent
are left out, a document labelled twice counts twice; without labels every score is 0.5; labels of equal hashes at the
cut of the sample go by doc_id, then label; repeated rows each give a row; a text of any length is read whole; an empty
table gives an empty result; of the documents' columns only doc_id and text are read, and those to keep must not be
called doc_id, held_out, score or predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import LOWER, binaries, find_words, hash_words, slices, utf8

PLACES = 1 << 14


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


KINDS = [_table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"!"), _table(b"0123456789"), _table(b".,;:?"), _table(b"{}[]()=/\\_@"), _table(bytes(range(128, 256))), _table(b"\n")]
STATISTICS = len(KINDS) + 6


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of all rows' features, and the rows' bounds. Statistics take the last places."""
    data, offs = utf8(column)
    n = len(offs) - 1
    size = np.diff(offs)
    starts, ends, bounds = find_words(data, offs)
    h = hash_words(LOWER[data], starts, ends)
    words = np.diff(bounds)
    row = np.repeat(np.arange(n), words)
    key, count = np.unique(row * PLACES + (h % np.uint64(PLACES)).astype(np.int64), return_counts=True)
    of = key // PLACES
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(of, value**2, n))
    value = value / np.maximum(norm[of], 1e-9)
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, np.int64)
    stats = np.zeros((n, STATISTICS))
    for j, kind in enumerate(KINDS):
        stats[:, j] = np.minimum(1, 4 * np.diff(np.searchsorted(np.flatnonzero(kind[data]), offs)) / np.maximum(size, 1))
    some = np.maximum(words, 1)
    stats[:, -6] = np.bincount(row[again], minlength=n) / some
    stats[:, -5] = np.bincount(of, minlength=n) / some
    stats[:, -4] = np.minimum(1, np.bincount(row, ends - starts, n) / some / 20)
    stats[:, -3] = np.log1p(words) / 15
    stats[:, -2] = words == 0
    stats[:, -1] = words < 20
    place = np.r_[key % PLACES, np.tile(PLACES + np.arange(STATISTICS), n)]
    rows = np.r_[of, np.repeat(np.arange(n), STATISTICS)]
    order = np.argsort(rows, kind="stable")
    return place[order], np.r_[value, stats.ravel()][order], np.searchsorted(rows[order], np.arange(n + 1))


class FactorMachine:
    def __init__(self, rank: int = 8, seed: int = 3):
        self.bias = 0.0
        self.linear = np.zeros(PLACES + STATISTICS)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (PLACES + STATISTICS, rank))

    def raw(self, place, value, bounds) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each row, and the rows' sums of weighted vectors. No row is without features."""
        weighed = self.factors[place] * value[:, None]
        total = np.add.reduceat(weighed, bounds[:-1])
        pairs = 0.5 * (total**2 - np.add.reduceat(weighed**2, bounds[:-1])).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[place] * value, bounds[:-1]) + pairs, total

    def fit(self, place, value, bounds, label, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> None:
        rng = np.random.default_rng(5)
        g0, g1, g2 = 1e-6, np.full(len(self.linear), 1e-6), np.full(self.factors.shape, 1e-6)
        n = len(label)
        share = min(max(label.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                rows = order[a : a + batch]
                per = bounds[rows + 1] - bounds[rows]
                at = np.repeat(bounds[rows], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
                p, x, cut = place[at], value[at], np.r_[0, np.cumsum(per)]
                raw, total = self.raw(p, x, cut)
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]
                each = np.repeat(error, per) * x
                slope = each[:, None] * (np.repeat(total, per, axis=0) - self.factors[p] * x[:, None])
                used, of = np.unique(p, return_inverse=True)
                d1 = np.bincount(of, each, len(used)) / len(rows) + decay * self.linear[used]
                order_ = np.argsort(of, kind="stable")
                d2 = np.add.reduceat(slope[order_], np.searchsorted(of[order_], np.arange(len(used)))) / len(rows) + decay * self.factors[used]
                g1[used] += d1**2
                g2[used] += d2**2
                self.linear[used] -= rate * d1 / np.sqrt(g1[used])
                self.factors[used] -= 0.2 * rate * d2 / np.sqrt(g2[used])
                d0 = error.mean()
                g0 += d0**2
                self.bias -= rate * d0 / np.sqrt(g0)


def in_training(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 4 != 2


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8000) -> FactorMachine:
    """The model of labels (doc_id, label 0 or 1) on at most ``sample`` of their documents, none of them held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(in_training(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # bounded, so it may be broadcast

    def make(batches):
        for batch in slices(batches, limit=8 << 20):
            place, value, bounds = features(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), binaries(place.astype(np.int32), bounds), binaries(value.astype(np.float32), bounds)], ["doc_id", "y", "place", "value"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(make, "doc_id long, y int, place binary, value binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["value"])))
    model = FactorMachine()
    if not rows:
        model.factors[:] = 0
    else:
        sizes = [len(r["place"]) // 4 for r in rows]
        join = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
        model.fit(join("place", np.int32).astype(np.int64), join("value", np.float32).astype(float), np.r_[0, np.cumsum(sizes)], np.array([r["y"] for r in rows], float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 8000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, score, predicted (1 if score >= 0.7) and the columns to keep, text among them or not."""
    clash = {"doc_id", "held_out", "score", "predicted"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep that the result has itself: {sorted(clash)}")
    model = fit_quality(docs, labels, sample=sample)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))  # of a fixed size

    def score(batches):
        own = FactorMachine(1)
        own.bias, own.linear, own.factors = sent.value
        for batch in slices(batches, limit=6 << 20):
            raw, _ = own.raw(*features(batch.column("text")))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *keep)), 1 / (1 + np.exp(-np.clip(raw, -30, 30)))], ["doc_id", *keep, "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in keep if c != "text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scored = rows.mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", score double")
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"), *keep)
