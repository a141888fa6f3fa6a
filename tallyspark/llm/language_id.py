"""Language identification by the nearest centroid: normalised TF-IDF vectors of character n-grams, several clustered centroids a language, cosine, rejection by distance.

Method: a text's words (runs of letters, lower-cased, a space at either end) give n-grams of one to three characters, hashed
into a fixed number of places; a place's weight is (1 + log count) * log((1 + N) / (1 + n)), N and n counted over all
rows that may be learned from; vectors have unit length. The vectors of at most ``sample`` rows of each language (those
with the smallest hashes) fall into ``clusters`` clusters by spherical k-means, each language in its own task. A text
takes the language of the centroid of the greatest cosine. Its score is the softmax of the languages' best cosines at
a fixed temperature, 0 to 1. It is ``accepted`` if it is no farther from that centroid than nearly all
sampled texts of that cluster are (``reject``: the share of them left outside) and somewhat more.

What is gathered is of a fixed size: places' counts, and clusters * languages vectors, of at most ``MOST`` languages,
else the fit refuses. Texts are cut into pieces of bounded size, each n-gram counted once, so that memory doesn't grow with a text.

Defined cases: a null text, or one without a letter, is und with score 0 and not accepted; so is every text if nothing
can be learned. A null or empty lang isn't learned from; rows without a letter count in nothing. Of languages equally
near, the first in order wins. Repeated rows each count and each give a row. An empty table gives an empty result. Only the
key and the text of docs are read for a prediction; the result's names are its own, so that other columns may clash.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.llm.batches import binaries, give_back, slices

PLACES = 1 << 14
SIZES = (1, 2, 3)
#: Languages that a model may have.
MOST = 200
#: Characters of a long text looked at together.
PIECE = 1 << 20
UNKNOWN = "und"
TEMPERATURE = 0.05
#: Cosine by which a text may lie outside what its cluster's sample reaches.
SLACK = 0.05


@functools.cache
def kinds() -> np.ndarray:
    """Of each code point: 2 for letters, 1 for the marks that join them, else 0."""
    of = {"L": 2, "M": 1}
    return np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def letters(text: str, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a lower-cased piece with one 0 for each run of others, and which of the piece's they are; ``after`` is what came before it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = kinds()[code] > 0
    before = np.empty(len(code), bool)
    before[1:] = inside[:-1]
    before[:1] = after[-1] != 0
    kept = inside | before
    return np.where(inside, code, 0)[kept].astype(np.uint32), kept


def grams(code: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams that end at code[new] or later, and where each ends. No n-gram has a space within, or is one."""
    place, ends = [], []
    for size in SIZES:
        lo = max(new, size - 1)
        n = len(code) - lo
        if n <= 0:
            continue
        h = np.full(n, 0x9E37 + size, np.uint32)
        for j in range(size):
            h = (h ^ code[lo - size + 1 + j : lo - size + 1 + j + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        good = code[lo:] != 0 if size == 1 else np.ones(n, bool)
        for j in range(1, size - 1):
            good &= code[lo - size + 1 + j : lo - size + 1 + j + n] != 0
        h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(18)
        place.append(h[good])
        ends.append(np.flatnonzero(good) + lo)
    return (np.concatenate(place), np.concatenate(ends)) if place else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of the n-grams of texts, by row and place; rows without a letter have none."""
    total = np.zeros(len(texts) * PLACES, np.uint32)
    start = np.zeros(2, np.uint32)
    small = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    lows = [texts[i].lower() for i in small]
    if lows:
        code, kept = letters(" ".join(lows) + " ", start)
        row = np.repeat(np.array(small), [len(t) + 1 for t in lows])[kept]
        place, ends = grams(np.r_[np.zeros(1, np.uint32), code], 1)
        total += np.bincount(row[ends - 1] * PLACES + place, minlength=len(total)).astype(np.uint32)
    for i in sorted(set(range(len(texts))) - set(small)):
        low, carry = texts[i].lower() + " ", start
        for a in range(0, len(low), PIECE):
            code = np.r_[carry, letters(low[a : a + PIECE], carry)[0]]
            place, _ = grams(code, 2)
            total[i * PLACES : (i + 1) * PLACES] += np.bincount(place, minlength=PLACES).astype(np.uint32)
            carry = code[-2:]
    lettered = np.array([has_letter(t) for t in texts], bool)
    total.reshape(-1, PLACES)[~lettered] = 0
    at = np.flatnonzero(total)
    return at // PLACES, at % PLACES, total[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vectors(row: np.ndarray, place: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """A row of unit length for each text, zero for those without n-grams."""
    value = (1 + np.log(count)) * idf[place]
    norm = np.sqrt(np.bincount(row, value**2, n))
    out = np.zeros((n, PLACES), np.float32)
    out[row, place] = value / np.maximum(norm, 1e-12)[row]
    return out


def clustered(rows: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length by spherical k-means from rows that are far apart, and each row's cluster."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    mean = unit(rows.sum(axis=0, keepdims=True))
    chosen = [int(np.argmax(rows @ mean[0]))]
    near = rows @ rows[chosen[0]]
    while len(chosen) < clusters:
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
        near = np.maximum(near, rows @ rows[far])
    centres, of = rows[chosen], None
    for _ in range(rounds):
        now = np.argmax(rows @ centres.T, axis=1)
        if of is not None and (now == of).all():
            break
        of = now
        centres = unit(np.stack([rows[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))]))
    return centres, np.argmax(rows @ centres.T, axis=1)


class Centroids:
    """Weights of places; of each centroid its language, its vector and the least cosine it accepts."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, least: np.ndarray):
        self.idf, self.centres, self.least = idf, centres, least
        self.names = sorted(set(langs))
        self.of = np.array([self.names.index(x) for x in langs], int)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine and accepted of each text."""
        row, place, count = counted(texts)
        known = np.bincount(row, minlength=len(texts)) > 0
        if not self.names or not known.any():
            zero = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), zero, zero, zero > 0
        cosine = vectors(row, place, count, len(texts), self.idf) @ self.centres.T
        best = np.stack([cosine[:, self.of == j].max(axis=1) for j in range(len(self.names))], axis=1).astype(float)
        lang, at = best.argmax(axis=1), cosine.argmax(axis=1)
        top = best[np.arange(len(texts)), lang]
        score = 1 / np.exp((best - top[:, None]) / TEMPERATURE).sum(axis=1)
        return [self.names[j] if k else UNKNOWN for j, k in zip(lang, known, strict=True)], np.where(known, score, 0.0), np.where(known, np.clip(top, 0, 1), 0.0), known & (top >= self.least[at] - SLACK)


def _pieces(batches, limit: int = 1 << 20, rows: int = 256):
    """Slices of bounded text and number of rows, with their texts as Python strings."""
    for batch in slices(batches, limit=limit):
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            yield part, [t or "" for t in part.column("text").to_pylist()]
    give_back()


def document_counts(docs: DataFrame) -> DataFrame:
    """(place, n): in how many texts each place occurs, and with place -1 how many have a letter; a row for each place and task crosses the network."""

    def count(batches):
        n, total = np.zeros(PLACES, np.int64), 0
        for _, texts in _pieces(batches):
            row, place, _ = counted(texts)
            n += np.bincount(place, minlength=PLACES)
            total += len(np.unique(row))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[total, n[at]])], ["place", "n"])

    return docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def fit_centroids(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = 1000, clusters: int = 4, reject: float = 0.01) -> Centroids:
    """The model of all rows of docs that have a language: document counts over all of them, centroids from at most ``sample`` of each language."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
    rows = rows.withColumn("hash", F.xxhash64("text", "lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages are too many for one model")
    if not sizes:
        return Centroids(np.zeros(PLACES), [], np.zeros((0, PLACES), np.float32), np.zeros(0))
    found = {r["place"]: r["n"] for r in document_counts(rows).collect()}  # at most PLACES + 1
    total = found.pop(-1, 0)
    n = np.zeros(PLACES)
    n[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + n))
    # A hash below the share that gives twice the sample; smaller languages go whole. What is ranked is near the sample's size.
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * sample / r["n"])))))
    some = rows.filter(F.pmod("hash", F.lit(1 << 20)) <= F.element_at(share, F.col("lang")) * (1 << 20))
    chosen = some.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("hash"))).filter(F.col("place") <= sample)

    def make(batches):
        for batch, texts in _pieces(batches):
            row, place, count = counted(texts)
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            yield pa.record_batch([batch.column("lang"), batch.column("hash"), binaries(place.astype(np.int32), bounds), binaries(count.astype(np.int32), bounds)], ["lang", "hash", "place", "count"])

    def cluster(key, group):
        group = group.sort_values("hash", kind="stable")
        sizes = [len(x) // 4 for x in group["place"]]
        flat = lambda c: np.frombuffer(b"".join(group[c]), np.int32)
        x = vectors(np.repeat(np.arange(len(group)), sizes), flat("place"), flat("count"), len(group), idf)
        centres, of = clustered(x, clusters)
        near = (x * centres[of]).sum(axis=1)
        least = [float(np.quantile(near[of == j], reject)) if (of == j).any() else 1.0 for j in range(len(centres))]
        return pd.DataFrame({"lang": key[0], "centre": [c.tobytes() for c in centres], "least": least})

    sparse = chosen.select("lang", "hash", "text").mapInArrow(make, "lang string, hash long, place binary, count binary").filter("length(place) > 0")
    made = sorted(map(tuple, sparse.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, least double").collect()))  # clusters * languages
    centres = np.stack([np.frombuffer(c, np.float32) for _, c, _ in made]) if made else np.zeros((0, PLACES), np.float32)
    return Centroids(idf, [x for x, _, _ in made], centres, np.array([x for _, _, x in made]))


def identify(docs: DataFrame, model: Centroids, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, cosine, accepted) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def judge(batches):
        for batch, texts in _pieces(batches):
            lang, score, cosine, accepted = sent.value.judge(texts)
            yield pa.record_batch([batch.column(key), pa.array(lang, pa.string()), score, cosine, pc.cast(pa.array(accepted), pa.bool_())], [key, "lang_pred", "score", "cosine", "accepted"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(judge, f"`{key}` {dict(rows.dtypes)[key]}, lang_pred string, score double, cosine double, accepted boolean")


def held_out(key: Column, parts: int = 3, part: int = 1) -> Column:
    """Rows that a model must not learn from, by the key as text; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part
