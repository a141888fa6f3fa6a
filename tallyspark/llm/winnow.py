"""Which parts of documents can repeat elsewhere: window minimizers, counted over all documents.

Any two equal windows of ``length`` tokens have the same smallest k-mer at the same place, so a window
that starts in two documents shows there the same *anchor*. Anchors that stand in two documents or more are
found by one packed exchange: each batch of documents sends every distinct anchor once (copies within the
batch are settled there, so that a hot anchor costs one entry a batch), and documents get back their
repeated anchors, packed by groups of documents under whose key their texts travel too. Everything else in a document cannot hold a repeated window and is left out of what follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import BASE32, BASE64, binaries, group_of, mix64, powers, ranges, runs, slices, utf8

CHUNK = 1 << 16


class Windows:
    """Windows of ``length`` tokens and their k-mers, of half the length if not said."""

    def __init__(self, length: int, k: int | None = None):
        self.length, self.k = length, k or length // 2
        self.span = length - self.k + 1  # k-mers in a window

    def anchors(self, small: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all window minimizers and their 32-bit rank hashes. small: 32-bit tokens; starts, ends: of the documents."""
        n, k, w = len(small), self.k, self.span
        valid = np.ones(n, bool)
        full = ends > starts
        for j in range(1, self.length):
            valid[np.maximum(ends[full] - j, starts[full])] = False
        places, ranks = [], []
        for s in range(0, n, CHUNK):
            lo, hi = max(0, s - w + 1), min(n, s + CHUNK + 2 * w + k)
            h = self._kmers(small[lo:hi])
            if len(h) < w:
                continue
            m = np.where(valid[lo : lo + len(h) - w + 1], _slide(h, w, np.minimum), 0)
            padded = np.zeros(len(m) + 2 * (w - 1), np.uint32)
            padded[w - 1 : w - 1 + len(m)] = m
            top = _slide(padded, w, np.maximum)  # top[i]: the greatest minimum of the windows that hold k-mer i
            at = np.flatnonzero(h == top[: len(h)])
            at = at[(at + lo >= s) & (at + lo < s + CHUNK)]
            places.append(at + lo)
            ranks.append(h[at])
        return (np.concatenate(places), np.concatenate(ranks)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _kmers(self, x: np.ndarray) -> np.ndarray:
        """Never 0. Doubling: the hash of 2j tokens comes from two hashes of j."""
        n = len(x) - self.k + 1
        if n <= 0:
            return np.zeros(0, np.uint32)
        out, done, part, j = None, 0, x, 1
        base = int(BASE32)
        while True:
            if self.k & j:
                if out is None:
                    out = part[:n]
                else:
                    out = out * np.uint32(pow(base, j, 2**32)) + part[done : done + n]
                done += j
            j *= 2
            if j > self.k:
                break
            part = part[: -(j // 2)] * np.uint32(pow(base, j // 2, 2**32)) + part[j // 2 :]
        out = (out ^ (out >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out = (out ^ (out >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return out | np.uint32(1)

    def names(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the k-mers at some places. tokens: bytes or 64-bit words."""
        return byte_gram_hash(tokens, at, self.k) if tokens.dtype == np.uint8 else gram_hash(tokens, at, self.k)

    def owned(self, at: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows whose leftmost smallest k-mer is each anchor. starts, ends: of its document."""
        w = self.span
        low, high = np.maximum(at - w + 1, starts), np.minimum(at, ends - self.length)
        for j in range(1, w):
            if len(at) <= j:
                break
            left = (at[j:] - at[:-j] < w) & (rank[:-j] <= rank[j:])
            low[j:] = np.where(left, np.maximum(low[j:], at[:-j] + 1), low[j:])
            right = (at[j:] - at[:-j] < w) & (rank[j:] < rank[:-j])
            high[:-j] = np.where(right, np.minimum(high[:-j], at[j:] - w), high[:-j])
        return low, high


def gram_hash(tokens: np.ndarray, at: np.ndarray, k: int, step: int = 1 << 17) -> np.ndarray:
    table = powers(BASE64, k)
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), step):
        part, h = at[a : a + step], out[a : a + step]
        for j in range(k):
            h += tokens[part + j] * table[j]
    return mix64(out)


def byte_gram_hash(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The same for bytes, read eight at a time; k is 8 or more."""
    if not len(at):
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(data) - 7, np.uint64, np.ascontiguousarray(data), strides=(1,))
    h = np.full(len(at), np.uint64(k))
    for j in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h = mix64(h * BASE64 + eight[at + j])
    return h


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours, by doubling."""
    n, j, y = len(x) - w + 1, 1, x
    while 2 * j <= w:
        y = f(y[:-j], y[j:])
        j *= 2
    return f(y[:n], y[w - j : w - j + n])


def bucket_bits(spark) -> int:
    """Buckets follow the cluster's setting of shuffle partitions, about 16 each."""
    return max(6, int(np.ceil(np.log2(16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def short_name(name: np.ndarray) -> np.ndarray:
    """What a document is told of an anchor: 32 bits, beside those of its bucket. A clash only adds a candidate."""
    return name.astype(np.uint32)


PACKED = "key long, kind int, a binary, b binary"
NAMES = ["key", "kind", "a", "b"]
#: Groups of documents for each shuffle partition, at least, and the bytes of text that one has on average, at most.
GROUPS, GROUP_BYTES = 2, 32 << 20


def document_groups(docs: DataFrame) -> int:
    """Into how many groups docs (text) go: one group's texts meet in one task's memory, so their number follows the bytes there are."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(GROUPS * shuffle_partitions(docs), -(-size // GROUP_BYTES))


def repeated_anchors(docs: DataFrame, windows: Windows, tokens, groups: int) -> DataFrame:
    """(group, a, b): packed short names, by group of documents, of the anchors that stand in two documents or more.

    docs: doc_id (not null), text. tokens: a function from a RecordBatch to (bytes or 64-bit tokens, 32-bit tokens, bounds).
    """
    bits, n = bucket_bits(docs.sparkSession), shuffle_partitions(docs)

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, limit=16 << 20):
            x64, x32, offs = tokens(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            at, _ = windows.anchors(x32, offs[1:], offs[:-1])
            if not len(at):
                continue
            name = windows.names(x64, at)
            doc = ids[np.searchsorted(offs, at, side="right") - 1]
            del x64, x32, at
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            new = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
            name, doc = name[new], doc[new]
            first = runs(name)
            many = np.diff(np.r_[first, len(name)]) > 1
            again = np.repeat(many, np.diff(np.r_[first, len(name)]))
            yield from _by_group(short_name(name[again]), doc[again], groups)
            name, doc = name[first], doc[first]
            order = np.lexsort((doc, name >> np.uint64(64 - bits)))  # by document within a bucket: the steps compress well
            name, doc = name[order], doc[order]
            cut = np.searchsorted(name >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            step = np.diff(doc, prepend=0)
            step[cut[full]] = doc[cut[full]]
            packed = [squeeze.compress(step[cut[i] : cut[i + 1]].tobytes()) for i in full]
            head = binaries(name.astype(np.uint32), np.r_[cut[full], len(name)])
            yield pa.record_batch([full, np.zeros(len(full), np.int32), head, pa.array(packed, pa.binary())], NAMES)

    def settle(batches):
        expand = zstandard.ZstdDecompressor()
        names, docs_ = [], []
        for batch in batches:
            for key, kind, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if kind:
                    continue
                low = np.frombuffer(a.as_buffer(), np.uint32)
                names.append((np.uint64(key) << np.uint64(32)) | low.astype(np.uint64))
                docs_.append(np.cumsum(np.frombuffer(expand.decompress(b.as_py()), np.int64)))
            if batch.num_rows:
                yield batch.filter(pc.equal(batch.column("kind"), 1))
        if not names:
            return
        name, doc = np.concatenate(names), np.concatenate(docs_)
        del names, docs_
        order = np.argsort(name)
        name, doc = name[order], doc[order]
        first = runs(name)
        apart = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keep = np.repeat(apart, np.diff(np.r_[first, len(name)]))
        yield from _by_group(short_name(name[keep]), doc[keep], groups)

    sent = docs.select("doc_id", "text").mapInArrow(send, PACKED).repartition(n, "key")
    return sent.mapInArrow(settle, PACKED).selectExpr("key AS group", "a", "b")


def _by_group(name: np.ndarray, doc: np.ndarray, groups: int):
    """Rows of kind 1: each group's documents and how many names each has, and the names."""
    if not len(name):
        return
    squeeze = zstandard.ZstdCompressor(level=1)
    group = group_of(doc, groups)
    order = np.lexsort((doc, group))
    name, doc, group = name[order], doc[order], group[order]
    of_doc = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])])
    ids, counts = doc[of_doc], np.diff(np.r_[of_doc, len(doc)]).astype(np.int32)
    head = runs(group)
    cut = np.r_[np.searchsorted(of_doc, head), len(ids)].tolist()
    heads = [squeeze.compress(ids[a:b].tobytes() + counts[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    yield pa.record_batch([group[head], np.ones(len(head), np.int32), pa.array(heads, pa.binary()), binaries(name, np.r_[head, len(name)])], NAMES)


def with_names(rows: DataFrame, packed: DataFrame, everything: bool, then=None, schema: str = "doc_id long, row long, text binary, names binary") -> DataFrame:
    """rows (doc_id, row, group, text) with the names of their repeated anchors; rows without any only if everything is asked.

    then: what is made of a group's rows in the same task (batches to batches of the schema; needs everything), so that no
    second Python process holds them.
    """

    def pair(texts: pa.Table, told: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        ids, counts, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a, b in zip(told.column("a").to_pylist(), told.column("b").to_pylist(), strict=True):
            head = expand.decompress(a)
            n = len(head) // 12
            ids.append(np.frombuffer(head, np.int64, n))
            counts.append(np.frombuffer(head, np.int32, n, 8 * n).astype(np.int64))
            names.append(np.frombuffer(b, np.uint32))
        ids, counts, names = np.concatenate(ids), np.concatenate(counts), np.concatenate(names)
        order = np.argsort(ids, kind="stable")
        names = names[ranges((np.cumsum(counts) - counts)[order], counts[order])]
        at = np.r_[0, np.cumsum(counts[order])]
        doc = texts.column("doc_id").to_numpy()
        a, b = at[np.searchsorted(ids[order], doc)], at[np.searchsorted(ids[order], doc, side="right")]
        which = np.arange(len(doc)) if everything else np.flatnonzero(b > a)
        own = binaries(names[ranges(a[which], (b - a)[which])], np.r_[0, np.cumsum((b - a)[which])])
        named = texts.take(pa.array(which)).select(["doc_id", "row", "text"]).append_column("names", own)
        return pa.Table.from_batches(list(then(named.to_batches()))) if then else named

    return rows.groupBy("group").cogroup(packed.groupBy("group")).applyInArrow(pair, schema)


def is_repeated(names: pa.Array, which: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For anchors (short name, row of the batch), whether that row's names have them."""
    flat, bounds = utf8(names)
    rows = np.repeat(np.arange(len(names)), np.diff(bounds) // 4)
    seed = lambda x, r: mix64(x.astype(np.uint64) + r.astype(np.uint64) * BASE64)
    return np.isin(seed(which, row), seed(flat.view(np.uint32), rows))
