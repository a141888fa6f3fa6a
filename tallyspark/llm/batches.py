"""Arrow and numpy helpers shared by the operators: text bytes, words, hashes, packed rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes that stand between words: space, tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~BLANKS
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
#: A random odd number for each byte, and the base of the rolling hashes.
BYTE64 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE32 = (BYTE64 >> np.uint64(17)).astype(np.uint32) | np.uint32(1)
BASE64 = np.uint64(0x9E3779B97F4A7C15)
BASE32 = np.uint32(0x9E3779B1)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that every bit of a hash depends on all of its input."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(base, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return to the system what a task's arrays used: the worker stays, idle, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array and each row's bounds in it; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, bounds, data = column.buffers()
    offs = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offs[0] : offs[-1]], offs - offs[0]


def find_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``table``'s bytes, and each row's bounds in those lists; none spans two rows."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offs[(offs > 0) & (offs < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each byte span; about ``step`` bytes are worked on at a time."""
    out = np.zeros(len(starts), np.uint64)
    lens = ends - starts
    table = powers(BASE64, int(lens.max(initial=1)))
    step = max(1, step * len(lens) // max(1, int(lens.sum())))
    for a in range(0, len(starts), step):
        n, s = lens[a : a + step], starts[a : a + step]
        at = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(at, n)
        value = BYTE64[data[inner + np.repeat(s, n)]] * table[inner]
        out[a : a + step] = np.add.reduceat(value, at) if len(value) else 0
    return mix64(out + lens.astype(np.uint64) * BASE64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hash_spans(data, starts, ends)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + counts[0] - 1, starts[1], ..."""
    at = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(at - starts, counts)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of an array's bytes, cut at bounds, which count items."""
    data = np.ascontiguousarray(data)
    offs = (bounds * data.itemsize).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offs), pa.py_buffer(data)])
    return whole.cast(pa.binary())


def covered(starts: np.ndarray, lens: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lens, -1)
    return np.cumsum(edge)[:n] > 0


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a document is in: groups are what texts and what is told of them travel under."""
    return (mix64(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def squeezed(docs, groups: int, tag: str = "xxhash64(text) & 4294967295"):
    """docs (doc_id, text) with row, a tag of the text, the document's group, and the text compressed: what moves a text costs less so."""

    def squeeze(batches):
        with_level = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            group = group_of(batch.column("doc_id").to_numpy(zero_copy_only=False), groups)
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), group, pa.array([with_level.compress(t or b"") for t in texts], pa.binary())], ["doc_id", "row", "group", "text"])

    return docs.selectExpr("doc_id", f"{tag} AS row", "text").mapInArrow(squeeze, "doc_id long, row long, group long, text binary")


def expanded(batches: Iterator[pa.RecordBatch], limit: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of squeezed() with their texts back, about ``limit`` bytes of them."""
    expand = zstandard.ZstdDecompressor()
    for batch in slices(batches, limit=limit * 2 // 5):
        texts = pa.array([expand.decompress(x) for x in batch.column("text").to_pylist()], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)
