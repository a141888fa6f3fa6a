"""Suffix-array dedup: maximal repeats among documents, and the bytes that an earlier document holds too.

Method: the suffixes that can repeat (those at repeated window minimizers, see ``winnow``) go to the task of
their minimizer. A run is the text of the windows that share a minimizer; equal runs are one there, with all their
occurrences. The task builds an enhanced suffix array of the different runs (suffixes in order, and the common prefix
of each with the one before). A scan with a stack turns that into the tree of common-prefix intervals: an interval of
``length`` bytes or more is a repeat with all its occurrences. It is left-diverse if its occurrences are preceded by
different bytes, by nothing, or begin a run; only such intervals are maximal, and what others would remove a
left-diverse one removes as well. The smallest document of an interval keeps its bytes, all later ones lose them.
A repeat is known as far as the runs of one minimizer go (at most ``length`` + 30 bytes at length 50), so a longer one
comes as several groups that overlap, each with all its occurrences.

Defined cases: a null text is empty; matches never cross documents; rows that share a doc_id count as one
document (no row of it is earlier than another) and each gives a row, told apart by 32 bits of a hash of the text; rows
with a null doc_id have no order, so they lose nothing and take nothing from others; a text of any length is one row
and is worked on whole; an empty table gives an empty result; columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import BYTE32, covered, expanded, group_of, hash_spans, ranges, squeezed, utf8
from tallyspark.llm.winnow import Windows, bucket_bits, document_groups, is_repeated, repeated_anchors, short_name, shuffle_partitions, with_names

#: A window run: 32 bits of its anchor, document, tag of its row, first window's start, places from it to the anchor, windows, byte before (or -1).
ENTRY = np.dtype([("name", "<u4"), ("doc", "<i8"), ("row", "<u4"), ("start", "<i4"), ("lead", "u1"), ("count", "u1"), ("left", "<i2")])
#: Windows start..start+count-1 of a document's row are repeats.
SPAN = np.dtype([("start", "<i4"), ("count", "<i4")])
#: Masks of the first 0 to 8 bytes of a big-endian number.
KNOWN = np.array([0] + [(2**64 - 1) >> (64 - 8 * n) << (64 - 8 * n) for n in range(1, 9)], np.uint64)
#: Suffixes that are sorted at a time, about.
PART = 300_000
FOUND = np.dtype([("doc", "<i8"), ("row", "<u4"), ("span", SPAN)])
MOVED = "key long, kind int, a binary, b binary"
NAMES = ["key", "kind", "a", "b"]
GROUPS = "group_id long, n_bytes int, doc_id long, row long, start int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>"


def byte_tokens(batch: pa.RecordBatch):
    data, offs = utf8(batch.column("text"))
    return data, BYTE32[data], offs


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(common prefix, first, end, parent) of each interval of the suffix array whose suffixes share ``least`` bytes or more.

    lcp[i]: the common prefix of suffixes i-1 and i; lcp[0] is 0. One pass with a stack over the places where the common
    prefix changes: an interval opens where it rises and closes where it falls. parent: the place in the list of the
    enclosing interval, or -1.
    """
    x = np.where(lcp >= least, lcp, 0)
    change = np.flatnonzero(np.diff(np.r_[0, x, 0]))
    found: list[list[int]] = []
    stack: list[int] = []  # open intervals, as places in found
    for i, v in zip(change.tolist(), np.r_[x, 0][change].tolist(), strict=True):
        first, last = i - 1, -1
        while stack and found[stack[-1]][0] > v:
            last = stack.pop()
            found[last][2] = i
            first = found[last][1]
            if stack and found[stack[-1]][0] >= v:
                found[last][3] = stack[-1]
                last = -1
        if v and (not stack or found[stack[-1]][0] < v):
            found.append([v, first, i, -1])
            if last >= 0:
                found[last][3] = len(found) - 1
            stack.append(len(found) - 1)
    return [tuple(x) for x in found]


class EnhancedSuffixArray:
    """The windows of different runs as sorted suffixes. Each suffix is known as far as its run's text goes.

    runs: ENTRY rows; data, text_at: their texts; left: least and greatest byte before the occurrences of each run.
    """

    def __init__(self, runs: np.ndarray, data: np.ndarray, text_at: np.ndarray, left: tuple[np.ndarray, np.ndarray], length: int):
        count = runs["count"].astype(np.int64)
        self.run = np.repeat(np.arange(len(runs)), count)
        self.offset = ranges(np.zeros(len(runs), np.int64), count)
        at = text_at[self.run] + self.offset
        reach = (count + length - 1)[self.run] - self.offset
        padded = np.r_[data, np.zeros(8, np.uint8)]
        eight = np.ndarray(len(padded) - 7, np.dtype(">u8"), padded, strides=(1,))
        # Equal windows have one anchor at one place.
        keys = [(runs["name"][self.run].astype(np.uint64) << np.uint64(32)) + (runs["lead"][self.run] - self.offset + 256).astype(np.uint64)]
        keys += [eight[at + j].astype(np.uint64) for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]]
        order = np.lexsort(keys[::-1])
        self.run, self.offset, at, self.reach = self.run[order], self.offset[order], at[order], reach[order]
        same = np.ones(max(len(order) - 1, 0), bool)
        for key in keys:
            key = key[order]
            same &= key[1:] == key[:-1]
        del keys
        # Equal windows in order of what follows them, as far as each goes.
        tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        group = np.cumsum(np.r_[True, ~same][: len(order)])[tied]
        more = [eight[np.minimum(at[tied] + j, len(eight) - 1)].astype(np.uint64) & KNOWN[np.clip(self.reach[tied] - j, 0, 8)] for j in range(length, int(reach.max(initial=0)), 8)]
        to = tied[np.lexsort([*more[::-1], group])]
        for x in (self.run, self.offset, at, self.reach):
            x[tied] = x[to]
        self.lcp = np.zeros(len(at), np.int64)
        live = np.flatnonzero(same) + 1
        self.lcp[live] = length
        for j in range(length, int(reach.max(initial=0))):  # beyond the window as far as both texts go
            live = live[(self.reach[live] > j) & (self.reach[live - 1] > j)]
            live = live[data[at[live] + j] == data[at[live - 1] + j]]
            if not len(live):
                break
            self.lcp[live] = j + 1
        inner = self.offset > 0
        before = data[at - inner].astype(np.int64)
        self.low_left, self.high_left = (np.where(inner, before, x[self.run]) for x in left)

    def maximal(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common prefix, first and end of the left-diverse intervals of the tree."""
        tree = np.array(lcp_intervals(self.lcp, length), np.int64).reshape(-1, 4)
        size, first, end = tree[:, 0], tree[:, 1], tree[:, 2]
        low, high, least = (reduced(f, x, first, end) for f, x in ((np.minimum, self.low_left), (np.maximum, self.high_left), (np.minimum, self.offset)))
        diverse = (low != high) | (low < 0) | (least == 0)
        return size[diverse], first[diverse], end[diverse]


def reduced(f, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """f over x[first:end], for each."""
    return f.reduceat(np.r_[x, x[-1:]], np.c_[first, end].ravel())[::2] if len(first) else x[:0]


class Bucket:
    """Runs of some minimizers: equal ones as one, with the smallest document of each of their windows."""

    def __init__(self, entries: np.ndarray, data: np.ndarray, length: int):
        self.length, self.entries, self.data = length, entries, data
        size = entries["count"].astype(np.int64) + length - 1
        text_at = np.cumsum(size) - size
        whole = hash_spans(data, text_at, text_at + size)
        order = np.lexsort((entries["doc"], whole, entries["lead"], entries["name"]))
        new = np.zeros(len(order), bool)
        new[runs_of(entries["name"][order], entries["lead"][order], whole[order])] = True
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        odd = ~equal_texts(data, text_at[order], text_at[head], size[order], size[head])
        if odd.any():  # a clash of hashes leaves each such run for itself, after the others of its anchor
            group = np.where(odd, len(order) + np.arange(len(order)), np.cumsum(new))
            again = np.lexsort((group, entries["name"][order]))
            order, group = order[again], group[again]
            new = np.zeros(len(order), bool)
            new[runs_of(group)] = True
        self.order, self.of = order, np.cumsum(new) - 1  # occurrences by run, and their runs
        at = np.flatnonzero(new)
        self.cut = np.r_[at, len(order)]
        self.runs, self.text_at = entries[order[at]], text_at[order[at]]
        left = entries["left"][order].astype(np.int64)
        self.left = tuple(f.reduceat(left, at) if len(at) else left for f in (np.minimum, np.maximum))
        self.window_at = np.r_[0, np.cumsum(self.runs["count"].astype(np.int64))]
        self.lowest = np.minimum.reduceat(entries["doc"][order], at) if len(at) else entries["doc"]

    def arrays(self, everything: bool):
        """(runs, suffix array) of parts of the bucket; runs that are alone with their anchor only if everything is asked."""
        first = runs_of(self.runs["name"])
        alone = np.repeat(np.diff(np.r_[first, len(self.runs)]) == 1, np.diff(np.r_[first, len(self.runs)]))
        which = np.flatnonzero(~alone | everything)
        parts = max(1, int(self.runs["count"][which].sum()) // PART)
        for r in range(parts):  # equal windows have one anchor name, so parts by name are apart
            mine = which[self.runs["name"][which] % np.uint32(parts) == r]
            if len(mine):
                yield mine, EnhancedSuffixArray(self.runs[mine], self.data, self.text_at[mine], tuple(x[mine] for x in self.left), self.length)

    def lost(self) -> np.ndarray:
        """FOUND rows: the windows of occurrences that a smaller document has too."""
        low = np.repeat(self.lowest, np.diff(self.window_at))  # an interval of one suffix has the occurrences of its run
        for mine, array in self.arrays(False):
            own = self.lowest[mine][array.run]
            size, first, end = array.maximal(self.length)
            smallest = reduced(np.minimum, own, first, end)
            member = ranges(first, end - first)
            node = np.repeat(np.arange(len(first)), end - first)
            later = own[member] > smallest[node]
            member, node = member[later], node[later]
            windows = size[node] - self.length + 1  # the interval's string holds so many windows
            at = ranges(self.window_at[mine[array.run[member]]] + array.offset[member], windows)
            np.minimum.at(low, at, np.repeat(smallest[node], windows))
        e = self.entries[self.order]
        count = e["count"].astype(np.int64)
        gone = low[ranges(self.window_at[self.of], count)] < np.repeat(e["doc"], count)
        cut = np.cumsum(count) - count
        opens, closes = gone.copy(), gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[cut] = gone[cut]
        closes[:-1] &= ~gone[1:]
        closes[cut[1:] - 1] = gone[cut[1:] - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        of = np.searchsorted(cut, a, side="right") - 1
        out = np.zeros(len(a), FOUND)
        out["doc"], out["row"], out["span"]["start"], out["span"]["count"] = e["doc"][of], e["row"][of], e["start"][of] + a - cut[of], b - a + 1
        return out

    def groups(self):
        """(group, bytes, entry, start) of the maximal repeats: every place of each."""
        for mine, array in self.arrays(True):
            size, first, end = array.maximal(self.length)
            # A run that no other goes on from is a repeat by itself, if it occurs twice.
            longest = np.maximum(array.lcp, np.r_[array.lcp[1:], 0])
            leaf = np.flatnonzero((array.offset == 0) & (longest < array.reach) & (np.diff(self.cut)[mine[array.run]] > 1))
            size, first, end = np.r_[size, array.reach[leaf]], np.r_[first, leaf], np.r_[end, leaf + 1]
            member, node = ranges(first, end - first), np.repeat(np.arange(len(first)), end - first)
            run, offset = mine[array.run[member]], array.offset[member]
            times = np.diff(self.cut)[run]
            entry = self.order[ranges(self.cut[run], times)]
            at = self.text_at[mine[array.run[first]]] + array.offset[first]
            name = hash_spans(self.data, at, at + size)
            yield np.repeat(name[node], times), np.repeat(size[node], times), entry, self.entries["start"][entry] + np.repeat(offset, times)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The bytes of many spans, one after the other; places are worked out for some spans at a time."""
    parts = [data[ranges(starts[i : i + step], sizes[i : i + step])] for i in range(0, len(starts), step)]
    return np.concatenate([data[:0], *parts])


def equal_texts(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Whether n bytes from each a are the m bytes from b."""
    out = n == m
    ask = np.flatnonzero(out & (a != b))
    for i in range(0, len(ask), step):
        at = ask[i : i + step]
        size = n[at]
        differs = data[ranges(a[at], size)] != data[ranges(b[at], size)]
        out[at] = np.add.reduceat(differs, np.cumsum(size) - size) == 0
    return out


def _sender(windows: Windows, few: int, groups: int, merge: bool):
    """Batches of (doc_id, row, text, names) to MOVED: runs by bucket, and with merge the windows lost to a document of the batch."""
    length = windows.length

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in expanded(batches):
            data, offs = utf8(batch.column("text"))
            ids, row = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("row").to_numpy(zero_copy_only=False)
            at, rank = windows.anchors(BYTE32[data], offs[1:], offs[:-1])
            of = np.searchsorted(offs, at, side="right") - 1
            name = windows.names(data, at)
            low, high = windows.owned(at, rank, offs[of], offs[of + 1])
            keep = (low <= high) & is_repeated(batch.column("names"), short_name(name), of)
            at, of, name, low, high = at[keep], of[keep], name[keep], low[keep], high[keep]
            if not len(at):
                continue
            e = np.zeros(len(at), ENTRY)
            e["name"], e["doc"], e["row"], e["start"], e["lead"], e["count"] = name.astype(np.uint32), ids[of], row[of], low - offs[of], at - low, high - low + 1
            e["left"] = np.where(low > offs[of], data[np.maximum(low, 1) - 1], -1)
            if merge:  # of equal runs within the batch the smallest document speaks for all, later ones lose the run
                size = high - low + length
                whole = hash_spans(data, low, low + size)
                order = np.lexsort((e["doc"], e["lead"], whole, name))
                e, low, name, size = e[order], low[order], name[order], size[order]
                head = runs_of(name, whole[order], e["lead"])
                first = np.repeat(head, np.diff(np.r_[head, len(e)]))
                lost = (e["doc"] > e["doc"][first]) & equal_texts(data, low, low[first], size, size[first])
                found = np.zeros(int(lost.sum()), FOUND)
                found["doc"], found["row"], found["span"]["start"], found["span"]["count"] = e["doc"][lost], e["row"][lost], e["start"][lost], e["count"][lost]
                yield from _spans_by_group(found, groups)
                e, low, name = e[~lost], low[~lost], name[~lost]
            order = np.argsort(name, kind="stable")
            e, low, name = e[order], low[order], name[order]
            size = e["count"].astype(np.int64) + length - 1
            text = gathered(data, low, size)
            cut = np.searchsorted(name >> np.uint64(64 - few), np.arange((1 << few) + 1, dtype=np.uint64))
            bytes_at = np.r_[0, np.cumsum(size)][cut]
            used = np.flatnonzero(np.diff(cut))
            columns = [np.ascontiguousarray(e[f]) for f in ENTRY.names]
            pack = lambda i: b"".join(c[cut[i] : cut[i + 1]].tobytes() for c in columns)  # noqa: B023, E731
            text_ = pa.array([squeeze.compress(text[bytes_at[i] : bytes_at[i + 1]].tobytes()) for i in used], pa.binary())
            yield pa.record_batch([used, np.zeros(len(used), np.int32), pa.array([squeeze.compress(pack(i)) for i in used], pa.binary()), text_], NAMES)

    return send


def _buckets(packed: dict[int, list[tuple[bytes, bytes]]], length: int):
    """A bucket at a time; the others wait compressed."""
    expand = zstandard.ZstdDecompressor()
    while packed:
        _, both = packed.popitem()
        yield Bucket(np.concatenate([_unpack(expand.decompress(a)) for a, _ in both]), np.concatenate([np.frombuffer(expand.decompress(b), np.uint8) for _, b in both]), length)


def _prepared(docs: DataFrame, length: int, merge: bool) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """docs (doc_id, text), those with an id squeezed, their runs dealt by bucket, and the number of groups of documents."""
    if not 16 <= length <= 200:
        raise ValueError("length must be 16 to 200")
    windows, bits, n = Windows(length, 2 * length // 5 if length >= 20 else None), bucket_bits(docs.sparkSession), shuffle_partitions(docs)
    few = max(6, bits - 3)  # buckets of runs: each batch sends one row to each
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.filter("doc_id IS NOT NULL")
    groups = document_groups(known)
    rows = squeezed(known, groups)  # dealt by group here and at the end, so that Spark moves texts once and reads them twice
    named = with_names(rows, repeated_anchors(known, windows, byte_tokens, groups), everything=False)
    return docs, rows, named.mapInArrow(_sender(windows, few, groups, merge), MOVED).repartition(n, "key"), groups


def repeat_groups(docs: DataFrame, length: int = 50) -> DataFrame:
    """(group_id, n_bytes, doc_id, row, start): the maximal repeats of ``length`` bytes (16 to 200) or more among docs (doc_id, text).

    A group is a string of n_bytes that stands at every start listed, and nowhere else, and cannot be continued at all of
    them (see above for where it ends). Strings that only one document has come only where an anchor of theirs is in others.
    """
    *_, sent, _ = _prepared(docs, length, merge=False)

    def group(batches):
        packed: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b")), strict=True):
                packed.setdefault(key, []).append((a, b))
        for bucket in _buckets(packed, length):
            for name, size, entry, start in bucket.groups():
                e = bucket.entries[entry]
                yield pa.record_batch([name.view(np.int64), size.astype(np.int32), e["doc"], e["row"].astype(np.int64), start.astype(np.int32)], ["group_id", "n_bytes", "doc_id", "row", "start"])

    return sent.mapInArrow(group, GROUPS)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per row of docs (doc_id, text): its bytes, those removed, the spans removed and the hash of what stays.

    A byte goes if a string of ``length`` bytes (16 to 200) over it also starts in a document with a smaller doc_id.
    """
    docs, rows, sent, groups = _prepared(docs, length, merge=True)

    def settle(batches):
        packed: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            inner = pa.array(batch.column("kind").to_numpy() == 0)
            for key, a, b in zip(*(batch.column(c).filter(inner).to_pylist() for c in ("key", "a", "b")), strict=True):
                packed.setdefault(key, []).append((a, b))
            yield batch.filter(pc.invert(inner))
        found = [bucket.lost() for bucket in _buckets(packed, length)]
        if found:
            yield from _spans_by_group(np.concatenate(found), groups)

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        found = np.concatenate([np.zeros(0, FOUND), *(_unpack_found(expand.decompress(a)) for a in told.column("a").to_pylist())])
        found = found[np.lexsort((found["row"], found["doc"]))]
        head = runs_of(found["doc"], found["row"])
        of = {(int(d), int(r)): (a, b) for d, r, a, b in zip(found["doc"][head], found["row"][head], head.tolist(), [*head.tolist(), len(found)][1:], strict=True)}
        out = []
        for batch in expanded(texts.to_batches()):
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                own = found["span"][slice(*of.get((doc, row), (0, 0)))]
                out.append((doc, *cut_out(text, own["start"], own["count"].astype(np.int64) + length - 1)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    spans = sent.mapInArrow(settle, MOVED).selectExpr("key AS group", "a")
    found = rows.groupBy("group").cogroup(spans.groupBy("group")).applyInArrow(finish, RESULT)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    unknown = docs.filter("doc_id IS NULL").select(
        "doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.array().cast("array<struct<start: int, end: int>>").alias("spans")
    )
    return found.unionByName(unknown)


def _unpack(data: bytes) -> np.ndarray:
    """ENTRY rows from their columns, one after the other."""
    out = np.zeros(len(data) // ENTRY.itemsize, ENTRY)
    at = 0
    for f in ENTRY.names:
        out[f] = np.frombuffer(data, ENTRY[f], len(out), at)
        at += len(out) * ENTRY[f].itemsize
    return out


def _spans_by_group(found: np.ndarray, groups: int):
    """Rows of kind 1: FOUND rows packed by groups of documents, under whose key they travel."""
    if not len(found):
        return
    squeeze = zstandard.ZstdCompressor(level=1)
    group = group_of(found["doc"], groups)
    order = np.lexsort((found["doc"], group))
    found, group = found[order], group[order]
    head = runs_of(group)
    packed = [squeeze.compress(b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in (found["doc"], found["row"], found["span"]["start"], found["span"]["count"]))) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(found)], strict=True)]
    none = pa.array([None] * len(head), pa.binary())
    yield pa.record_batch([group[head], np.ones(len(head), np.int32), pa.array(packed, pa.binary()), none], NAMES)


def _unpack_found(data: bytes) -> np.ndarray:
    n = len(data) // FOUND.itemsize
    out = np.zeros(n, FOUND)
    out["doc"], out["row"] = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<u4", n, 8 * n)
    out["span"]["start"], out["span"]["count"] = np.frombuffer(data, "<i4", n, 12 * n), np.frombuffer(data, "<i4", n, 16 * n)
    return out


def cut_out(text: bytes, starts: np.ndarray, lens: np.ndarray):
    """Bytes, removed bytes, removed runs, hash of the rest, and the runs."""
    if not len(starts):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), []
    gone = covered(starts, lens, len(text))
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
