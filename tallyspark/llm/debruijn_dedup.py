"""Substring dedup over words: a compacted de Bruijn graph of repeated word windows.

Method: a window of ``length`` words is an edge from its first ``length - 1`` words to its last. Consecutive
windows that share a minimizer (see ``winnow``) form a run, whose windows Spark joins look at one by one only
where an anchor has several different runs; elsewhere the run is one edge already. Every repeated edge (in two
documents or more) has source coordinates: the smallest document and place that has it. Edges then compact: an edge
goes on into the next if the node between has one edge in and one out and the source goes on there too; joins that
double their reach each round find the head of every such nonbranching path, the unitig, which is a stretch of its
source. Documents are read off the unitigs: consecutive edges of a document on one unitig are one span, whose words
go if the unitig's source is a smaller document. Every span is verified: the words of the document and those at the
source's coordinates must have one BLAKE2 digest (16 bytes; within a batch bytes are compared); a clash of hashes
that made two different spans one edge stops the run.

Defined cases: a null text has no words; windows never cross documents; rows that share a doc_id count as one
document and each gives a row (rows are told apart by 64 bits of a hash of the text); rows with a null doc_id lose
nothing and take nothing from others; where a document has a span several times, the first place is the source; a
text of any length is one row of its document and is worked on whole; an empty table gives an empty result; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import WORD, binaries, covered, expanded, find_words, hash_words, mix64, ranges, slices, squeezed, utf8
from tallyspark.llm.shared import Scratch, forget, written
from tallyspark.llm.winnow import Windows, document_groups, gram_hash, is_repeated, repeated_anchors, short_name, with_names

LOST = np.dtype([("start", "<i4"), ("count", "<i4")])
DOCS = "doc_id long, row long, n_words long, kept_sha256 string, text binary, lost binary, runs array<struct<starts: array<int>, count: int, docs: long, name: long, s1: long, s2: long, nodes: array<long>>>"
FOUND = "doc_id long, row long, found array<struct<start: int, windows: int, doc: long, row: long, source: int>>"
CLAIM = pa.struct([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])
RESULT = (
    "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept_text string, "
    "claims array<struct<doc: long, row: long, start: int, n: int, digest: binary>>, answers array<struct<doc: long, row: long, start: int, n: int, digest: binary>>"
)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' words, each with one space after it, as bytes; where each word begins there, and the end; the rows' bounds in words."""
    data, offs = utf8(pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_binary()), b""), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary())))
    inside = WORD[data]
    end = ~inside
    end[1:] &= inside[:-1]
    end[:1] = False
    bounds = np.searchsorted(np.flatnonzero(end), offs)
    text = data[inside | end]
    del data, inside
    blank = ~WORD[text]
    text[blank] = 0x20
    return text, np.r_[0, np.flatnonzero(blank) + 1], bounds


def word_tokens(batch: pa.RecordBatch):
    text, at, bounds = words_of(batch.column("text"))
    h = hash_words(text, at[:-1], at[1:] - 1)
    return h, (h >> np.uint64(9)).astype(np.uint32), bounds


def _sums(text: np.ndarray, at: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> list[str]:
    """The hash of each row's kept words joined by one space."""
    per = np.diff(at)
    whole = memoryview(text[np.repeat(keep, per)])
    cut = np.r_[0, np.cumsum(per[keep])][np.r_[0, np.cumsum(keep)][bounds]]
    return [hashlib.sha256(whole[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _runs_of_documents(windows: Windows):
    """Batches of (doc_id, row, text, names) to DOCS: a document without repeated anchors is finished, others carry their runs."""
    length, node = windows.length, windows.length - 1

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in expanded(batches):
            ids, row = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("row").to_numpy(zero_copy_only=False)
            text, word_at, bounds = words_of(batch.column("text"))
            x = hash_words(text, word_at[:-1], word_at[1:] - 1)
            at, rank = windows.anchors((x >> np.uint64(9)).astype(np.uint32), bounds[1:], bounds[:-1])
            of = np.searchsorted(bounds, at, side="right") - 1
            name = windows.names(x, at)
            low, high = windows.owned(at, rank, bounds[of], bounds[of + 1])
            keep = (low <= high) & is_repeated(batch.column("names"), short_name(name), of)
            of, name, low, high, lead = of[keep], name[keep], low[keep], high[keep], (at - low)[keep]
            count = high - low + 1
            per = count + 1
            cut = np.r_[0, np.cumsum(per)]
            nodes = gram_hash(x, ranges(low, per), node)
            s1 = _fold(nodes, cut, 0x9E3779B97F4A7C15, lead)
            s2 = _fold(nodes, cut, 0xD1B54A32D192ED03, lead)
            # Equal runs within the batch: the smallest document speaks for all, with their number; later ones lose the run.
            order = np.lexsort((low, of, ids[of], s2, s1))
            doc = ids[of][order]
            new = _changes(s1[order], s2[order])
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            lost = doc > doc[head][group]
            gone, kept_by = order[lost], order[head][group[lost]]
            _same_words(text, word_at, low[gone], low[kept_by], count[gone] + length - 1)
            distinct = new.copy()
            distinct[1:] |= doc[1:] != doc[:-1]
            docs = np.bincount(group[distinct], minlength=len(head))
            spans = np.zeros(len(gone), LOST)
            spans["start"], spans["count"] = (low - bounds[of])[gone], count[gone]
            by = np.argsort(of[gone], kind="stable")
            lost_cut = np.searchsorted(of[gone][by], np.arange(batch.num_rows + 1))
            # What a row tells of a run: once, with all places. The first row of a group counts the documents.
            tell, told_group = order[~lost], group[~lost]
            first = _changes(of[tell], told_group)
            entry = tell[first]
            docs = np.where(np.flatnonzero(first) == np.searchsorted(told_group, told_group)[first], docs[told_group[first]], 0) if len(tell) else docs[:0]
            starts_cut = np.r_[np.flatnonzero(first), len(tell)]
            by_row = np.argsort(of[entry], kind="stable")
            entry, docs = entry[by_row], docs[by_row]
            sizes = np.diff(starts_cut)[by_row]
            places = (low - bounds[of])[tell][ranges(starts_cut[:-1][by_row], sizes)].astype(np.int32)
            list_cut = np.searchsorted(of[entry], np.arange(batch.num_rows + 1))
            numbers = lambda v, kind: pa.array(np.ascontiguousarray(v).view(np.int64).astype(kind))
            entries = pa.StructArray.from_arrays(
                [
                    _lists(places, sizes), numbers(count[entry], np.int32), numbers(docs, np.int64), numbers(name[entry], np.int64), numbers(s1[entry], np.int64), numbers(s2[entry], np.int64),
                    _lists(nodes[ranges(cut[entry], per[entry])].view(np.int64), per[entry]),
                ],
                ["starts", "count", "docs", "name", "s1", "s2", "nodes"],
            )
            some = np.bincount(of, minlength=batch.num_rows) > 0 if len(of) else np.zeros(batch.num_rows, bool)
            texts, whole, cut_at = batch.column("text").cast(pa.binary()), memoryview(np.ascontiguousarray(text)), word_at[bounds].tolist()
            packed = [squeeze.compress(texts[i].as_py() or b"") if s else None for i, s in enumerate(some.tolist())]
            kept = [None if s else hashlib.sha256(whole[a : max(a, b - 1)]).hexdigest() for s, a, b in zip(some.tolist(), cut_at[:-1], cut_at[1:], strict=True)]
            yield pa.record_batch(
                [ids, row, np.diff(bounds), pa.array(kept, pa.string()), pa.array(packed, pa.binary()), binaries(spans[by], lost_cut), pa.ListArray.from_arrays(pa.array(list_cut.astype(np.int32)), entries)],
                ["doc_id", "row", "n_words", "kept_sha256", "text", "lost", "runs"],
            )

    return send


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _same_words(text: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray, step: int = 1 << 14) -> None:
    """Spans of so many words from a and from b must be equal byte for byte."""
    size = at[a + words] - at[a]
    fine = bool((size == at[b + words] - at[b]).all())
    for i in range(0, len(a) if fine else 0, step):
        n = size[i : i + step]
        fine &= bool((text[ranges(at[a[i : i + step]], n)] == text[ranges(at[b[i : i + step]], n)]).all())
    if not fine:
        raise ValueError("two different runs of words have the same 128 bits of hashes")


def _without(text: bytes, spans: list[dict]) -> str | None:
    """The text without some spans of its words."""
    if not spans:
        return None
    starts, _, _ = find_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    cut = [*starts.tolist(), len(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : cut[s["start"]]])
        at = cut[s["end"]]
    return b"".join([*out, text[at:]]).decode()


def _fold(nodes: np.ndarray, cut: np.ndarray, seed: int, lead: np.ndarray) -> np.ndarray:
    """A hash of each run's nodes in order, and of where its anchor stands."""
    if len(cut) == 1:
        return np.zeros(0, np.uint64)
    inner = np.arange(len(nodes)) - np.repeat(cut[:-1], np.diff(cut))
    with np.errstate(over="ignore"):
        h = mix64(nodes ^ mix64((inner.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)))
        return mix64(np.add.reduceat(h, cut[:-1]) + lead.astype(np.uint64) * np.uint64(seed))


def compact_paths(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (edge, u, v, windows, doc, row, start) to (edge, unitig): the head edge of the nonbranching path that each lies on.

    doc, row, start: where the edge's ``windows`` windows stand in its source. A path goes on where its source does, so
    that places grow along it and it cannot close. Each round every edge learns the head of the edge it points to, so
    the reach doubles.
    """
    out = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"), F.min(F.struct("doc", "row", "start")).alias("goes_on"))
    into = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"), F.min(F.struct("doc", "row", (F.col("start") + F.col("windows")).alias("start"))).alias("ends"), F.min("edge").alias("before"))
    through = out.join(into, "node").filter("n_out = 1 AND n_in = 1 AND goes_on = ends").select("node", "before")
    heads = written(edges.join(through, edges.u == through.node, "left").select("edge", F.coalesce("before", "edge").alias("head")))
    while True:
        far = heads.select(F.col("edge").alias("head"), F.col("head").alias("far"))
        open_ = heads.filter("head <> edge").join(far, "head")
        longer = written(open_.select("edge", F.col("far").alias("head"), (F.col("far") != F.col("head")).alias("moved")).unionByName(heads.filter("head = edge").select("edge", "head").withColumn("moved", F.lit(False))))
        forget(heads)
        heads = longer
        if not heads.filter("moved").head(1):
            scratch.tables.append(heads)
            return heads.select("edge", F.col("head").alias("unitig"))


def place_on_unitigs(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges, as for compact_paths, to (edge, unitig, offset, doc, row, start): the place of each on its unitig, and that of the unitig in its source."""
    placed = scratch.written(edges.select("edge", "doc", "row", "start").join(compact_paths(edges, scratch), "edge"))
    unitigs = placed.groupBy("unitig").agg(F.min(F.struct("doc", "row", "start")).alias("source"))
    found = placed.select("edge", "unitig", F.col("start").alias("own")).join(unitigs, "unitig")
    return found.select("edge", "unitig", (F.col("own") - F.col("source.start")).alias("offset"), "source.doc", "source.row", "source.start")


def repeat_graph(known: DataFrame, scratch: Scratch) -> DataFrame:
    """From DOCS rows: per run (s1, s2) its pieces on unitigs (at, windows, unitig, offset, doc, row, start)."""
    occ = known.select("doc_id", "row", F.inline("runs"))
    source = F.min(F.struct(F.col("doc_id").alias("doc"), "row", F.col("starts")[0].alias("start"))).alias("source")
    same = scratch.written(occ.groupBy("name", "s1", "s2").agg(source, F.sum("docs").alias("docs"), F.first("nodes").alias("nodes")))
    variants = same.groupBy("name").agg(F.count("*").alias("variants"))
    same = same.join(variants, "name").select("s1", "s2", "variants", "docs", "nodes", "source.*")
    alone = same.filter("variants = 1 AND docs > 1").select(
        "s1", "s2", F.xxhash64(F.lit("run"), "s1", "s2").alias("edge"), F.col("nodes")[0].alias("u"), F.element_at("nodes", -1).alias("v"), F.lit(0).alias("at"), (F.size("nodes") - 1).alias("windows"), "doc", "row", "start"
    )
    mixed = same.filter("variants > 1").select("s1", "s2", "docs", "doc", "row", "start", "nodes", F.explode(F.sequence(F.lit(0), F.size("nodes") - 2)).alias("at"))
    mixed = mixed.select("s1", "s2", "docs", "at", F.col("nodes")[F.col("at")].alias("u"), F.col("nodes")[F.col("at") + 1].alias("v"), "doc", "row", (F.col("start") + F.col("at")).alias("start"))
    window = mixed.groupBy("u", "v").agg(F.min(F.struct("doc", "row", "start")).alias("source"), F.sum("docs").alias("docs")).filter("docs > 1")
    window = scratch.written(window.select(F.xxhash64(F.lit("window"), "u", "v").alias("edge"), "u", "v", F.lit(1).alias("windows"), "source.*"))
    columns = ("edge", "u", "v", "windows", "doc", "row", "start")
    placed = place_on_unitigs(alone.select(*columns).unionByName(window.select(*columns)), scratch)
    pieces = alone.select("s1", "s2", "edge", "at", "windows").unionByName(mixed.select("s1", "s2", "at", "u", "v").join(window.select("edge", "u", "v", "windows"), ["u", "v"]).select("s1", "s2", "edge", "at", "windows"))
    piece = F.struct("at", "windows", "unitig", "offset", "doc", "row", "start")
    return pieces.join(placed, "edge").groupBy("s1", "s2").agg(F.collect_list(piece).alias("pieces"))


def _merged(batches):
    """Batches of (doc_id, row, found): a row's consecutive pieces on one unitig become one span with its place in the source."""
    for batch in batches:
        of, f = _flat(batch.column("found"))
        order = np.lexsort((f["start"], f["unitig"], of))
        of, f = of[order], {k: v[order] for k, v in f.items()}
        new = _changes(of, f["unitig"], f["start"] - f["offset"])
        if len(of):
            new[1:] |= f["start"][1:] != f["start"][:-1] + f["windows"][:-1]
        head = np.flatnonzero(new)
        windows = np.add.reduceat(f["windows"], head) if len(head) else head
        columns = [f["start"][head], windows, f["doc"][head], f["row"][head], (f["source"] + f["offset"])[head]]
        inside = pa.StructArray.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, ("i4", "i4", "i8", "i8", "i4"), strict=True)], ["start", "windows", "doc", "row", "source"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[head], np.arange(batch.num_rows + 1)).astype(np.int32)), inside)
        yield pa.record_batch([batch.column("doc_id"), batch.column("row"), lists], ["doc_id", "row", "found"])


def _claims(cut: list[int], rows: list[tuple]) -> pa.Array:
    columns = list(zip(*rows, strict=True)) or [[]] * len(CLAIM)
    inside = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CLAIM, strict=True)], CLAIM.names)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), inside)


def _finish(length: int, keep_text: bool):
    """Batches of (doc_id, row, n_words, text, lost, found, asked) to RESULT."""

    def finish(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in slices(batches, limit=4 << 20):
            m = batch.num_rows
            texts = [expand.decompress(t) for t in batch.column("text").to_pylist()]
            text, word_at, bounds = words_of(pa.array(texts, pa.binary()))
            first = bounds[:-1]
            doc, row = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            of, f = _flat(batch.column("found"))
            start, count = first[of] + f["start"], f["windows"] + length - 1
            # What a span of a document must be in its source, and what asked spans of sources are; a batch claims each thing once.
            claims = list({*zip(f["doc"].tolist(), f["row"].tolist(), f["source"].tolist(), count.tolist(), _digests(text, word_at, start, count), strict=True)})
            asked_of, asked = _flat(batch.column("asked"))
            asked_n = asked["windows"] + length - 1
            answers = [*zip(doc[asked_of].tolist(), row[asked_of].tolist(), asked["source"].tolist(), asked_n.tolist(), _digests(text, word_at, first[asked_of] + asked["source"], asked_n), strict=True)]
            own, lost_bounds = utf8(batch.column("lost"))
            own, own_of = own.view(LOST), np.repeat(np.arange(m), np.diff(lost_bounds) // LOST.itemsize)
            gone = covered(np.r_[start, first[own_of] + own["start"]], np.r_[count, own["count"] + length - 1], len(word_at) - 1)
            # Runs of removed words; a row's end ends one.
            opens, closes = gone.copy(), gone.copy()
            opens[1:] &= ~gone[:-1] | _at(bounds, len(gone))[1:]
            closes[:-1] &= ~gone[1:] | _at(bounds, len(gone))[1:]
            a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            of_span = np.searchsorted(bounds, a, side="right") - 1
            inside = pa.StructArray.from_arrays([pa.array((x - first[of_span]).astype(np.int32)) for x in (a, b)], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of_span, np.arange(m + 1)).astype(np.int32)), inside)
            kept = [_without(t, s) for t, s in zip(texts, spans.to_pylist(), strict=True)] if keep_text else [None] * m
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "row", "n_words")), np.diff(np.r_[0, np.cumsum(gone)][bounds]), pa.array(_sums(text, word_at, bounds, ~gone)), spans, pa.array(kept, pa.string()),
                    _claims([0] + [len(claims)] * m, claims), _claims(np.searchsorted(asked_of, np.arange(m + 1)).tolist(), answers),
                ],
                ["doc_id", "row", "n_words", "n_removed", "kept_sha256", "spans", "kept_text", "claims", "answers"],
            )

    return finish


def _digests(text: np.ndarray, at: np.ndarray, start: np.ndarray, words: np.ndarray) -> list[bytes]:
    """A digest of each span of words."""
    whole = memoryview(np.ascontiguousarray(text))
    return [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(at[start].tolist(), at[start + words].tolist(), strict=True)]


def _at(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[places] = True
    return out[:n]


def _flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of numbers' structs: the row of each entry, and its fields."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}


def _runs_told(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, text), and their DOCS rows, written."""
    if length < 4:
        raise ValueError("length must be 4 or more")
    windows = Windows(length)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.filter("doc_id IS NOT NULL")
    groups = document_groups(known)
    texts = squeezed(known, groups, "xxhash64(text)")
    return docs, written(with_names(texts, repeated_anchors(known, windows, word_tokens, groups), True, _runs_of_documents(windows), DOCS))


def repeated_unitigs(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, row, start, n_words): the unitigs among docs (doc_id, text), as stretches of the words of their sources.

    Every window of ``length`` words (4 or more) of a stretch stands in two documents or more, its source being the smallest
    of them; a stretch ends where its windows stop being shared, where they go on in two ways, or where their smallest
    document changes. row is the tag of the source's text.
    """
    (_, told), scratch = _runs_told(docs, length), Scratch()
    pieces = repeat_graph(told.filter("text IS NOT NULL"), scratch).select(F.inline("pieces"))
    words = (F.max(F.col("offset") + F.col("windows")) + length - 1).cast("long").alias("n_words")
    found = written(pieces.groupBy("unitig", F.col("doc").alias("doc_id"), "row", "start").agg(words).drop("unitig"))
    scratch.clear()
    forget(told)
    return found


def remove_repeated_passages(docs: DataFrame, length: int = 50, keep_text: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): a tag of the row, its words, those removed, the hash of those kept joined by a space, the
    removed spans of words, and where any is removed the text without them (what stands between words goes with the word before).

    A word goes if a window of ``length`` words (4 or more) over it also starts in a document with a smaller doc_id.
    keep_text: False leaves kept_text null.
    """
    docs, told, scratch = *_runs_told(docs, length), Scratch()
    runs = told.filter("text IS NOT NULL").select("doc_id", "row", F.inline("runs")).select("doc_id", "row", "starts", "s1", "s2")
    # Pieces of unitigs with a smaller source, at every place of their run in a document.
    lost = runs.join(repeat_graph(told.filter("text IS NOT NULL"), scratch), ["s1", "s2"]).select("doc_id", "row", "starts", F.filter("pieces", lambda p: p["doc"] < F.col("doc_id")).alias("pieces")).filter(F.size("pieces") > 0)
    lost = lost.select("doc_id", "row", F.explode("starts").alias("start"), "pieces").select(
        "doc_id", "row", F.transform("pieces", lambda p: F.struct((F.col("start") + p["at"]).alias("start"), p["windows"].alias("windows"), p["unitig"].alias("unitig"), p["offset"].alias("offset"), p["doc"].alias("doc"), p["row"].alias("row"), p["start"].alias("source"))).alias("pieces")
    )
    lost = lost.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("pieces")).alias("found")).mapInArrow(_merged, FOUND)
    lost = scratch.written(lost)
    asked = lost.select(F.inline("found")).select("doc", "row", "source", "windows").distinct().groupBy(F.col("doc").alias("doc_id"), "row").agg(F.collect_list(F.struct("source", "windows")).alias("asked"))
    some = told.filter("text IS NOT NULL").select("doc_id", "row", "n_words", "text", "lost").join(lost, ["doc_id", "row"], "left").join(asked, ["doc_id", "row"], "left")
    done = written(some.select("doc_id", "row", "n_words", "text", "lost", "found", "asked").mapInArrow(_finish(length, keep_text), RESULT))
    scratch.clear()
    key = ["doc", "row", "start", "n", "digest"]
    if done.select(F.inline("claims")).distinct().join(done.select(F.inline("answers")), key, "left_anti").head(1):
        raise ValueError("a span differs from its unitig's source: two different edges have the same 128 bits of hashes")
    none = (F.array().cast("array<struct<start: int, end: int>>").alias("spans"), F.lit(None).cast("string").alias("kept_text"))
    whole = told.filter("text IS NULL").select("doc_id", "row", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *none)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    unknown = docs.filter("doc_id IS NULL").select("doc_id", F.xxhash64("text").alias("row"), F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"), *none)
    return whole.unionByName(done.drop("claims", "answers")).unionByName(unknown)
