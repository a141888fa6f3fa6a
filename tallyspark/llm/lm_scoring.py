"""LM scoring by cross-entropy difference: how much better a target model predicts a document than a background model.

Method: two bigram models of one form share one vocabulary, every word of the documents and the target texts (V words):
P(w | v) = (f * c(v, w) + k * P(w)) / (f * c(v) + k), P(w) = (f * c(w) + 1) / (f * N + V). The target model counts all
target texts; the background model counts all documents but the one that it scores, whose own words and pairs are taken
off. The two are matched in size: f scales the counts of the larger of them to the words of the smaller one, which is what
a draw of that size would have on average, so that a score doesn't tell which of the two had more to learn from and no
document is left out of a draw. A document's score is its mean loss per word under the target model minus that under
the background model; the lower, the more it is like the target.

Counts grow with the corpus and are never gathered in one place: each batch of texts sends every distinct word and
pair once, with its counts there, to the bucket of its hash (63 bits), and gets back the counts over everything; the
batch's word numbers travel beside, compressed. A frequent pair is one entry a batch. Only N, V and how many texts begin
are gathered, a row of numbers for each task. A caller may ask for the ``words`` most frequent words of the documents as
vocabulary, all others being one unknown word; only then does a table of that size go to every task.

Defined cases: A-Z are lower-cased; a null or empty text has no words, loss 0 and score 0; without target texts the
target model is uniform, and where no other document has words the background is; nothing is scaled then; rows that share a doc_id count and score each, and only the row itself is taken off; of words of one count at the cut of a vocabulary
the smaller hash stays; a text of any length is read whole; an empty table gives an empty result; only doc_id and text of documents and text of targets are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import BASE64, LOWER, binaries, find_words, hash_words, mix64, runs, slices, utf8
from tallyspark.llm.shared import written
from tallyspark.llm.winnow import bucket_bits, shuffle_partitions

MOVED = "key long, kind int, tag long, part long, a binary, b binary"
NAMES = ["key", "kind", "tag", "part", "a", "b"]
#: Kinds of rows besides a batch's counts of documents (0) and targets (1): its texts as word numbers, how many of them begin, a task's totals.
TEXTS, BEGUN, TOTALS = 2, 3, 4
#: Keys of words are odd, those of pairs even.
WORD = np.uint64(1)
BEGIN, UNKNOWN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
RESULT = "doc_id long, n_words long, loss_target double, loss_background double, score double"


def read_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offs = utf8(batch.column("text"))
    data = LOWER[data]
    starts, ends, bounds = find_words(data, offs)
    return hash_words(data, starts, ends), bounds


def vocabulary(docs: DataFrame, words: int) -> np.ndarray:
    """docs (text): sorted hashes of the most frequent words. Ties go to the smaller hash, as a signed number."""
    bits, n = bucket_bits(docs.sparkSession), shuffle_partitions(docs)

    def send(batches):
        for batch in slices(batches):
            word, counts = np.unique(read_words(batch)[0], return_counts=True)
            cut = np.searchsorted(word >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = pa.record_batch([np.arange(1 << bits), binaries(word, cut), binaries(counts, cut)], ["key", "a", "b"])
            yield rows.filter(pa.array(np.diff(cut) > 0))

    def settle(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for key, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts.setdefault(key, []).append((a, b))
        found, sums = [], []
        for both in parts.values():
            one, of = np.unique(np.concatenate([np.frombuffer(a, np.uint64) for a, _ in both]), return_inverse=True)
            found.append(one)
            sums.append(np.bincount(of, np.concatenate([np.frombuffer(b, np.int64) for _, b in both]), len(one)).astype(np.int64))
        if not found:
            return
        word, counts = np.concatenate(found), np.concatenate(sums)
        best = np.lexsort((word.view(np.int64), -counts))[:words]  # only these can be among the most frequent of all
        yield pa.record_batch([word[best].view(np.int64), counts[best]], ["word", "n"])

    counted = docs.mapInArrow(send, "key long, a binary, b binary").repartition(n, "key").mapInArrow(settle, "word long, n long")
    top = counted.orderBy(F.desc("n"), "word").limit(words).toPandas()
    return np.sort(top["word"].to_numpy(np.int64).view(np.uint64))


def entries(ids: np.ndarray, bounds: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each (a text's first: len(word)), and the key of each pair, an even number; ids: places in word."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = len(word)
    return before, mix64(np.r_[word, BEGIN][before] * BASE64 + word[ids]) & ~WORD


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: they compress better so."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts of 8 bytes only where one needs them."""
    return planes(x.astype(np.int32) if x.max(initial=0) < 2**31 else x.astype(np.int64))


def read_counts(packed: list[bytes], sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([from_planes(x, np.int32 if len(x) == 4 * m else np.int64).astype(float) for x, m in zip(packed, sizes, strict=True)] or [np.zeros(0)])


def buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted keys begins, and the end."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def written_alone(df: DataFrame) -> DataFrame:
    """written(), and what the write shuffled is deleted as soon as it ends, so that disks don't hold it beside later shuffles."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(df)
    finally:
        conf.unset(name) if old is None else conf.set(name, old)


def within(text: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How often each entry of x stands in its own text. text: the text of each, in order."""
    order = np.lexsort((x, text))
    head = np.flatnonzero(np.r_[True, (x[order][1:] != x[order][:-1]) | (text[order][1:] != text[order][:-1])][: len(x)])
    times = np.diff(np.r_[head, len(x)])
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(times, times)
    return out


def pieces(bounds: np.ndarray, words: int = 1 << 18) -> list[tuple[int, int]]:
    """Texts cut, between two of them, about every so many words."""
    cuts = np.unique(np.r_[0, np.searchsorted(bounds, np.arange(0, bounds[-1], words)), len(bounds) - 1])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def mean_losses(ids: np.ndarray, before: np.ndarray, pair: np.ndarray, n_words: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], tokens: tuple[int, int], size: int, weight: float) -> np.ndarray:
    """Mean losses of texts under the background (row 0) and the target (row 1).

    ids, before, pair: each word, the one before and the pair, as places in counts: of background and target, those of pairs and
    those of words, the last one being how many texts begin. The texts are among those that the background counts.
    """
    text = np.repeat(np.arange(len(n_words)), n_words)
    own_pair, own_word = within(text, pair), within(text, ids)
    begins = np.r_[True, text[1:] != text[:-1]][: len(text)]
    own_before = np.where(begins, 1, np.r_[0, own_word[:-1]][: len(text)])
    rest = tokens[0] - n_words
    even = np.minimum(tokens[1], rest)
    end = np.cumsum(n_words)
    out = []
    for side, n in enumerate((rest, np.full(len(n_words), tokens[1]))):
        scale = np.where(even > 0, even / np.maximum(n, 1), 1.0)
        f, own = scale[text], 1 - side
        pairs, words = counts[side]
        single = (f * (words[ids] - own * own_word) + 1) / ((scale * n)[text] + size)
        p = (f * (pairs[pair] - own * own_pair) + weight * single) / (f * (words[before] - own * own_before) + weight)
        total = np.r_[0, np.cumsum(-np.log(p))]
        out.append((total[end] - total[end - n_words]) / np.maximum(n_words, 1))
    return np.array(out)


def score_documents(docs: DataFrame, target: DataFrame, words: int | None = None, weight: float = 20.0) -> DataFrame:
    """Per row of docs (doc_id, text): words, mean losses in nats under the models of target (text) and docs, and their difference.

    words: None, or how many of the documents' most frequent words are told apart.
    """
    if words is not None and words < 1:
        raise ValueError("words must be 1 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("is_target"))
    texts = docs.unionByName(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("is_target")))
    bits, n = bucket_bits(docs.sparkSession), shuffle_partitions(docs)
    known = vocabulary(docs.select("text"), words) if words else None
    sent = docs.sparkSession.sparkContext.broadcast(known)  # at most ``words`` rows

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for seq, batch in enumerate(slices(batches, limit=12 << 20)):
            h, bounds = read_words(batch)
            if sent.value is not None:
                h = np.where(np.isin(h, sent.value), h, UNKNOWN)
            word, ids = np.unique(h | WORD, return_inverse=True)
            del h
            is_target = batch.column("is_target").to_numpy(zero_copy_only=False)
            _, pair = entries(ids, bounds, word)
            tag = (TaskContext.get().partitionId() << 24) | seq
            per = np.diff(bounds)
            target_word = np.repeat(is_target, per)
            for side in (False, True):
                mine = target_word == side
                if not mine.any():
                    continue
                times = np.bincount(ids[mine], minlength=len(word))
                own = np.sort(pair[mine])
                first = runs(own)
                one = np.r_[own[first], word[times > 0]]
                count = np.r_[np.diff(np.r_[first, len(own)]), times[times > 0]].astype(np.int32)
                order = np.argsort(one)
                one, count = one[order], count[order]
                cut = buckets(one, bits)
                step = np.diff(one, prepend=np.uint64(0))
                used = np.flatnonzero(np.diff(cut))
                step[cut[used]] = one[cut[used]]
                pack = lambda x, i, cut=cut: squeeze.compress(planes(x[cut[i] : cut[i + 1]]))
                yield pa.record_batch(
                    [used, np.full(len(used), int(side), np.int32), np.full(len(used), tag), used, pa.array([pack(step, i) for i in used], pa.binary()), pa.array([pack(count, i) for i in used], pa.binary())], NAMES
                )
            none = pa.array([b""], pa.binary())
            begun = [int(((per > 0) & (is_target == side)).sum()) for side in (False, True)]
            yield pa.record_batch([np.array([tag]), np.array([BEGUN], np.int32), np.array(begun[:1]), np.array(begun[1:]), none, none], NAMES)
            rows = np.flatnonzero(~is_target)
            if len(rows):
                own = ids[~target_word]
                used = np.flatnonzero(np.bincount(own, minlength=len(word)))
                own = np.searchsorted(used, own).astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                head = np.c_[pc.fill_null(batch.column("doc_id"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[rows], per[rows]]
                yield pa.record_batch(
                    [np.array([tag]), np.array([TEXTS], np.int32), np.array([tag]), np.array([1 << bits]), pa.array([squeeze.compress(planes(own))], pa.binary()), pa.array([squeeze.compress(planes(np.r_[len(used), head.ravel(), np.diff(word[used], prepend=np.uint64(0)).view(np.int64)]))], pa.binary())], NAMES
                )

    def settle(batches):
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        parts: dict[int, list] = {}
        for batch in batches:
            for kind, tag, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "tag", "part", "a", "b")), strict=True):
                if kind < 2:
                    parts.setdefault(part, []).append((kind, tag, a, b))
            yield batch.filter(pa.array(batch.column("kind").to_numpy() >= 2))
        distinct, tokens = 0, [0, 0]
        while parts:
            part, asked = parts.popitem()
            keys = [np.cumsum(from_planes(expand.decompress(a), np.uint64)) for _, _, a, _ in asked]
            one, of = np.unique(np.concatenate(keys), return_inverse=True)
            all_n = np.concatenate([from_planes(expand.decompress(b), np.int32) for *_, b in asked])
            side = np.repeat([kind for kind, *_ in asked], [len(k) for k in keys])
            totals = [np.bincount(of, np.where(side == s, all_n, 0), len(one)).astype(np.int64) for s in (0, 1)]
            single = (one & WORD) > 0
            distinct += int(single.sum())
            tokens = [tokens[s] + int(totals[s][single].sum()) for s in (0, 1)]
            out, at = [], 0
            for (kind, tag, _, _), k in zip(asked, keys, strict=True):
                if not kind:
                    mine = of[at : at + len(k)]
                    out.append((tag, *(squeeze.compress(pack_counts(totals[s][mine])) for s in (0, 1))))
                at += len(k)
            if out:
                tags, a, b = zip(*out, strict=True)
                m = len(tags)
                yield pa.record_batch([np.array(tags), np.zeros(m, np.int32), np.array(tags), np.full(m, part), pa.array(a, pa.binary()), pa.array(b, pa.binary())], NAMES)
        none = pa.array([b""], pa.binary())
        yield pa.record_batch([np.array([distinct]), np.array([TOTALS], np.int32), np.array(tokens[:1]), np.array(tokens[1:]), none, none], NAMES)

    moved = written_alone(texts.mapInArrow(send, MOVED).repartition(n, "key").mapInArrow(settle, MOVED))
    told = {r["kind"]: r for r in moved.filter(F.col("kind").isin(BEGUN, TOTALS)).groupBy("kind").agg(F.sum("key").alias("key"), F.sum("tag").alias("tag"), F.sum("part").alias("part")).collect()}
    begins = (told[BEGUN]["tag"], told[BEGUN]["part"]) if BEGUN in told else (0, 0)
    tokens = (told[TOTALS]["tag"], told[TOTALS]["part"]) if TOTALS in told else (0, 0)
    size = len(known) + 1 if known is not None else told[TOTALS]["key"] if TOTALS in told else 0

    def finish(batches):
        """Sorted by batch: its buckets' answers in order, then its word numbers."""
        expand = zstandard.ZstdDecompressor()
        answers: list[tuple[int, bytes, bytes]] = []
        tag_ = None
        for batch in batches:
            for kind, tag, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "tag", "part", "a", "b")), strict=True):
                if tag != tag_:
                    tag_, answers = tag, []
                if kind != TEXTS:
                    answers.append((part, a, b))
                    continue
                head = from_planes(expand.decompress(b), np.int64)
                m = int(head[0])
                word = np.cumsum(head[len(head) - m :].view(np.uint64))
                ids = from_planes(expand.decompress(a), np.uint16 if m < 1 << 16 else np.uint32).astype(np.int64)
                doc, n_words = head[1 : len(head) - m].reshape(-1, 2).T
                bounds = np.r_[0, np.cumsum(n_words)]
                before, pair = entries(ids, bounds, word)
                pairs, of = np.unique(pair, return_inverse=True)
                del pair
                one = np.sort(np.r_[pairs, word])
                pair_at, word_at = np.searchsorted(one, pairs), np.searchsorted(one, word)
                sizes = np.diff(buckets(one, bits))[[x for x, *_ in answers]] if answers else []
                counts = [read_counts([expand.decompress(x[1 + s]) for x in answers], sizes) for s in (0, 1)]
                told_ = [(count[pair_at], np.r_[count[word_at], float(begins[s])]) for s, count in enumerate(counts)]
                losses = np.zeros((2, len(doc)))
                for lo, hi in pieces(bounds):
                    mine = slice(bounds[lo], bounds[hi])
                    losses[:, lo:hi] = mean_losses(ids[mine], before[mine], of[mine], n_words[lo:hi], told_, tokens, size, weight)
                ids_ = pa.array(doc, pa.int64(), mask=doc == np.iinfo(np.int64).min)
                yield pa.record_batch([ids_, n_words, losses[1], losses[0], losses[1] - losses[0]], ["doc_id", "n_words", "loss_target", "loss_background", "score"])

    return moved.filter(F.col("kind") <= TEXTS).repartition(n, "tag").sortWithinPartitions("tag", "kind", "part").mapInArrow(finish, RESULT)
