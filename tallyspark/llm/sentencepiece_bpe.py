"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

Method: an Aho-Corasick automaton over the vocabulary gives, at each place of a chunk, the longest piece that
starts there. The encoder goes left to right with the longest piece that is *compatible* with the piece before:
the two, merged again from their characters, must come out as just these two. Where no piece fits it steps back
to the next shorter one; a bitfield marks places from which the rest has failed, so that no place is tried twice.
A sequence whose neighbours are all compatible is the one that BPE's merges give.

Texts are cut where a run of spaces starts, which no piece of the vocabulary crosses (checked when it is
loaded), and each different chunk is encoded once per batch and remembered by the worker. Characters that no
piece has become their UTF-8 bytes' pieces.

Defined cases: a null text is empty and has begin and end only; the vocabulary file's path is a parameter;
a text of any length is encoded whole, and a run without spaces is one chunk, whose work grows with its length;
repeated rows each give a row; an empty table gives an empty result; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import ranges, slices, utf8

SPACE = "▁"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
#: Chunks that a worker remembers between batches, the first it meets; others are encoded again. Results do not depend on it.
REMEMBERED = 400_000


class BpeModel:
    """The pieces and ranks of a BPE vocabulary with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bos, self.eos, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and not model.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character")
        # Merges go by score, and of equal scores the leftmost first; so a rank is a score, the better the lower.
        scores = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        level = {s: r for r, s in enumerate(scores)}
        self.rank = {p: level[model.get_score(i)] for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        self.longest_piece = max(map(len, self.ids))
        for p in self.ids:
            self.automaton.add_word(p[::-1], len(p))
        self.automaton.make_automaton()
        self.shorter = {p: next((len(p) - j for j in range(1, len(p)) if p[:-j] in self.ids), 0) for p in self.ids}
        self.fits = functools.lru_cache(1 << 18)(self._fits)
        as_bytes = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.text = np.array([len(b) for b in as_bytes], np.int64)
        self.text_at = np.cumsum(self.text) - self.text
        self.text_data = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.is_byte = np.zeros(n, bool)
        self.byte_of = np.zeros(n, np.uint8)
        for b, i in self.byte_ids.items():
            self.is_byte[i], self.byte_of[i] = True, b
        self.known = {}

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-ranked pair of neighbours, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk of escaped text: spaces, then other characters."""
        out, at = [], 0
        for i, c in enumerate(chunk):  # characters without a piece never merge: they part the chunk
            if c not in self.ids:
                out += self._encode_known(chunk[at:i]) + [self.byte_ids[b] for b in c.encode()]
                at = i + 1
        return out + self._encode_known(chunk[at:])

    def _longest(self, chunk: str) -> list[int]:
        """Of each place, the length of the longest piece from there: the reversed chunk is read by reversed pieces."""
        n = len(chunk)
        out = [1] * n
        for end, length in self.automaton.iter(chunk[::-1]):
            start = n - 1 - end
            if length > out[start]:
                out[start] = length
        return out

    def _encode_known(self, chunk: str) -> list[int]:
        if not chunk:
            return []
        n, longest, ids = len(chunk), self._longest(chunk), self.ids
        failed = bytearray(len(chunk) // 8 + 1)  # bit i: no way from place i, with any piece before that was compatible
        path: list[str] = []
        at, length = 0, longest[0]
        while at < n:
            piece = chunk[at : at + length]
            to = at + length
            if not failed[to >> 3] >> (to & 7) & 1 and self.fits(path[-1] if path else "", piece):
                path.append(piece)
                at = to
                length = longest[at] if at < n else 0
                continue
            length = self.shorter[piece]
            while not length:  # nothing shorter: this place has failed, so the piece before goes back too
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    raise ValueError(f"no encoding of {chunk!r}")
                piece = path.pop()
                at -= len(piece)
                length = self.shorter[piece]
        return [ids[p] for p in path]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text: a space that begins it is the one that encoding put there; bytes that are no UTF-8 become U+FFFD."""
        bare = (self.is_byte[ids] | (ids == self.unknown)).any()
        if not bare:
            size = self.text[ids]
            out = self.text_data[ranges(self.text_at[ids], size)].tobytes()
        else:
            out = self._decode_bytes(ids)
        return out[1:] if out[:1] == b" " and self._starts_with_space(ids) else out

    def _starts_with_space(self, ids: np.ndarray) -> bool:
        real = ids[(ids != self.bos) & (ids != self.eos)]
        return bool(len(real)) and self.pieces[int(real[0])].startswith(SPACE)

    def _decode_bytes(self, ids: np.ndarray) -> bytes:
        byte = self.is_byte[ids]
        edge = np.flatnonzero(np.diff(np.r_[False, byte, False].astype(np.int8)))
        out, at = [], 0
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            out += [self._plain(ids[at:a]), _utf8_or_marks(self.byte_of[ids[a:b]].tobytes())]
            at = b
        return b"".join([*out, self._plain(ids[at:])])

    def _plain(self, ids: np.ndarray) -> bytes:
        if (ids == self.unknown).any():
            return b"".join(" ⁇ ".encode() if i == self.unknown else self._plain(np.array([i])) for i in ids)
        return self.text_data[ranges(self.text_at[ids], self.text[ids])].tobytes()


def _utf8_or_marks(data: bytes) -> bytes:
    """Valid UTF-8 as it is; each byte that belongs to none becomes U+FFFD."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode().encode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@functools.cache
def load(path: str) -> BpeModel:
    return BpeModel(path)


def chunk_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the chunks of escaped texts (each begins with a space): a space after another byte starts one."""
    blank = data == 0x20
    new = blank.copy()
    new[1:] &= ~blank[:-1]
    new[offs[offs < len(data)]] = True
    bounds = np.r_[np.flatnonzero(new), len(data)]
    return bounds, np.searchsorted(bounds, offs)


def encode_batch(model: BpeModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids with begin and end, one after the other, and the rows' bounds."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    one, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    begun = pc.if_else(pc.equal(pc.binary_length(column), 0), none, one)
    column = pc.binary_join_element_wise(begun, pc.replace_substring(column, SPACE, " "), none)
    data, offs = utf8(column)
    bounds, per_row = chunk_bounds(data, offs)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    code = coded.indices.to_numpy()
    lists, known = [], model.known
    for chunk in coded.dictionary.to_pylist():
        found = known.get(chunk)
        if found is None:
            found = np.array(model.encode_chunk(chunk.decode().replace(" ", SPACE)), np.int32).tobytes()
            if len(known) < REMEMBERED:
                known[chunk] = found
        lists.append(found)
    sizes = np.array([len(x) // 4 for x in lists], np.int64)
    flat = np.frombuffer(b"".join(lists), np.int32)
    start = np.cumsum(sizes) - sizes
    n = sizes[code]
    before = np.r_[0, np.cumsum(n)][per_row]
    ends = before + 2 * np.arange(len(before))
    out = np.empty(int(ends[-1]), np.int32)
    inner = np.ones(len(out), bool)
    inner[ends[:-1]] = inner[ends[1:] - 1] = False
    out[inner] = flat[ranges(start[code], n)]
    out[ends[:-1]], out[ends[1:] - 1] = model.bos, model.eos
    return out, ends


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): number of ids, hash of the ids as little-endian 32-bit numbers, hash of the decoded text, and the ids."""

    def encode(batches):
        model = load(path)
        for batch in slices(batches, limit=8 << 20):
            ids, bounds = encode_batch(model, batch.column("text"))
            sums, decoded = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = ids[a:b]
                sums.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(own)).hexdigest())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)) if keep_ids else pa.array([None] * batch.num_rows, pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), np.diff(bounds), pa.array(sums), pa.array(decoded), lists], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, RESULT)
