"""Licence scans by a positional index of rare template words.

Method: the words of licence templates are indexed with their places. A first pass counts in how many documents each
of these words stands (a table no larger than the templates' vocabulary); the second looks up every place of each
template's own highest-IDF words, turns it into the place where that template would begin, and keeps beginnings on
which several different rare words agree, shifted against each other by ``drift`` words at most: so words may have been put in, left out or
changed. A template has so many words looked up that enough agree wherever as much of it stands as a match needs: this
misses no match whose words are shifted no further, however many templates or stray words a document has. Around such a beginning
the longest run of template words in their order is found (others may stand between); it is a match if it holds a
share ``cover`` of the template and every key phrase of the template: all its words in order, with at most ``slack`` words more, and for phrases of ``LONG`` words or more
but for one word. Of matches that lie on each other by more than half, as those of licences that differ in a word or two do, the best stays: the one
with more of its words, then the greater share of them. An SPDX identifier names its licence itself. Exact phrases give base labels wherever they stand.

Defined cases: letters A-Z are lower-cased; a null text is empty: no words, no labels, score 0; the base labels
stay whatever the method finds; of words of one IDF the one that comes first in the alphabet is the rarer; a template
cut off by an end of the text matches by what is there; a text of any length is read whole; repeated rows each give a
row; an empty table gives an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.batches import LOWER, find_words, hash_words, slices, utf8

#: Bytes of words: digits, letters, and all of other characters.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x61:0x7B] = TERM[0x80:] = True

# Phrases that must give their label wherever they stand.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The opening or best known sentences of public licences, and for each the phrases that must stand in any match.
# A label's further templates have names of the form label#name.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("licensed under the apache license", "except in compliance with the license"),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "bsd-2": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is",
        ("provided with the distribution this software is provided by",),
    ),
    "bsd-3": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software",),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("gnu general public license",),
    ),
    "gpl-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        ("gnu general public license", "version 2 of the license"),
    ),
    "gpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        ("gnu general public license", "version 3 of the license"),
    ),
    "gpl-2#head": ("gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", ("gnu general public license version 2",)),
    "gpl-3#head": ("gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu general public license version 3",)),
    "lgpl-3#head": ("gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu lesser general public license version 3",)),
    "agpl-3#head": ("gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", ("gnu affero general public license version 3",)),
    "apache-2#head": ("apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license version 2 0",)),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license",),
    ),
    "epl-2": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
        ("eclipse public license",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software",),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ("in no event will the authors be held liable",),
    ),
    "bsl-1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        ("any person or organization obtaining a copy",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    "cc0": (
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",
        ("creative commons attribution 4 0",),
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit",
        ("creative commons attribution sharealike",),
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit",
        ("creative commons attribution noncommercial",),
    ),
}

# What stands after "SPDX-License-Identifier:", in words.
SPDX = {
    "mit": "mit", "apache 2 0": "apache-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2",
    "epl 2 0": "epl-2", "isc": "isc", "zlib": "zlib", "bsl 1 0": "bsl-1", "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
}
IDENTIFIER = "spdx license identifier"

#: Words of a key phrase from which on one may be missing, and windows worked on together.
LONG, STEP = 6, 2048
#: Codes of places outside a row or a match; no word has it.
NOTHING = -2
COUNTS = "code int, n long"
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int, score: double>>"


class LicenseIndex:
    """Words, postings and phrases of the templates as codes. Code -1 is any other word."""

    def __init__(self, templates: dict, phrases: dict):
        self.templates = {k: (t.split(), [p.split() for p in keys]) for k, (t, keys) in templates.items()}
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.named = [(f"{IDENTIFIER} {x}".split(), label) for x, label in SPDX.items()]
        words = {w for t, keys in self.templates.values() for w in [*t, *(x for p in keys for x in p)]} | {w for p, _ in [*self.phrases, *self.named] for w in p}
        self.words = sorted(words)
        self.code = {w: i for i, w in enumerate(self.words)}
        raw = "".join(self.words).encode()
        ends = np.cumsum([len(w.encode()) for w in self.words])
        hashes = hash_words(np.frombuffer(raw, np.uint8), np.r_[0, ends[:-1]], ends)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], order
        self.names = [k.partition("#")[0] for k in self.templates]
        self.bodies = [np.array([self.code[w] for w in t]) for t, _ in self.templates.values()]
        self.keys = [[np.array([self.code[w] for w in p]) for p in keys] for _, keys in self.templates.values()]
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, body in enumerate(self.bodies):
            for at, code in enumerate(body.tolist()):
                postings.setdefault(code, []).append((t, at))
        flat = [(c, t, at) for c in range(len(self.words)) for t, at in postings.get(c, [])]
        self.posting = np.array(flat, np.int64).reshape(-1, 3)

    def looked_up(self, idf: np.ndarray, rarest: int, agree: int, cover: float) -> tuple[np.ndarray, list[int]]:
        """Postings of each template's rarest words, and how many different ones agree on the beginning of any match.

        A match may lack n words. With more than n places beyond those of the agree - 1 words that have most, agree
        different words are left.
        """
        chosen, needed = set(), []
        for t, body in enumerate(self.bodies):
            code, times = np.unique(body, return_counts=True)
            order = np.lexsort((code, -idf[code]))
            lacks = len(body) - max(math.ceil(cover * len(body) - 1e-9), 1)
            sure = lambda m, a, times=times, order=order, lacks=lacks: times[order[:m]].sum() - np.sort(times[order[:m]])[::-1][: a - 1].sum() > lacks
            need = max((a for a in range(1, min(agree, len(code)) + 1) if sure(len(code), a)), default=1)
            most = next((m for m in range(min(rarest, len(code)), len(code)) if sure(m, need)), len(code))
            chosen |= {(int(c), t) for c in code[order[:most]]}
            needed.append(need)
        return self.posting[[(c, t) in chosen for c, t, _ in self.posting.tolist()]], needed

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of all rows, and the rows' bounds."""
        data, offs = utf8(column)
        data = LOWER[data]
        starts, ends, bounds = find_words(data, offs, TERM)
        h = hash_words(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.of_hash[at], -1), bounds


def stands(codes: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where a phrase's words stand one after the other in one row."""
    n = len(phrase)
    at = np.flatnonzero(codes[: max(len(codes) - n + 1, 0)] == phrase[0])
    for j in range(1, n):
        at = at[codes[at + j] == phrase[j]]
    return at[row[at] == row[at + n - 1]]


def scan_licenses(docs: DataFrame, templates: dict = TEMPLATES, phrases: dict = PHRASES, rarest: int = 8, agree: int = 3, cover: float = 0.6, drift: int = 8, slack: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): words, base phrases and their places, base labels, all labels, a score and the matched spans.

    rarest: how many of a template's words, by IDF, are looked up at least; agree: how many different ones must agree on
    a beginning (fewer in a template too short to promise as many); cover: the share of a template's words that must stand
    in their order; drift: how many words its words may be shifted against each other; slack: how many words may stand between those
    of a key phrase. score: 1 with a base phrase or an SPDX identifier, else the best cover of a match.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = LicenseIndex(templates, phrases)

    def count(batches):
        total = np.zeros(len(index.words), np.int64)
        for batch in slices(batches):
            codes, bounds = index.read(batch.column("text"))
            at = np.flatnonzero(codes >= 0)
            row = np.searchsorted(bounds, at, side="right") - 1
            pairs = np.unique(row * len(index.words) + codes[at])
            total += np.bincount(pairs % len(index.words), minlength=len(index.words))
        yield pa.record_batch([np.arange(len(total), dtype=np.int32), total], ["code", "n"])

    found = {r["code"]: r["n"] for r in docs.select("text").mapInArrow(count, COUNTS).groupBy("code").agg(F.sum("n").alias("n")).collect()}
    n_docs = docs.count()
    idf = np.array([math.log((1 + n_docs) / (1 + found.get(c, 0))) for c in range(len(index.words))])

    looked_up, needed = index.looked_up(idf, rarest, agree, cover)

    def scan(batches):
        for batch in slices(batches):
            codes, bounds = index.read(batch.column("text"))
            n = batch.num_rows
            hot = np.flatnonzero(codes >= 0)
            row = np.repeat(np.arange(n), np.diff(bounds))
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set] = [set() for _ in range(n)]
            for words, label in index.phrases:
                at = stands(codes, row, np.array([index.code[w] for w in words]))
                np.add.at(n_base, row[at], 1)
                np.minimum.at(first, row[at], at - bounds[row[at]])
                np.maximum.at(last, row[at], at - bounds[row[at]])
                for r in np.unique(row[at]).tolist():
                    base[r].add(label)
            spans = _matches(index, looked_up, needed, codes, bounds, row, hot, cover, n, drift, slack)
            for words, label in index.named:
                for at in stands(codes, row, np.array([index.code[w] for w in words])).tolist():
                    r, b = int(row[at]), at - int(bounds[row[at]])
                    spans[r].append({"label": label, "start": b, "end": b + len(words), "score": 1.0})
            labels = [base[r] | {s["label"] for s in spans[r]} for r in range(n)]
            score = [1.0 if base[r] else max((s["score"] for s in spans[r]), default=0.0) for r in range(n)]
            none = pa.array(n_base == 0)
            text = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            place = lambda x: pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(x, pa.int64()))
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.record_batch(
                [batch.column("doc_id"), np.diff(bounds), n_base, place(first), place(last), text(base), text(labels), pa.array(score, pa.float64()), pa.array(spans, kind)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.mapInArrow(scan, RESULT)


def in_order(windows: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each window and end in it the length of the longest run of the body's words in their order (others between them) up to there."""
    best = np.zeros((len(windows), windows.shape[1] + 1), np.int32)
    for word in body:
        best[:, 1:] = np.maximum(best[:, 1:], best[:, :-1] + (windows == word))
        np.maximum.accumulate(best, axis=1, out=best)
    return best[:, 1:]


def holds(windows: np.ndarray, phrase: np.ndarray, slack: int) -> np.ndarray:
    """Which windows have all of a phrase's words in order, with at most ``slack`` others among them."""
    place = np.arange(windows.shape[1])
    since = np.where(windows == phrase[0], place, -1)  # where the latest run of the words so far, ending at each place, began
    for word in phrase[1:]:
        before = np.maximum.accumulate(since, axis=1)
        since = np.full_like(since, -1)
        since[:, 1:] = np.where(windows[:, 1:] == word, before[:, :-1], -1)
    return ((since >= 0) & (place - since < len(phrase) + slack)).any(axis=1)


def holds_nearly(windows: np.ndarray, phrase: np.ndarray, slack: int) -> np.ndarray:
    """holds(), or, of a long phrase, all words but one."""
    found = holds(windows, phrase, slack)
    if len(phrase) >= LONG:
        for j in range(len(phrase)):
            found |= holds(windows, np.delete(phrase, j), slack)
    return found


def _matches(index: LicenseIndex, posting: np.ndarray, needed: list[int], codes, bounds, row, hot, cover: float, n: int, drift: int, slack: int) -> list[list[dict]]:
    """Each row's template matches."""
    out: list[list[dict]] = [[] for _ in range(n)]
    posting_at = np.searchsorted(posting[:, 0], np.arange(len(index.words) + 1))
    per = np.diff(posting_at)[codes[hot]]
    at, per = hot[per > 0], per[per > 0]
    if not len(at):
        return out
    # Postings as (template, row, beginning, word), each once; then, from each, how many different words agree within the drift.
    which = np.repeat(posting_at[codes[at]], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    votes = np.c_[posting[which, 1], np.repeat(row[at], per), np.repeat(at, per) - posting[which, 2], np.repeat(codes[at], per)]
    votes = votes[np.lexsort(votes.T[::-1])]
    votes = votes[np.r_[True, (votes[1:] != votes[:-1]).any(axis=1)]]
    longest = max(map(len, index.bodies))
    line = (votes[:, 0] * n + votes[:, 1]) * (len(codes) + 4 * (longest + drift)) + votes[:, 2] + longest
    to = np.searchsorted(line, line + drift, side="right")
    need = np.array(needed)[votes[:, 0]]
    found = np.flatnonzero(to - np.arange(len(votes)) >= need)
    found = found[np.r_[True, line[found[1:]] != line[found[:-1]]]] if len(found) else found
    found = np.array([i for i in found.tolist() if len(set(votes[i : to[i], 3].tolist())) >= need[i]], np.int64)
    matches = []
    for t in np.unique(votes[found, 0]).tolist():
        mine, body = found[votes[found, 0] == t], index.bodies[t]
        width = len(body) + 2 * drift
        for a in range(0, len(mine), STEP):
            r, b = votes[mine[a : a + STEP], 1], votes[mine[a : a + STEP], 2] - drift
            places = b[:, None] + np.arange(width)
            inside = (places >= bounds[r][:, None]) & (places < bounds[r + 1][:, None])
            windows = np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], NOTHING)
            best = in_order(windows, body)
            good = np.flatnonzero(best[:, -1] >= cover * len(body) - 1e-9)
            if not len(good):
                continue
            windows, best, r, b = windows[good], best[good], r[good], b[good]
            score, end = best[:, -1] / len(body), np.argmax(best == best[:, -1:], axis=1) + 1
            windows[np.arange(width) >= end[:, None]] = NOTHING
            back = in_order(windows[:, ::-1], body[::-1])
            start = width - 1 - np.argmax(back == back[:, -1:], axis=1)
            windows[np.arange(width) < start[:, None]] = NOTHING
            keys = np.logical_and.reduce([holds_nearly(windows, k, slack) for k in index.keys[t]]) if index.keys[t] else np.ones(len(good), bool)
            span = np.unique(np.c_[r, start + b - bounds[r], end + b - bounds[r], best[:, -1]][keys], axis=0)
            matches += [(row_, -count, -count / len(body), lo, hi, t) for row_, lo, hi, count in span.tolist()]
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by row and stretch of places, what has been kept
    stretch = longest + 2 * drift
    for r, _, score, lo, hi, t in sorted(matches):
        near = [x for k in range(lo // stretch - 1, hi // stretch + 1) for x in taken.get((r, k), ())]
        if all(2 * (min(hi, y) - max(lo, x)) <= min(hi - lo, y - x) for x, y in near):
            taken.setdefault((r, lo // stretch), []).append((lo, hi))
            out[r].append({"label": index.names[t], "start": lo, "end": hi, "score": -score})
    return out
