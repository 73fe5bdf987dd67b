"""License scans by winnowed fingerprints and banded alignment (operator 7).

Templates are short texts, so their fingerprints form an inverted index of
bounded size that every task holds. A document's words are hashed in one pass;
grams of ``GRAM`` words are winnowed (the least hash of every ``WINNOW`` grams
in a row is kept, the last one among equals), so a document and a template that
share ``GRAM + WINNOW - 1`` words share a fingerprint. Fingerprints that meet
the index on nearby diagonals (places in the document minus places in the
template) make a candidate region. Where the region has enough of the template's
words, however ordered, a banded local alignment of the region's words with the
template's reports matched words and their span.

A short template is fingerprinted by all its grams, and so are the documents for
such grams; they are short enough that one survives as many changed or missing
words as the coverage allows. A long one may lack a fingerprint where changes
leave nowhere ``GRAM + WINNOW - 1`` words in a row.

Defined results: a null or empty text has no matches; a document that holds a
template more than once reports each place; templates of any number are looked
for, in shards; of alignments with equal scores the
one nearest the fingerprint's diagonal wins; places of different templates may
overlap; rows with a null or repeated id, and repeated rows, are scanned one by
one; a very long text is scanned whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bytescan

GRAM = 4
WINNOW = 4
#: Words that an alignment may drift from the diagonal it starts on.
BAND = 8
MIN_COVERAGE = 0.8
#: Words of the templates that a task holds at a time; more templates are dealt into shards, one pass each.
SHARD_WORDS = 1_000_000

#: License notices (fixed values), in the words that documents use.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software"
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "apache-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
}

#: Letters and digits of ASCII and everything beyond it make words.
_BLANK = np.ones(256, bool)
_BLANK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = bytescan.words(raw, at, _BLANK)
    return starts, ends, bounds, bytescan.hash_spans(raw, starts, ends)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    out = words
    for k in range(1, size):
        if len(out) < 2:
            return np.zeros(0, np.uint64)
        out = bytescan.combine(out[:-1], words[k:])
    return out


def winnow(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the kept hashes: the least of each ``window`` in a row, the last among equals."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - views.argmin(1))


@dataclass
class Index:
    """(gram size, whether all grams are kept) -> (sorted hashes, template, place); and each template's words."""

    names: list[str]
    texts: list[np.ndarray]
    by_size: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]


def build_index(templates: dict[str, str], min_coverage: float = MIN_COVERAGE) -> Index:
    names, texts = [], []
    rows: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
    for name, text in sorted(templates.items()):
        raw = np.frombuffer(text.encode(), np.uint8)
        *_, words = _words(raw, np.array([0, len(raw)]))
        if not len(words):
            continue
        t = len(names)
        names.append(name), texts.append(words)
        # Only a template as long as the guarantee needs is winnowed.
        whole = len(words) < 2 * (GRAM + WINNOW)
        # So many changes leave a run of this many words unchanged.
        changes = 0
        while len(words) - changes - 1 >= max(1, min_coverage * len(words)):
            changes += 1
        size = min(GRAM, max(1, (len(words) - changes) // (changes + 1))) if whole else GRAM
        hashes = grams(words, size)
        places = np.arange(len(hashes)) if whole else winnow(hashes)
        rows.setdefault((size, whole), []).extend((int(hashes[p]), t, int(p)) for p in places)
    by_size = {}
    for key, entries in rows.items():
        entries.sort()
        by_size[key] = (
            np.array([e[0] for e in entries], np.uint64),
            np.array([e[1] for e in entries]),
            np.array([e[2] for e in entries]),
        )
    return Index(names, texts, by_size)


def align(
    doc: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND, free: np.ndarray | None = None
) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the best local alignment within ``band`` of a diagonal.

    A match scores 2; a changed, added or missing word costs 1. The score's
    matches and its first word travel along, so no path is kept. Among equals
    the alignment that ends nearest the diagonal wins. Only words that are
    ``free`` take part; an alignment does not reach over others.
    """
    width = 2 * band + 1
    score = np.zeros(width + 2, np.int64)
    matched = np.zeros(width + 2, np.int64)
    begin = np.zeros(width + 2, np.int64)
    best = (0, 0, 0, 0)
    off = band
    away = np.abs(np.arange(width) - band)
    for i in range(len(template)):
        low = i + diagonal - band
        j = low + np.arange(width)
        inside = (j >= 0) & (j < len(doc))
        if free is not None:
            inside[inside] = free[j[inside]]
        same = np.zeros(width, bool)
        same[inside] = doc[j[inside]] == template[i]
        diag = score[1:-1] + np.where(same, 2, -1)
        up = score[2:] - 1  # a template word is missing: the band moves one word on
        take = diag >= up
        new = np.where(take, diag, up)
        hits = np.where(take, matched[1:-1] + same, matched[2:])
        first = np.where(take, begin[1:-1], begin[2:])
        fresh = same & (score[1:-1] <= 0)
        new, hits, first = np.where(fresh, 2, new), np.where(fresh, 1, hits), np.where(fresh, j, first)
        new = np.where(inside & (new > 0), new, 0)
        for k in range(1, width):  # an added word in the document: along the row
            if inside[k] and new[k - 1] - 1 > new[k]:
                new[k], hits[k], first[k] = new[k - 1] - 1, hits[k - 1], first[k - 1]
        k = int(np.lexsort((away, -new))[0])
        if new[k] > best[0] or new[k] == best[0] and away[k] < off:
            best, off = (int(new[k]), int(hits[k]), int(first[k]), int(j[k]) + 1), int(away[k])
        score[1:-1], matched[1:-1], begin[1:-1] = new, hits, first
    return best[1], best[2], best[3]


def possible(words: np.ndarray, order: np.ndarray, template: np.ndarray, diagonals: np.ndarray, needed: float, band: int = BAND) -> np.ndarray:
    """Which diagonals have, within the band, enough of the template's words to match ``needed`` of them, each as often as it has them.

    An alignment matches no more than that, so the others need none. ``order``
    sorts the document's words.
    """
    low = np.maximum(diagonals - band, 0)
    high = np.minimum(diagonals + len(template) + band, len(words))
    total = np.zeros(len(diagonals), np.int64)
    for word, times in zip(*np.unique(template, return_counts=True), strict=True):
        first, last = np.searchsorted(words, word, "left", sorter=order), np.searchsorted(words, word, "right", sorter=order)
        if first < last:
            at = np.sort(order[first:last])
            total += np.minimum(np.searchsorted(at, high) - np.searchsorted(at, low), times)
    return total >= needed


def scan_words(words: np.ndarray, index: Index, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word + 1) of every accepted region of one document."""
    found: dict[int, list[tuple[int, int]]] = {}
    for (size, whole), (known, owner, place) in index.by_size.items():
        hashes = grams(words, size)
        if not len(hashes):
            continue
        kept = np.arange(len(hashes)) if whole else winnow(hashes)
        low = np.searchsorted(known, hashes[kept], "left")
        high = np.searchsorted(known, hashes[kept], "right")
        for p in np.flatnonzero(high > low):
            for e in range(low[p], high[p]):
                found.setdefault(int(owner[e]), []).append((int(kept[p]) - int(place[e]), int(kept[p])))
    order = np.argsort(words, kind="stable") if found else None
    out = []
    for t, hits in sorted(found.items()):
        template = index.texts[t]
        needed = min_coverage * len(template)
        near = np.unique(np.array(hits), axis=0)
        near = near[possible(words, order, template, near[:, 0], needed)]
        # Words of accepted places take no part in further ones, so places never overlap.
        free = np.ones(len(words), bool)
        tried = None
        for diagonal, at in near.tolist():
            # A better place nearby goes first; then the hit's own place is looked for again.
            while free[at] and diagonal != tried:
                matched, first, last = align(words, template, diagonal, free=free)
                if matched >= needed:
                    out.append((t, matched, first, last))
                    free[first:last] = False
                else:
                    tried = diagonal
    return out


def _scan(index: Index, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            rows: list[tuple] = []
            for a, b, raw, at in bytescan.slices(batch.column(1)):
                starts, ends, bounds, words = _words(raw, at)
                maybe = _with_hits(words, bounds, index)
                data = None
                for r in maybe:
                    own = slice(bounds[r], bounds[r + 1])
                    for t, matched, first, last in scan_words(words[own], index, min_coverage):
                        data = data or raw.tobytes()
                        s, e = int(starts[own][first]), int(ends[own][last - 1])
                        start = len(data[at[r] : s].decode())
                        ids.append(a + int(r))
                        rows.append((index.names[t], matched, len(index.texts[t]), start, start + len(data[s:e].decode())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids, pa.int64())),
                    pa.array(columns[0], pa.string()),
                    *[pa.array(c, pa.int64()) for c in columns[1:]],
                ],
                names=["id", "license", "matched_words", "template_words", "start", "end"],
            )

    return run


def _with_hits(words: np.ndarray, bounds: np.ndarray, index: Index) -> np.ndarray:
    """Documents of a slice with any gram in the index, from one look-up over the whole slice."""
    hit = np.zeros(len(bounds) - 1, bool)
    for (size, _), (known, _, _) in index.by_size.items():
        hashes = grams(words, size)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        found = np.flatnonzero(known[place] == hashes) if len(hashes) else np.zeros(0, np.int64)
        hit[np.searchsorted(bounds, found, "right") - 1] = True
    return np.flatnonzero(hit)


def shards_of(templates: dict[str, str], most: int) -> list[dict[str, str]]:
    """Templates in their order, with at most so many words together; a longer template is a shard of its own."""
    out: list[dict[str, str]] = []
    held = most
    for name, text in sorted(templates.items()):
        size = len(text.split())
        if held + size > most:
            out.append({})
            held = 0
        out[-1][name] = text
        held += size
    return out


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_coverage: float = MIN_COVERAGE,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row for each place of a license: id, license, matched_words, template_words, start, end (code points)."""
    texts = docs.select(id_col, text_col)
    kind = texts.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, license string, matched_words long, template_words long, start long, end long"
    parts = [texts.mapInArrow(_scan(build_index(s, min_coverage), min_coverage), columns) for s in shards_of(templates, shard_words)]
    found = parts[0] if parts else texts.limit(0).mapInArrow(_scan(build_index({}, min_coverage), min_coverage), columns)
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.withColumnRenamed("id", id_col)
    return found.withColumn("coverage", F.round(F.col("matched_words") / F.col("template_words"), 6))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
