"""Best-fit packing against a plain best-fit decreasing loop and the tokenizer itself."""

import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import packing


def plain_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins += at >= len(rooms) and room == capacity
        insort(rooms, room - n)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_bulk_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    moves = packing.best_fit_decreasing(histogram, 40)
    bins: dict[int, list[tuple[int, int]]] = {}
    seen = {n: [] for n in histogram}
    for m in moves:
        for k in range(m.count):
            bins.setdefault(m.bin + k // m.each, []).append((m.offset + k % m.each * m.length, m.length))
            seen[m.length].append(m.rank + k)
    assert all(sorted(seen[n]) == list(range(c)) for n, c in histogram.items())
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 40
    assert len(bins) == plain_best_fit(lengths, 40)


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


TEXTS = [
    "Plain words, it's 2024; they'll  see  ",
    "",
    None,
    "\n\n tabs\tand\r\nlines   ",
    "été Ünïcode ÀÉ × ÷ ª º µ 1² ½ ٣ 漢字   wide\x1cseps\x85   nb",
    "under_score __x__ <|endoftext|> 'S 'll",
    "été<|endoftext|><|endoftext|>\n漢 <|endoftext|",
    "word " * 3000,
    "x" * 5000,
    "mixed été 12,5 % — “quotes” …",
]


def test_pieces_against_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i % 7 if i % 5 else None, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = packing.pack(docs).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    check_sequences(out)


def check_sequences(out):
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) == plain_best_fit([r.length for r in out], 1024)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_query(spark, sf):
    check_sequences(packing.op9_best_fit_packing(spark, f"/root/testdata/{sf}").collect())
