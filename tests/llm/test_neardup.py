"""Near-duplicate groups against all pairs; signatures against true similarities; big buckets in blocks."""

import random

import numpy as np
import pytest

from tallyforge.llm import bytescan, neardup


def brute(rows, width, threshold=80):
    def shingles(text):
        w = (text or "").encode().lower().split()
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])

    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            n = len(x & y)
            if x and y and 100 * n >= threshold * (len(x) + len(y) - n):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((d, len(s), root(d), d == root(d)) for d, s in sets)


def family(rng, words, n, first, edits):
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(60)] = rng.choice(words)
        out.append((first + k, " ".join(own)))
    return out


@pytest.mark.parametrize("width,block", [(2, 1024), (2, 7), (5, 1024)])
def test_against_all_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(width * 10 + block)
    words = [f"w{i}" for i in range(400)]
    rows = family(rng, words, 60, 0, 14) + family(rng, words, 30, 100, 4)
    for f in range(12):
        rows += family(rng, words, 4, 200 + 10 * f, 9)
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (902, ""), (903, " \n "), (904, "one"), (905, "One"), (906, "a b"), (907, "b a")]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, component int, set string")
    out = neardup.near_duplicates(docs, width=width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == brute(rows, width)


def test_defined_cases(spark):
    rows = [(None, "some words here"), (1, None), (2, "some words here"), (2, "some words here"), (3, "x" * 300000), (4, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.near_duplicates(docs, width=2).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[None].component_id is None and by[None].kept
    assert by[1].component_id == 1 and by[1].n_shingles == 0 and by[4].n_shingles == 1
    assert neardup.near_duplicates(docs.limit(0), width=2).count() == 0
    assert neardup.keep_one_each(docs).columns == docs.columns


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "x y z w"), (3, "x y z w"), (5, "p q r"), (5, "p q r"), (None, "a b c d"), (6, ""), (6, None)]
    docs = spark.createDataFrame([(d, t, k, 0, 0) for k, (d, t) in enumerate(rows)], "doc_id long, text string, represents int, content int, n int")
    out = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, width=2).collect()]
    want = [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (5, 5, True), (5, 5, True), (None, None, True), (6, 6, True), (6, 6, True)]
    assert sorted(out, key=str) == sorted(want, key=str)
    stay = neardup.keep_one_each(docs)
    assert stay.columns == docs.columns
    want = [(1, "a b c d"), (2, "x y z w"), (5, "p q r"), (None, "a b c d"), (6, ""), (6, None)]
    assert sorted([(r.doc_id, r.text) for r in stay.collect()], key=str) == sorted(want, key=str)


def test_string_ids_and_a_hot_bucket(spark, monkeypatch):
    """One large group of near copies and one of exact copies, with ids that are no numbers."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"n{d:04}", t) for d, t in family(rng, words, 150, 0, 5)] + [(f"e{d:04}", "same text here again") for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = neardup.near_duplicates(docs, width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == brute(rows, 2)


def test_words_do_not_collide_by_construction():
    """Words that exchange two letters by the Thue-Morse sequence defeat every polynomial hash modulo 2**64."""
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    for n in (64, 128, 2048):
        raw = np.frombuffer(f"{x[:n]} {y[:n]}".encode(), np.uint8)
        assert len(set(bytescan.hash_spans(raw, np.array([0, n + 1]), np.array([n, 2 * n + 1])).tolist())) == 2
    short = np.frombuffer("aAbaabaaab\0".encode(), np.uint8)
    places = [(i, j) for i in range(11) for j in range(i, 12)]
    hashes = bytescan.hash_spans(short, np.array([i for i, _ in places]), np.array([j for _, j in places]))
    texts = [bytes(short[i:j]).lower() for i, j in places]
    assert len(set(hashes.tolist())) == len(set(texts))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        common = rng.integers(1, 1 << 62, int(rng.integers(5, 900)), dtype=np.uint64)
        a = np.unique(np.concatenate((common, rng.integers(1, 1 << 62, 40, dtype=np.uint64))))
        b = np.unique(np.concatenate((common, rng.integers(1, 1 << 62, 30, dtype=np.uint64))))
        s = neardup.super_minhash(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert np.isfinite(s).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_words_are_bytes_between_blanks():
    texts = ["", "a", " a  b\n", "É x\xa0y", "\t\x0b\x0c\r", "abc"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    starts, ends, bounds = bytescan.words(raw, at)
    got = [[bytes(raw[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(bounds, bounds[1:])]
    assert got == [t.encode().split() for t in texts]
    hashes = bytescan.hash_spans(raw, starts, ends)
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 5
