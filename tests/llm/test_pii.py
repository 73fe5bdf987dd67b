"""Base patterns against the plain expressions; the field on held-out sentences and in texts."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import pii

PLAIN = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("ab1234.@+-_ ()%é\n")), max_size=60))
def test_base_matches(text):
    want = [(m.start(), k, m.end()) for k, p in PLAIN.items() for m in p.finditer(text)]
    assert sorted(want) == sorted(x[:3] for x in pii.base_matches(text))


def test_accepted():
    good = {(k, s, e) for s, k, e, ok in pii.base_matches("1.2.3.256; 4539578763621486; 4539578763621487; +49 30 1234567") if ok}
    assert {k for k, _, _ in good} == {2, 3} and len(good) == 2


def test_field_learns_and_is_anchored():
    sentences: dict = {}
    for s, _, word, label in pii.labelled_rows():
        sentences.setdefault(s, ([], []))[0].append(word)
        sentences[s][1].append(label)
    table = list(sentences.values())
    field = pii.train(table[:250])
    assert field.anchored
    right = total = 0
    for words, labels in table[250:]:
        e = field.emissions([pii.shape(w) for w in words])
        got = pii.viterbi(field, [e], [(5, 5)])[0]
        right += sum(pii.LABELS[a] == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_query(spark):
    rows = [
        (1, "Call (555) 123-4567 or write to jo.doe@mail.example.org today, please", 1),
        (None, None, 2),
        (2, "", 3),
        (2, "été from 10.0.0.1 at noon " + "word " * 20000 + "jo at acme dot com now", 4),
        (3, "Plain words at home, at work and at sea. Chapter 12, 2024-01-15, 12:30.", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = {r.spans: r for r in pii.find_personal_data(docs).collect()}
    assert len(out) >= 3
    texts = [r[1] or "" for r in rows]
    found = {x for r in out.values() for x in r.spans.split(",") if x}
    assert any(x.startswith("email:") for x in found) and any(x.startswith("field_phone:") for x in found)
    phone = next(x for x in found if x.startswith("field_phone"))
    a, b = map(int, phone.split(":")[1:])
    assert texts[0][a:b].endswith("555) 123-4567")
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def small_field():
    sentences: dict = {}
    for i, _, word, label in pii.labelled_rows(60):
        sentences.setdefault(i, ([], []))[0].append(word)
        sentences[i][1].append(label)
    return pii.train(list(sentences.values()), turns=20)


def test_viterbi_against_all_paths(monkeypatch):
    """Batches of any size, and long pieces in parts, find the best of all label paths."""
    monkeypatch.setattr(pii, "CELLS", 3)
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    field = pii.Field({}, rng.normal(0, 1, (k + 1, k + 1)))
    pieces = [rng.normal(0, 1, (n, k)) for n in (1, 2, 3, 5, 4, 1, 5)]
    outer = [(int(rng.integers(k + 1)), int(rng.integers(k + 1))) for _ in pieces]

    def score(e, path, a, b):
        t = field.transitions
        return t[a, path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])) + t[path[-1], b]

    want = [max(itertools.product(range(k), repeat=len(e)), key=lambda p: score(e, p, *o)) for e, o in zip(pieces, outer)]  # noqa: B023
    assert [tuple(x) for x in pii.viterbi(field, pieces, outer)] == want
    assert [tuple(pii.decode_long(field, lambda a, b: e[a:b], len(e), o)) for e, o in zip(pieces, outer)] == want  # noqa: B023


def test_pieces_give_what_whole_documents_give(monkeypatch):
    """The shortcut decodes only what can differ from O; without it whole documents are decoded, with the same spans."""
    field = small_field()
    assert field.anchored
    rng = np.random.default_rng(4)
    words = "word Here, 12 +49 call (555) 123-4567 jo@mail.example.org at dot 10.0.0.1 4539578763621486 2024-01-15 x".split()
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)) for n in (0, 1, 3, 30, 200, 900)]
    raw, at = pii.bytescan.text_buffers(pa.array(texts))
    short = pii.field_spans(field, raw, at)
    field.anchored = False
    assert pii.field_spans(field, raw, at) == short
    monkeypatch.setattr(pii, "CELLS", 16)
    assert pii.field_spans(field, raw, at) == short and sum(map(len, short)) > 20


def test_base_columns_against_brute_force(spark):
    """The query's own counts and digest on the given documents, from the plain expressions."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")

    def luhn(d):
        n = [int(c) for c in d[::-1]]
        return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0

    def accepted(kind, text):
        digits = re.sub("[^0-9]", "", text)
        if kind == 1:
            return all(int(p) <= 255 for p in text.split("."))
        if kind == 2:
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == 0 or 10 <= len(digits) <= 15

    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    rows |= {-1: "été a@b.co 1.2.3.4 and 256.1.1.1 😀 4539 5787 6362 1486, +49 (30) 1234567 +1 2", -2: "00001.2.3.4"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        found = sorted((m.start(), k, m.end()) for k, p in PLAIN.items() for m in p.finditer(rows[r.doc_id]) if accepted(k, m.group()))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r.doc_id
        assert [r[f"n_{name}"] for name in pii.KINDS] == [sum(k == i for _, k, _ in found) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_a_very_long_text_of_numbers(spark):
    """Millions of characters of numbers in one text, beside a short one."""
    docs = spark.createDataFrame([(1, "123 4567 " * 400_000), (2, "call +49 30 1234567 now")], "doc_id int, text string")
    out = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert out[2].n_phone == 1 and len(out) == 2


def test_labels_are_whole_sentences_in_order(spark):
    rows = [(s, p, f"w{s}-{p}", "O") for s in range(30) for p in range(s % 5 + 1)]
    table = spark.createDataFrame(rows, "sentence int, place int, word string, label string").repartition(4, "word")
    got = pii.first_sentences(table, 20)
    want = [r for r in rows if r[0] <= 6]  # 1 + 2 + 3 + 4 + 5 + 1 + 2 words; the next sentence would be too long
    assert sorted(got) == want and len(got) == 18
    assert sorted(pii.first_sentences(table, 1000)) == rows
    with pytest.raises(ValueError, match="no labelled sentence"):
        pii.first_sentences(table, 0)
