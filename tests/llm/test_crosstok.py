"""Cross-tokenizer alignment against whole-text encodings and plain counting."""

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import crosstok, texts
from tallyforge.llm.registry import QUERIES

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
AS_BYTE = texts.byte_level()


def plain_groups(text):
    """Groups of (ids of A, ids of B), from encodings of the whole text; None where they do not spell it."""
    if not text:
        return None
    raw, a, b = (" " + text).encode(), A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelt_a = [bytes(AS_BYTE[c] for c in A.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(spelt_a) != raw or b"".join(spelt_b) != raw:
        return None
    ends = [list(accumulate(map(len, x))) for x in (spelt_a, spelt_b)]
    groups, lo = [], (0, 0)
    position = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
    for end in sorted(set(ends[0]) & set(ends[1])):
        hi = position[0][end], position[1][end]
        groups.append((a[lo[0] : hi[0]], b[lo[1] : hi[1]]))
        lo = hi
    return groups


def plain(texts):
    every = [plain_groups(t) for t in texts]
    count = Counter((x[-1], y[-1]) for g in every if g for x, y in g)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    rows = []
    for g in every:
        if not g:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        links = [(x[-1], y[-1]) for x, y in g]
        n_best, total = sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links)
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), n_best, total, hashlib.sha256(text.encode()).hexdigest()))
    return rows, count


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    "Plain words, it's 2024; they'll  see  ",
    "",
    None,
    " leading and   runs of   spaces ",
    "\n\n tabs\tand\r\nlines   \x0b\x0c \x1c \x85 \xa0 　 wide",
    "été Ünïcode ÀÉ × ÷ ª 漢字 Ελληνικά кириллица 🙂👩‍👩‍👧 ﷽ é",
    "<|endoftext|> <s> </s> <unk> <0x41> <0x0A>",
    "the piece mark ▁ and words▁after",
    "nul \x00 byte",
    "x" * 5000,
    "word " * 3000,
    "a",
    " ",
    "word word",
    "word word",
]


def rows_of(out, id_col="doc_id"):
    return sorted((tuple(r[c] for c in FIELDS) for r in out.collect()), key=repr)


@pytest.mark.parametrize("part_links,stripe_rows", [(crosstok.PART_LINKS, crosstok.STRIPE_ROWS), (500, 4000)])
def test_texts_against_whole_encodings(spark, part_links, stripe_rows):
    """Null and empty texts, ties, repeated rows and ids, null ids, clashing columns, hot pairs in parts."""
    rows = [(i % 7 if i % 5 else None, t, "x", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stripe string, n int").repartition(3)
    found = crosstok.Alignment(docs, part_links=part_links, stripe_rows=stripe_rows)
    want, count = plain(TEXTS)
    assert rows_of(found.documents()) == sorted(want, key=repr)
    assert {(r.a_id, r.b_id): r["count"] for r in found.cells().collect()} == dict(count)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    assert {(r.a_id, r.b_id) for r in found.best().collect()} == {k for k, n in count.items() if n == top[k[1]]}


ALPHABET = st.text(st.sampled_from(list("abz AB'\n\t.,-_09é▁漢 ́")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_units_are_encoded_as_in_the_whole_text(text):
    aligner = crosstok.aligner(*crosstok.default_files())
    found = b";".join(x[0] for x in aligner.align(text)).decode()
    groups = plain_groups(text) or []
    assert found == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_long_texts_in_slices(monkeypatch):
    aligner = crosstok.aligner(*crosstok.default_files())
    text = "one two, three's  four\n" * 400
    whole = list(aligner.align(text))
    monkeypatch.setattr(crosstok.Aligner, "slices", lambda self, t: texts.slices(t, crosstok.GAP, 100))
    parts = list(aligner.align(text))
    assert len(whole) == 1 and len(parts) > 50
    assert b";".join(x[0] for x in parts) == whole[0][0] and b"".join(x[1] for x in parts) == whole[0][1]
    assert list(aligner.align(text + " ▁ end")) == []


def test_flushes_keep_all_links():
    packer = crosstok.Packer(100, 4)
    packer.add(10, np.array([5, 205, 205, 105]))
    packer.add(12, np.array([205]))
    assert packer.full(10 + crosstok.FLUSH_DOCS) and not packer.full(13)
    rows = {r[0]: r for r in packer.flush()}
    assert {s: r[2] for s, r in rows.items()} == {0: 1, 1: 1, 2: 3} and all(r[1] == 10 for r in rows.values())
    assert np.frombuffer(rows[2][5], "<u2").tolist() == [0, 2] and np.frombuffer(rows[2][6], "<u4").tolist() == [2, 1]


def test_empty_table(spark):
    found = crosstok.Alignment(spark.createDataFrame([], "doc_id string, text string"))
    assert found.documents().collect() == [] and found.cells().collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    out = QUERIES["op11_cross_tokenizer"](spark, d)
    assert out.columns == ["doc_id", *FIELDS]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([r.text for r in docs])
    assert {r.doc_id: tuple(r[c] for c in FIELDS) for r in out.collect()} == {r.doc_id: w for r, w in zip(docs, want, strict=True)}
