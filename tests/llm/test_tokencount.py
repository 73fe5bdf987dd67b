"""Edit-aware counts against encoding the edited text anew."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import tokencount
from tallyforge.llm.packing import default_ranks, encoder

PIECES = ["word", " ", "  ", "\n", "\n\n", "'s", "'", "!", "?!", "12", "3", "été", " x", "\t", "don't", "A", "漢", "", "<|endof", "text|>", "<|endoftext|>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)
EDITS = st.lists(st.tuples(st.integers(0, 90), st.integers(0, 20), st.lists(st.sampled_from(PIECES), max_size=4).map("".join)), max_size=4)


@settings(max_examples=400, deadline=None)
@given(TEXT, EDITS)
def test_counts_after_edits(text, edits):
    encode = encoder(default_ranks())
    counted = tokencount.CountedText(text, encode)
    assert counted.tokens == len(encode.ids(text)) // 4
    for start, n, new in edits:
        counted.replace(start, start + n, new)
        text = text[: min(start, len(text))] + new + text[start + n :]
        assert counted.text() == text
        assert counted.tokens == len(encode.ids(text)) // 4
        assert counted.chars == len(text)


SCRIPTS = PIECES + ["“", "”", "’s", "—", "…", "Привет", " мир", "漢字", "かな", "한국", "عربى", "हिन्दी", "😀", "\u00a0", "\u2003", "\u3000", "½", "١٢", "e\u0301", "\x1c", "\u200d", "\u0378"]
WIDE = st.lists(st.sampled_from(SCRIPTS), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(WIDE, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 20), st.lists(st.sampled_from(SCRIPTS), max_size=4).map("".join)), max_size=4))
def test_counts_after_edits_in_any_script(text, edits):
    encode = encoder(default_ranks())
    counted = tokencount.CountedText(text, encode)
    assert counted.tokens == len(encode.ids(text)) // 4
    for start, n, new in edits:
        counted.replace(start, start + n, new)
        text = text[: min(start, len(text))] + new + text[start + n :]
        assert counted.text() == text
        assert counted.tokens == len(encode.ids(text)) // 4


def test_long_texts_of_other_scripts_encode_little():
    rng = random.Random(5)
    encode = encoder(default_ranks())
    text = " ".join("".join(rng.choice("абвгд漢字かな") for _ in range(rng.randint(1, 8))) for _ in range(5000))
    counted = tokencount.CountedText(text, encode)
    assert counted.encoded_chars == len(text)
    for new in ["", " новые слова", "“", "\n\n", "漢"] * 8:
        start = rng.randrange(len(text))
        assert counted.replace(start, start + 5, new) < 150
        text = text[:start] + new + text[start + 5 :]
    assert counted.text() == text and counted.tokens == len(encode.ids(text)) // 4


def test_long_texts_encode_little():
    rng = random.Random(3)
    encode = encoder(default_ranks())
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(5000))
    counted = tokencount.CountedText(text, encode)
    for _ in range(60):
        start = rng.randrange(len(text))
        end = start + rng.randrange(12)
        new = rng.choice(["", " new words", "x", "\n\n", " "])
        assert counted.replace(start, end, new) < 120
        text = text[:start] + new + text[end:]
    assert counted.text() == text and counted.tokens == len(encode.ids(text)) // 4


def test_query_rows(spark):
    rows = [(1, "some text here", "x"), (None, None, "y"), (1, "", "z"), (2, "long " * 4000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = tokencount.edited_counts(docs.withColumn("edits", tokencount.derived_edits("doc_id", "text"))).collect()
    assert len(out) == 4
    assert {r.n_tokens for r in out if r.doc_id is None} == {0}
    assert tokencount.edited_counts(docs.limit(0).withColumn("edits", tokencount.derived_edits("doc_id", "text"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(WIDE, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 20), st.lists(st.sampled_from(SCRIPTS), max_size=4).map("".join)), max_size=4))
def test_kept_trees_equal_the_ones_they_were(text, edits):
    encode = encoder(default_ranks())
    counted = tokencount.CountedText(text, encode)
    for start, n, new in edits:
        state = counted.state()
        again = tokencount.CountedText.kept(text, state, encode)
        assert again.encoded_chars == 0 and again.state() == state
        again.replace(start, start + n, new)
        text = text[: min(start, len(text))] + new + text[start + n :]
        assert again.text() == text and again.tokens == len(encode.ids(text)) // 4
        assert again.tokens == again.tree.tokens[1] and again.chars == len(text)
        counted = again


def test_trees_pass_from_run_to_run(spark, tmp_path):
    rng = random.Random(9)
    encode = encoder(default_ranks())
    texts = {k: " ".join(rng.choice(["word", "été", "12", "漢字", "don't"]) for _ in range(rng.choice([0, 3, 900]))) for k in range(40)}
    rows = [(f"d{k}", t, "x") for k, t in texts.items()] + [("d0", None, "x"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, tree string")
    path = str(tmp_path / "trees-0")
    tokencount.count_trees(docs).write.parquet(path)
    for turn in range(3):
        trees = spark.read.parquet(path).select("doc_id", "text", "tree")
        before = {(r.doc_id, r.text): r.tree for r in trees.collect()}
        edits = "CASE WHEN crc32(concat(doc_id, '%d')) %% 2 = 0 THEN array(named_struct('start', 3L, 'end', 7L, 'new', ' neu“')) END" % turn
        rows = trees.selectExpr("*", f"{edits} AS edits")
        path = str(tmp_path / f"trees-{turn + 1}")
        tokencount.edit_trees(rows).write.parquet(path)
        after = spark.read.parquet(path).collect()
        assert len(after) == 42
        for r in after:
            assert r.n_tokens_after == r.tree.sum_tokens[1] == len(encode.ids(r.text or "")) // 4
            assert r.n_chars_after == len(r.text or "") == sum(r.tree.leaf_chars)
            if not r.n_edits:  # nothing was encoded, and the tree is the one that was read
                assert r.chars_encoded_again == 0 and before[r.doc_id, r.text] == r.tree
            else:
                assert 0 < r.chars_encoded_again < 60
