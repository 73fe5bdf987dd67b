"""Token files: exact round trips, and ids against the tokenizer on whole texts."""

import io
import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import tokenfiles
from tallyforge.llm.registry import QUERIES

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SPECIALS = "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|"


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.sampled_from([255, 256, 65535, 65536, 2**24 - 1, 2**24])))
def test_numbers_come_back(values):
    ranks = np.array(values, np.uint32)
    control, data = tokenfiles.encode(ranks)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)
    assert tokenfiles.decode(control, data, len(values)).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=300))
def test_blocks_come_back_and_frequent_ids_rank_first(values):
    index = pa.RecordBatch.from_pydict({"id": ["x", None], "n": [1, len(values) - 1], "first": [True, True]})
    data = tokenfiles.block(np.array(values), index)
    ((found, ids),) = tokenfiles.blocks(io.BytesIO(data))
    assert ids.tolist() == values and found.to_pylist() == index.to_pylist()
    with pytest.raises(ValueError, match="checksum"):
        list(tokenfiles.blocks(io.BytesIO(data[:-1] + bytes([data[-1] ^ 1]))))
    with pytest.raises(ValueError, match="cut short"):
        list(tokenfiles.blocks(io.BytesIO(data[:10])))


def test_one_byte_for_frequent_ids():
    ids = np.array([40_000] * 3000 + list(range(300)))
    head = tokenfiles.block(ids, pa.RecordBatch.from_pydict({"id": [1]}))[: tokenfiles.HEADER.size]
    _, _, distinct, n, control, data, _ = tokenfiles.HEADER.unpack(head)
    assert (distinct, n, control, data) == (301, 3300, 825, 3300 + 301 - 256)


TEXT = st.text(st.sampled_from(list("abXYZ '’stREvmLd09_-.,!?\n\t\x0b\x1c\x85\xa0 éÀİßΣσς漢字́<|>ʼnǅ²")), max_size=50)


@settings(max_examples=400, deadline=None)
@given(st.one_of(TEXT, st.lists(st.sampled_from(SPECIALS.split(" ") + ["it's", "WE'LL", " "]), max_size=6).map("".join)))
def test_ids_as_of_the_whole_text(text):
    encoder = tokenfiles.word_ids(tokenfiles.default_file())
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole(text)


TEXTS = ["Plain words, it's 2024", "", None, SPECIALS, "été ÜBER 漢字 Ελλάς ΣΑΣ 🙂", "word " * 3000, "x" * 3000, "same", "same", "\n\t "]


def read(spark, path):
    return [(r[0], r.start, r.n_tokens, r.ids) for r in sorted(tokenfiles.read_ids(spark, path).collect(), key=lambda r: r.start)]


@pytest.mark.parametrize("block", [tokenfiles.BLOCK, 7])
def test_files_against_whole_texts(spark, tmp_path, block):
    """Null and empty texts, null and repeated ids, repeated rows, clashing columns, documents over several blocks."""
    rows = [(i % 6 - 2 if i % 5 else None, t, "x", 5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "key long, text string, ids string, start int").repartition(3)
    tokenfiles.write_ids(docs, f"file:{tmp_path}/ids", id_col="key", block_ids=block)
    found = read(spark, f"file:{tmp_path}/ids")
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for _, start, n, ids in found:
        assert start == at and len(ids) == 4 * n
        at += n
    want = [(r[0], [*whole(r[1]), 1]) for r in rows]
    assert sorted(((r[0], np.frombuffer(r[3], "<u4").tolist()) for r in found), key=repr) == sorted(want, key=repr)


def test_blocks_bound_documents():
    made = tokenfiles.Blocks(pa.int64(), 10)
    data = b"".join(x for i, n in enumerate([4, 25, 0, 3]) for x in made.add(i, np.arange(n, dtype="<u4"))) + made.rest()
    assert [len(ids) for _, ids in tokenfiles.blocks(io.BytesIO(data))] == [10, 10, 10, 2]
    assert (made.documents, made.ids) == (4, 32)


def test_string_ids_and_empty_table(spark, tmp_path):
    tokenfiles.write_ids(spark.createDataFrame([("b", "two"), ("a", "one")], "doc_id string, text string"), f"{tmp_path}/s")
    assert [r[0] for r in read(spark, f"{tmp_path}/s")] == ["a", "b"]
    tokenfiles.write_ids(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert read(spark, f"{tmp_path}/e") == []


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    """A second attempt's file, or one of an executor that was lost, is not seen; a full place is not appended to."""
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    tokenfiles.write_ids(docs, f"{tmp_path}/m")
    before = read(spark, f"{tmp_path}/m")
    (Path(tmp_path) / "m" / "part-lost.ids").write_bytes(b"RID1")
    assert read(spark, f"{tmp_path}/m") == before and len(before) == 20
    files = json.loads((Path(tmp_path) / "m" / tokenfiles.MANIFEST).read_text())["files"]
    assert sum(f[1] for f in files) == 20
    with pytest.raises(Exception, match="already"):
        docs.withColumn("ids", F.lit(b"")).select("doc_id", "ids").write.format(tokenfiles.FORMAT).mode("append").save(f"{tmp_path}/m")


def test_query(spark):
    d = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in QUERIES["op13_token_ids"](spark, d).collect()}
    at = 0
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*whole(r.text), 1], "<u4")
        assert tuple(out[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
