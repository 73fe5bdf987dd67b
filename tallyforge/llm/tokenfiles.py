"""Token ids in binary files (operator 13): a Spark data source and the tokenizing query over it.

``write_ids`` sorts documents by id into ranges, tokenizes each range and writes
it as one file; ``read_ids`` gives the documents back with their place in the
whole sequence of ids.

The format, in blocks of at most BLOCK ids: an index (an Arrow stream of document
ids and lengths), the block's distinct ids by falling frequency, control bytes,
data bytes. An id is written as its rank in that order, in as few bytes as the
rank needs; a control byte holds the four lengths of four ranks, two bits each,
apart from the data. Frequent ids so take one byte, and a block is decoded
without a branch: lengths from a table by control byte, offsets by a running sum,
bytes gathered by numpy, ids from the rank table. Every block has a checksum and
needs no other, so files are written in one pass over the texts, without counts
of the whole corpus first. A document longer than a block goes on in the next.

Each attempt of a task writes a file of its own name and reports it when it is
whole; the manifest, written last, lists one file a range in order. So a lost
executor or a second attempt leaves nothing that a reader sees. The manifest's
sums give each file's first place, and files are read apart from each other. It
grows with files, not with documents. Paths are any that Arrow's file systems
open, on the driver and the executors alike.

Defined results: a null or empty text is the end id alone. Rows without an id
come first; rows of one id are ordered by their text's hash, equal rows in any
order. Special tokens' strings in texts are those tokens, as the tokenizer finds
them. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tallyforge.llm.scratch import Scratch
from tallyforge.llm.texts import Recent, byte_level, slices

FORMAT = "ranked_ids"
MANIFEST = "manifest.json"
END_ID = 1
#: Ids of a block, and the bound of an id.
BLOCK, MOST_ID = 1 << 20, 1 << 24
#: Words and pieces of words in a generation of what a worker remembers.
REMEMBERED = 250_000

# Coding


#: Lengths of the four ranks of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    lengths = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    each = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control, each[np.arange(4, dtype=np.uint8) < lengths[:, None]]


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n numbers, by table lookup and gathering."""
    lengths = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    values = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        values[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


#: Sizes of a block's parts: index, distinct ids, ids, control and data, then the checksum of all parts.
HEADER = struct.Struct("<4s6I")
MAGIC = b"RID1"


def block(ids: np.ndarray, index: pa.RecordBatch) -> bytes:
    """Ids of consecutive documents, or pieces of them, as one block."""
    counts = np.bincount(ids)
    by_rank = np.flatnonzero(counts)
    by_rank = by_rank[np.argsort(-counts[by_rank], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    control, data = encode(rank[ids])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_batch(index)
    parts = [sink.getvalue(), by_rank.astype("<u4").tobytes(), control.tobytes(), data.tobytes()]
    body = b"".join(parts)
    return HEADER.pack(MAGIC, len(parts[0]), len(by_rank), len(ids), len(control), len(data), zlib.crc32(body)) + body


def blocks(stream) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(index, ids) of each block of an open file."""
    while head := stream.read(HEADER.size):
        if len(head) < HEADER.size:
            raise ValueError("a block is cut short")
        magic, n_index, n_table, n_ids, n_control, n_data, crc = HEADER.unpack(head)
        body = stream.read(n_index + 4 * n_table + n_control + n_data)
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("a block does not match its checksum")
        at = n_index + 4 * n_table
        table = np.frombuffer(body, "<u4", n_table, n_index)
        control = np.frombuffer(body, np.uint8, n_control, at)
        data = np.frombuffer(body, np.uint8, n_data, at + n_control)
        yield pa.ipc.open_stream(body[:n_index]).read_all(), table[decode(control, data, n_ids)]


# Data source


def opened(path: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    documents: int
    ids: int


class Blocks:
    """Collects documents and gives blocks of bounded size."""

    def __init__(self, kind: pa.DataType, most: int = BLOCK):
        self.kind, self.most, self.documents, self.ids = kind, most, 0, 0
        self._start()

    def _start(self) -> None:
        self.parts, self.index, self.held = [], ([], [], []), 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[bytes]:
        if len(ids) and int(ids.max()) >= MOST_ID:
            raise ValueError(f"ids must be below {MOST_ID}")
        self.documents, self.ids, at, first = self.documents + 1, self.ids + len(ids), 0, True
        while first or at < len(ids):
            piece = ids[at : at + self.most - self.held]
            self.parts.append(piece)
            for column, value in zip(self.index, (doc_id, len(piece), first), strict=True):
                column.append(value)
            self.held, at, first = self.held + len(piece), at + len(piece), False
            if self.held >= self.most:
                yield self.rest()

    def rest(self) -> bytes:
        doc_id, n, first = self.index
        index = pa.RecordBatch.from_arrays([pa.array(doc_id, self.kind), pa.array(n, pa.int64()), pa.array(first)], names=["id", "n", "first"])
        ids = np.concatenate(self.parts)
        self._start()
        return block(ids, index)


class RankedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema, overwrite: bool, block_ids: int):
        self.path, self.name, self.ddl = path, schema[0].name, schema[0].dataType.simpleString()
        self.overwrite, self.block_ids = overwrite, block_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.path)
        partition, file = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.ids"
        collected = out = None
        for batch in iterator:
            ids, data = batch.column(0), batch.column(1)
            if out is None and batch.num_rows:
                fs.create_dir(folder, recursive=True)
                collected, out = Blocks(ids.type, self.block_ids), fs.open_output_stream(f"{folder}/{file}", compression=None)
            for i in range(batch.num_rows):
                for full in collected.add(ids[i].as_py(), np.frombuffer(data[i].as_buffer(), "<u4")):
                    out.write(full)
        if out is None:
            return Written(partition, "", 0, 0)
        if collected.parts:
            out.write(collected.rest())
        out.close()
        return Written(partition, file, collected.documents, collected.ids)

    def commit(self, messages) -> None:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        if not self.overwrite and fs.get_file_info(f"{folder}/{MANIFEST}").is_file:
            self.abort(messages)
            raise ValueError(f"there are ids at {self.path} already")
        files = [[m.file, m.documents, m.ids] for m in sorted(messages, key=lambda m: m.partition) if m.documents]
        with fs.open_output_stream(f"{folder}/{MANIFEST}.new", compression=None) as out:
            out.write(json.dumps({"version": 1, "name": self.name, "type": self.ddl, "files": files}).encode())
        fs.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages) -> None:
        fs, folder = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{folder}/{m.file}")


@dataclass
class IdFile(InputPartition):
    file: str
    start: int


class RankedReader(DataSourceReader):
    def __init__(self, path: str, manifest: dict):
        self.path, self.manifest = path, manifest

    def partitions(self) -> list[IdFile]:
        start, out = 0, []
        for file, _, ids in self.manifest["files"]:
            out.append(IdFile(file, start))
            start += ids
        return out or [IdFile("", 0)]

    def read(self, partition: IdFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, folder = opened(self.path)
        start, doc_id, parts, rows = partition.start, None, None, []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            kinds = (index.schema.field("id").type, pa.int64(), pa.int64(), pa.binary())
            found = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[self.manifest["name"], "start", "n_tokens", "ids"]
            )
            rows.clear()
            return found

        def done() -> int:
            data = b"".join(parts)
            rows.append((doc_id, start, len(data) // 4, data))
            return start + len(data) // 4

        with fs.open_input_stream(f"{folder}/{partition.file}", compression=None) as stream:
            for index, ids in blocks(stream):
                ends = np.cumsum(index.column("n").to_numpy())
                for k, (x, first) in enumerate(zip(index.column("id").to_pylist(), index.column("first").to_pylist(), strict=True)):
                    if first and parts is not None:
                        start = done()
                    if first:
                        doc_id, parts = x, []
                    parts.append(ids[ends[k - 1] if k else 0 : ends[k]].astype("<u4").tobytes())
                if rows:
                    yield batch()
            if parts is not None:
                done()
                yield batch()


class RankedIds(DataSource):
    """``spark.read.format("ranked_ids").load(path)``: the id column, start, n_tokens, ids (32 bits each, little-endian)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _manifest(self) -> dict:
        fs, folder = opened(self.options["path"])
        with fs.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as stream:
            return json.loads(stream.read())

    def schema(self) -> str:
        found = self._manifest()
        return f"`{found['name']}` {found['type']}, start long, n_tokens long, ids binary"

    def reader(self, schema) -> RankedReader:
        return RankedReader(self.options["path"], self._manifest())

    def writer(self, schema, overwrite: bool) -> RankedWriter:
        return RankedWriter(self.options["path"], schema, overwrite, int(self.options.get("blockids", BLOCK)))


# Tokenizing

#: Characters on which Python's classes agree with the tokenizer's and that its normaliser only lower-cases: ASCII but
#: 0x1C-0x1F, and the letters of Latin-1 and Latin Extended-A/B but the dotted capital I (lower-cased to two characters).
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-įı-ɏ]*")
#: The pre-tokenizer's pattern (fixed value), in Python's classes.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_GAP = re.compile(r"[\x20\x09-\x0D]+")


class WordIds:
    """Ids of texts as little-endian 32-bit bytes; remembers words and their pieces.

    A plain word's pieces (those of the pre-tokenizer) go to the tokenizer's
    model alone; any other word goes through the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(file)
        self._model = self._tokenizer.model
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._byte_chars = {b: c for c, b in byte_level().items()}
        self._plain, self._others = Recent(REMEMBERED), Recent(REMEMBERED)

    def _plain_word(self, word: str) -> bytes:
        """Ids of a word; of its pieces, remembered like words, where it has several."""
        pieces = [word] if word.isalpha() else _SPLIT.findall(word)
        if len(pieces) == 1:
            spelt = word if word.isascii() and word.isprintable() else "".join(map(self._byte_chars.__getitem__, word.encode()))
            return self._kept(self._plain, word, array("I", [t.id for t in self._model.tokenize(spelt)]).tobytes())
        found, young, again, known = [], self._plain.young, self._plain.again, True
        for piece in pieces:
            x = young.get(piece) or again(piece)
            if x is None:
                x, known = self._plain_word(piece), False
            found.append(x)
        ids = b"".join(found)
        # A word with a new piece is likely to be rare; it is remembered if it comes again.
        return self._kept(self._plain, word, ids) if known else ids

    def _other_word(self, word: str) -> bytes:
        return self._kept(self._others, word, array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes())

    @staticmethod
    def _kept(table: Recent, word: str, ids: bytes) -> bytes:
        return table.keep(word, ids) if len(word) <= 64 else ids

    def _words(self, words: list[str], table: Recent, made: Callable[[str], bytes]) -> bytes:
        found = list(map(table.young.get, words))
        if None in found:
            again = table.again
            found = [again(w) or made(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)

    def _part(self, part: str) -> bytes:
        """Ids of a part of a text that no word crosses."""
        if self._special and self._special.search(part):
            return b"".join(self._other_word(x) if k % 2 else self._part(x) for k, x in enumerate(self._special.split(part)))
        if _PLAIN.fullmatch(part):
            return self._words(part.lower().split(), self._plain, self._plain_word)
        return self._words([w for w in _GAP.split(part) if w], self._others, self._other_word)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._part, slices(text, _GAP)))


_encoders: dict[str, WordIds] = {}


def word_ids(file: str) -> WordIds:
    """One a Python worker and file."""
    if file not in _encoders:
        _encoders[file] = WordIds(file)
    return _encoders[file]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenized(file: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(file or default_file()), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [encoder.ids(t.as_py() or "") + end for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str | None = None,
    end_id: int = END_ID,
    block_ids: int = BLOCK,
) -> None:
    """Tokenizes documents and writes their ids in ascending order of the id column, each document ended by ``end_id``."""
    docs.sparkSession.dataSource.register(RankedIds)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Ties are dealt by content and row number, so that no repeated id needs a range of its own.
    keys = [F.col("id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = texts.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys[1:])])
    ordered = ordered.repartitionByRange("id", "_k0", "_k1").sortWithinPartitions("id", "_k0", "_k1")
    kind = texts.schema["id"].dataType.simpleString()
    tokens = ordered.select("id", "text").mapInArrow(_tokenized(tokenizer_file, end_id), f"id {kind}, ids binary")
    tokens.withColumnRenamed("id", id_col).write.format(FORMAT).option("blockIds", block_ids).mode("overwrite").save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id column, start, n_tokens, ids) of each document in the files."""
    spark.dataSource.register(RankedIds)
    return spark.read.format(FORMAT).load(path)


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).base}/ids"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
