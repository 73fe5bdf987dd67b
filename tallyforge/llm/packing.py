"""Best-fit packing of tokenised documents into sequences (operator 9).

Documents are tokenised where they lie; only lengths and checksums move on.
Best-fit decreasing looks at nothing but lengths, and there are at most
``capacity`` different ones. So the packing is computed exactly for all
documents from the histogram of lengths: bins with the same room are one class,
the classes' open bins are the leaves of a segment tree, and the tightest room
that takes a piece is found in log2(capacity) steps. A class takes its pieces
in bulk, so the work on the driver depends on the capacity and not on the
number of documents (a histogram of 1024 counts goes in, and a plan of a few
thousand rows comes out).

Each piece then needs its rank among pieces of its length. Ranks are counts:
pieces get a number inside the chunk that they were written in, and a running
sum over the chunks' histograms gives each chunk's first rank. The plan says
which bin and place a rank has. No group of documents meets in one task.

Defined results: a null or empty text is one piece of the end token; texts are
never cut unless they are longer than a sequence, and then into full pieces but
for the first; rows with a null or repeated id are packed one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.scratch import Scratch

CAPACITY = 1024
END_ID = 2
#: The vocabulary's one added token (fixed values); the tokenizer finds it in texts as well, before it splits them.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pre-tokens that a worker remembers; the table starts again beyond it.
REMEMBERED = 250_000

#: Characters on which Python's \w, \d and \s agree with the tokenizer's classes: ASCII but its
#: separators 0x1C-0x1F, and the letters of Latin-1 and Latin Extended-A/B.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]*")
#: The pre-tokenizer's pattern (fixed value), in Python's classes.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Encoder(dict):
    """Byte-level BPE ids as little-endian 32-bit bytes; remembers pre-tokens."""

    def __init__(self, ranks_file: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._full = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = np.array(self._full.encode_ordinary(token), "<u4").tobytes()
        if len(token) <= 64:
            self[token] = found
        return found

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array([SPECIAL_ID], "<u4").tobytes().join(map(self._ordinary, text.split(SPECIAL)))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            # A text with other characters is encoded whole; surrogates cannot occur in UTF-8 data.
            return np.array(self._full.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(ranks_file: str) -> Encoder:
    """One encoder a Python worker and file."""
    if ranks_file not in _encoders:
        _encoders[ranks_file] = Encoder(ranks_file)
    return _encoders[ranks_file]


def default_ranks() -> str:
    """The ranks of byte_bpe_50k.json, the same vocabulary in the form that the encoder reads."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter, the rest are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(ranks_file: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file or default_ranks())
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for i in range(len(texts)):
                data = encode.ids(texts[i].as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(data) // 4, capacity)):
                    rows.append(i)
                    out.append((k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
            piece, start, length, crc = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class RoomTree:
    """A segment tree over rooms 0..capacity; finds the least open room of at least n in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Move:
    """Pieces of one length, from a rank on: ``each`` to every bin of a range, placed from ``offset`` on."""

    length: int
    rank: int
    count: int
    each: int
    bin: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Move]:
    """The best-fit decreasing packing of counts[length] pieces, in bulk.

    A bin of the tightest room r takes the next r // length pieces in a row, as
    after each it is the tightest one still. So do its equals after it.
    """
    tree, rooms = RoomTree(capacity), {}
    moves: list[Move] = []
    fresh = 0

    def put(room: int, first: int, bins: int) -> None:
        rooms.setdefault(room, []).append((first, bins))
        if room and len(rooms[room]) == 1:
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, bins = fresh, -(-left // each)
                fresh += bins
            else:
                each = room // length
                first, bins = rooms[room].pop()
                if not rooms[room]:
                    tree.mark(room, False)
            full = min(bins, left // each)
            if full:
                moves.append(Move(length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < bins and left:
                moves.append(Move(length, rank, left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, left, rank = full + 1, 0, rank + left
            if full < bins:
                put(room, first + full, bins - full)
    return moves


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    ranks_file: str | None = None,
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    cut_up = texts.mapInArrow(
        _pieces(ranks_file, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )
    # The number holds the writing task's place in its upper bits; it is stored with the row.
    rows = scratch.save(cut_up.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    chunk = F.shiftright("_n", 33)
    counts = rows.groupBy(chunk.alias("chunk"), "length").agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "counts")  # at most capacity rows a chunk
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    moves = best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame(
        [(m.length, m.rank, m.count, m.each, m.bin, m.offset) for m in moves],
        "length long, first_rank long, n long, each long, first_bin long, at long",
    )
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # Inside a chunk and length, rows are ranked by their stored number.
    inside = W.partitionBy("chunk", "length").orderBy("_n")
    ranked = (
        rows.withColumn("chunk", chunk)
        .withColumn("k", F.row_number().over(inside) - 1)
        .join(first, ["chunk", "length"])
        .withColumn("rank", F.col("first") + F.col("k"))
    )
    # The plan has a few rows for each length, whatever the corpus.
    steps = plan.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first_rank", "n", "each", "first_bin", "at"))).alias("steps")
    )
    step = F.filter(
        "steps", lambda s: (F.col("rank") >= s["first_rank"]) & (F.col("rank") < s["first_rank"] + s["n"])
    )
    placed = ranked.join(F.broadcast(steps), "length").withColumn("s", F.get(step, 0))
    k = F.col("rank") - F.col("s.first_rank")
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("s.first_bin") + F.expr("(rank - s.first_rank) div s.each")).alias("sequence_id"),
        (F.col("s.at") + k % F.col("s.each") * F.col("length")).alias("offset"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
