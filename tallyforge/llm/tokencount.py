"""Edit-aware token counts (operator 8).

A document's pre-tokens are the leaves of a tree whose inner nodes hold the
characters and tokens of what lies below. An edit replaces a stretch of text:
the leaves it touches are found from the sums on the way down, text from a few
leaves before to a few leaves after them is split and encoded again, and the
sums above are updated. All other leaves keep their counts.

Splitting a text depends on what lies around a place, so the context grows until
it no longer matters: new leaves are taken over as soon as, on either side, the
split of the changed stretch falls on an old boundary in the same state. On the
left that is two leaves before the first touched one (a pre-token is decided by
itself and one character after it, and white space joins what follows); on the
right, splitting goes on until it meets an old boundary after two leaves that
came out as before.

Leaves lie in blocks of about ``BLOCK`` leaves, whose sums are the inner nodes'
leaves, so an edit costs one block and a path of logarithmic length.

Trees are kept as a column: ``count_trees`` encodes each text once and gives its
tree; ``edit_trees`` reads texts, trees and edits and gives the new ones, so that
later runs start from them. A document without edits is passed on as it is, and
of one with edits only the blocks near them are cut into leaves, without encoding.

Defined results: a null text is an empty one; edits that are null or out of
range are clipped to the text; edits of one document apply in order of their
number, each to the text that the last one left; a document without edits is
counted once and keeps its text and tree; a null tree is built anew; rows with a
null or repeated id, and repeated rows, are counted one by one; a text with the
added token or with characters that Unicode has not assigned is one leaf, which
each edit encodes again; a very long text is split once and an edit costs a block
and a path of the tree; an empty table gives no rows; ``count_trees`` keeps other
columns and replaces one with the tree column's name, the other functions leave
them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.packing import _PLAIN, _SPLIT, SPECIAL, default_ranks, encoder
from tallyforge.llm.scratch import Scratch

BLOCK = 256
#: Leaves that a task holds before it hands a batch on; a longer text makes a batch of its own.
BATCH_LEAVES = 1_000_000

#: The pre-tokenizer's pattern (fixed value) for all scripts; on the characters of ``_SPLIT`` both split alike.
_WIDE_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Characters whose class depends on the version of Unicode that a reader knows.
_UNASSIGNED = regex.compile(r"\p{Cn}")


class SumTree:
    """Characters and tokens of blocks in a binary tree of sums; blocks are found by character in logarithmic time."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1
        while self.size < max(1, len(chars)):
            self.size *= 2
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.chars[self.size : self.size + len(chars)] = chars
        self.tokens[self.size : self.size + len(tokens)] = tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def of_sums(cls, chars: list[int], tokens: list[int]) -> SumTree:
        """A tree from the sums that one held before."""
        tree = cls.__new__(cls)
        tree.size, tree.chars, tree.tokens = len(chars) // 2, chars, tokens
        return tree

    def set(self, at: int, chars: int, tokens: int) -> None:
        i = at + self.size
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, char: int) -> tuple[int, int]:
        """(block, its first character) of a character; the last block at the end."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if char >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before


class Kept(NamedTuple):
    """A block's leaves as they were read; they are cut from the text when an edit comes near."""

    text: str
    chars: np.ndarray
    tokens: np.ndarray

    def cut(self) -> list[tuple[str, int]]:
        ends = [0, *accumulate(self.chars.tolist())]
        return [(self.text[a:b], n) for a, b, n in zip(ends, ends[1:], self.tokens.tolist(), strict=False)]


class CountedText:
    """A text's pre-tokens in blocks, with their token counts and sums."""

    def __init__(self, text: str, encode):
        self.encode = encode
        self.encoded_chars = len(text)
        self._read_by(text)
        leaves = self._leaves(text)
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self._sum()

    @classmethod
    def kept(cls, text: str, tree: dict, encode) -> CountedText:
        """A text with the tree that ``state`` gave; nothing is encoded."""
        self = cls.__new__(cls)
        self.encode, self.encoded_chars = encode, 0
        self._read_by(text)
        self.tree = SumTree.of_sums(list(tree["sum_chars"]), list(tree["sum_tokens"]))
        if self.chars != len(text):
            raise ValueError("the tree is not this text's")
        chars, tokens = np.asarray(tree["leaf_chars"], dtype=np.int32), np.asarray(tree["leaf_tokens"], dtype=np.int32)
        self.blocks, leaf, at = [], 0, 0
        for k, n in enumerate(tree["block_leaves"]):
            size = self.tree.chars[self.tree.size + k]
            self.blocks.append(Kept(text[at : at + size], chars[leaf : leaf + n], tokens[leaf : leaf + n]))
            leaf, at = leaf + n, at + size
        return self

    def _block(self, at: int) -> list[tuple[str, int]]:
        """A block's leaves, cut from the text if they are not yet."""
        if isinstance(self.blocks[at], Kept):
            self.blocks[at] = self.blocks[at].cut()
        return self.blocks[at]

    def state(self) -> dict:
        """Leaves, blocks and sums, from which ``kept`` makes the tree again."""
        return {
            "leaf_chars": [n for b in self.blocks for n in (b.chars.tolist() if isinstance(b, Kept) else [len(w) for w, _ in b])],
            "leaf_tokens": [n for b in self.blocks for n in (b.tokens.tolist() if isinstance(b, Kept) else [n for _, n in b])],
            "block_leaves": [len(b.chars) if isinstance(b, Kept) else len(b) for b in self.blocks],
            "sum_chars": self.tree.chars,
            "sum_tokens": self.tree.tokens,
        }

    def _read_by(self, text: str) -> None:
        """How the text is split."""
        narrow = bool(_PLAIN.fullmatch(text))
        self.split = _SPLIT if narrow else _WIDE_SPLIT
        self.plain = SPECIAL not in text and (narrow or not _UNASSIGNED.search(text))

    def _sum(self) -> None:
        sums = [
            (len(b.text), int(b.tokens.sum())) if isinstance(b, Kept) else (sum(len(w) for w, _ in b), sum(n for _, n in b))
            for b in self.blocks
        ]
        self.tree = SumTree([c for c, _ in sums], [n for _, n in sums])

    def _leaves(self, text: str) -> list[tuple[str, int]]:
        if not text:
            return []
        if not self.plain:  # the added token or unassigned characters: one leaf, encoded by the tokenizer itself
            return [(text, len(self.encode.ids(text)) // 4)]
        return [(w, len(self.encode[w]) // 4) for w in self.split.findall(text)]

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    @property
    def chars(self) -> int:
        return self.tree.chars[1]

    def text(self) -> str:
        return "".join(b.text if isinstance(b, Kept) else "".join([w for w, _ in b]) for b in self.blocks)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` in place of start:end; returns the characters that were encoded again."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        narrow = bool(_PLAIN.fullmatch(new))
        if not narrow:
            self.split = _WIDE_SPLIT
        if not self.plain or not narrow and _UNASSIGNED.search(new) or self._makes_special(start, end, new):
            text = self.text()
            encoded = self.encoded_chars
            self.__init__(text[:start] + new + text[end:], self.encode)
            self.encoded_chars += encoded
            return self.chars
        first, at = self.tree.find(start)
        last, last_at = self.tree.find(max(start, end - 1))
        # Take in whole blocks until two leaves of context lie before the first touched leaf.
        low, low_at = first, at
        while low > 0 and self._leaf_of(low, low_at, start) < 2:
            low -= 1
            low_at -= self.tree.chars[low + self.tree.size]
        leaves = [x for b in range(low, last + 1) for x in self._block(b)]
        high = last + 1
        # Leaves before the context stay as they are.
        place, i = low_at, 0
        while i < len(leaves) and place + len(leaves[i][0]) <= start:
            place += len(leaves[i][0])
            i += 1
        keep = max(0, i - 2)
        place -= sum(len(w) for w, _ in leaves[keep:i])
        head, rest = leaves[:keep], leaves[keep:]
        text = "".join(w for w, _ in rest)
        changed = text[: start - place] + new
        tail = text[end - place :]
        # Old boundaries after the edit, by their distance from its end.
        bounds, total = {}, 0
        for k in range(len(rest) - 1, -1, -1):
            bounds[total] = k + 1
            total += len(rest[k][0])
        while True:
            whole = changed + tail
            pieces, done, agreed, cut = [], 0, 0, None
            for m in self.split.finditer(whole):
                pieces.append(m.group())
                done = m.end()
                left = len(whole) - done
                old = bounds.get(left)
                same = done - len(pieces[-1]) >= len(changed) and old and rest[old - 1][0] == pieces[-1]
                agreed = agreed + 1 if same else 0
                if agreed == 2:
                    cut = old
                    break
            if cut is not None or high == len(self.blocks):
                break
            # The text ran out before the split came back to old boundaries: take in another block.
            more = self._block(high)
            high += 1
            added = sum(len(w) for w, _ in more)
            bounds = {d + added: k for d, k in bounds.items()}
            rest = rest + more
            total = 0
            for k in range(len(rest) - 1, len(rest) - 1 - len(more), -1):
                bounds[total] = k + 1
                total += len(rest[k][0])
            tail += "".join(w for w, _ in more)
        fresh = [(w, len(self.encode[w]) // 4) for w in pieces]
        encoded = sum(map(len, pieces))
        leaves = head + fresh + (rest[cut:] if cut is not None else [])
        self.encoded_chars += encoded
        if high - low == 1 and 0 < len(leaves) <= 2 * BLOCK:
            self.blocks[low] = leaves
            self.tree.set(low, sum(len(w) for w, _ in leaves), sum(n for _, n in leaves))
        else:
            self.blocks[low:high] = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)]
            self.blocks = self.blocks or [[]]
            self._sum()
        return encoded

    def _makes_special(self, start: int, end: int, new: str) -> bool:
        """Whether an edit puts the added token's text together."""
        n = len(SPECIAL) - 1
        return SPECIAL in self._part(max(0, start - n), start) + new + self._part(end, end + n)

    def _part(self, start: int, end: int) -> str:
        block, at = self.tree.find(start)
        out = []
        while block < len(self.blocks) and at < end:
            for w, _ in self._block(block):
                out.append(w[max(0, start - at) : max(0, end - at)])
                at += len(w)
            block += 1
        return "".join(out)

    def _leaf_of(self, block: int, at: int, char: int) -> int:
        """How many leaves from this block on end at or before a character, 2 at most."""
        n = 0
        for b in range(block, len(self.blocks)):
            for w, _ in self._block(b):
                at += len(w)
                if at > char:
                    return n
                n += 1
                if n == 2:
                    return n
        return n


EDIT = "array<struct<start:long,end:long,new:string>>"
TREE = "struct<leaf_chars:array<int>,leaf_tokens:array<int>,block_leaves:array<int>,sum_chars:array<long>,sum_tokens:array<long>>"
PARTS = {"leaf_chars": pa.int32(), "leaf_tokens": pa.int32(), "block_leaves": pa.int32(), "sum_chars": pa.int64(), "sum_tokens": pa.int64()}
COUNTS = ["n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "chars_encoded_again"]


def _trees(states: list[dict]) -> pa.Array:
    """Trees as an Arrow column."""
    columns = []
    for name, kind in PARTS.items():
        parts = [np.asarray(s[name], dtype=kind.to_pandas_dtype()) for s in states]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind)))
    return pa.StructArray.from_arrays(columns, list(PARTS))


def _tree(trees: pa.StructArray, row: int) -> dict | None:
    if not trees[row].is_valid:
        return None
    found = {name: trees.field(name)[row].values.to_numpy(zero_copy_only=False) for name in PARTS}
    return found | {name: found[name].tolist() for name in ("block_leaves", "sum_chars", "sum_tokens")}


def _build(text_at: int, ranks_file: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file or default_ranks())
        for batch in batches:
            begun, states, held = 0, [], 0
            for row, text in enumerate(batch.column(text_at)):
                state = CountedText(text.as_py() or "", encode).state()
                states.append({name: np.asarray(state[name], dtype=kind.to_pandas_dtype()) for name, kind in PARTS.items()})
                held += len(state["leaf_chars"])
                if held >= BATCH_LEAVES or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(begun, len(states)).columns, _trees(states)], names=[*batch.schema.names, "tree"]
                    )
                    begun, states, held = row + 1, [], 0

    return run


def count_trees(docs: DataFrame, text_col: str = "text", tree_col: str = "tree", ranks_file: str | None = None) -> DataFrame:
    """The rows with each text's tree, whose ``sum_tokens[1]`` is the text's number of tokens."""
    rows = docs.drop(tree_col)
    given = [f"c{k}" for k in range(len(rows.columns))]
    plain = rows.toDF(*given)
    schema = T.StructType([*plain.schema.fields, *T.StructType.fromDDL(f"tree {TREE}").fields])
    out = plain.mapInArrow(_build(rows.columns.index(text_col), ranks_file), schema)
    return out.toDF(*rows.columns, tree_col)


def _edit(ranks_file: str | None, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file or default_ranks())
        for batch in batches:
            ids, texts, trees, edits = batch.columns
            begun, rows, after, held = 0, [], [], 0
            for row in range(batch.num_rows):
                todo = [e for e in edits[row].as_py() or [] if e is not None]
                sums = trees.field("sum_tokens")[row].values if trees[row].is_valid else None
                if sums is not None and not todo:
                    n_chars = trees.field("sum_chars")[row].values[1].as_py()
                    before = sums[1].as_py()
                    rows.append((before, 0, before, n_chars, 0))
                    text, tree = texts[row].as_py() if keep else None, _tree(trees, row) if keep else None
                else:
                    text, tree = texts[row].as_py() or "", _tree(trees, row)
                    counted = CountedText(text, encode) if tree is None else CountedText.kept(text, tree, encode)
                    before = counted.tokens
                    encoded = sum(counted.replace(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in todo)
                    rows.append((before, len(todo), counted.tokens, counted.chars, encoded))
                    text, tree = (counted.text(), counted.state()) if keep else (None, None)
                if keep:
                    after.append((text, {name: np.asarray(tree[name], dtype=kind.to_pandas_dtype()) for name, kind in PARTS.items()}))
                    held += len(tree["leaf_chars"])
                if held >= BATCH_LEAVES or row + 1 == batch.num_rows:
                    made = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    if keep:
                        made = [pa.array([t for t, _ in after], pa.string()), _trees([t for _, t in after]), *made]
                    names = ["id", *(["text", "tree"] if keep else []), *COUNTS]
                    yield pa.RecordBatch.from_arrays([ids.slice(begun, len(rows)), *made], names=names)
                    begun, rows, after, held = row + 1, [], [], 0

    return run


def _edited(trees: DataFrame, id_col: str, text_col: str, edits_col: str, tree_col: str, ranks_file: str | None, keep: bool) -> DataFrame:
    rows = trees.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(tree_col).cast(TREE).alias("tree"), F.col(edits_col).cast(EDIT).alias("edits")
    )
    kind = rows.schema["id"].dataType.simpleString()
    kept = f"text string, tree {TREE}, " if keep else ""
    out = rows.mapInArrow(_edit(ranks_file, keep), f"id {kind}, {kept}" + ", ".join(f"{c} long" for c in COUNTS))
    return out.toDF(id_col, *([text_col, tree_col] if keep else []), *COUNTS)


def edit_trees(
    trees: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tree_col: str = "tree", ranks_file: str | None = None
) -> DataFrame:
    """Each document's text and tree after its edits, with the counts of ``edited_counts``.

    The rows can be written and given other edits later; only what those touch is encoded.
    """
    return _edited(trees, id_col, text_col, edits_col, tree_col, ranks_file, True)


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", ranks_file: str | None = None) -> DataFrame:
    """Tokens before and after each document's edits, and the characters that the edits caused to be encoded.

    ``edits_col`` is array<struct<start, end, new>>, in order, in characters of the text that the last one left.
    Trees are written to the shared folder first and read again with the edits.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).cast(EDIT).alias("edits"))
    trees = Scratch(docs.sparkSession).save(count_trees(rows, ranks_file=ranks_file), "trees")
    return _edited(trees, "id", "text", "edits", "tree", ranks_file, False).withColumnRenamed("id", id_col)


def derived_edits(id_col: str, text_col: str):
    """Edits made from the document itself, as a cleaning pass would make them: of every three documents one
    loses its first ten characters, one has a stretch in the middle replaced and a line added, one stays."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    middle = F.floor(n / 2)
    kind = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(3))

    def edit(start, end, new: str):
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("new"))

    cut = F.array(edit(F.lit(0), F.lit(10), ""))
    changed = F.array(edit(F.greatest(middle - 15, F.lit(0)), middle, " [removed] "), edit(n * 2, n * 2, "\nend of text"))
    return F.when(kind == 0, cut).when(kind == 1, changed).otherwise(F.array().cast(EDIT))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edited_counts(docs.withColumn("edits", derived_edits("doc_id", "text")))
