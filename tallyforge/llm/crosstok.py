"""Cross-tokenizer alignment (operator 11).

A text is encoded by two tokenizers, a byte-level one (A) and one of word pieces
with byte fallback (B). Byte offsets at which tokens of both end cut the text
into groups; the two tokens that end there are linked. Over the corpus, each
pair of ids has a count of links, and each B id a best count: the highest in its
row of the count matrix. Documents are then scored by the counts of their links.

How it runs:

* Texts are encoded where they lie, in units that both tokenizers treat
  alone (between two visible characters, a single space starts a token of either
  and a line break is one), so a worker remembers units. Links leave a task packed: a run of documents
  gives one row for each stripe of B ids, with pairs, document and multiplicity
  in sorted narrow arrays. These rows and the documents' digests are written.
* B ids are dealt to stripes by their remainder. A stripe's links are dealt to
  parts of bounded size, so a frequent id, even one with a third of all links,
  does not meet in one task. Each part adds its pairs with ``np.add.at`` into a
  dense block (ids of the stripe x ids of A) and gives its non-zero cells, which
  Spark sums over the parts.
* For scoring, the cells of a stripe go to each of its parts, where the links
  are. The block is filled once more, row maxima give the best counts, and the
  links look theirs up. A document's sums are added up by its number.

A block takes ``rows x |A| x 8`` bytes, 51 MB here, whatever the corpus. What
reaches the driver is the number of links a stripe (at most a few hundred rows).

Defined results: texts that are null or empty, or that the tokens of A or B do
not spell byte for byte (after the leading space), have zeros and an empty
digest, and link nothing. Rows with a null or repeated id are documents of their
own. Equal highest counts are all best. Other columns are ignored. An empty
table gives no rows. A text is handled in slices; only a stretch without a
single space between visible characters must be encoded at once.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.scratch import Scratch
from tallyforge.llm.texts import Recent, byte_level, slices

#: B ids of a stripe.
STRIPE_ROWS = 128
#: Links that a part of a stripe holds, about.
PART_LINKS = 8_000_000
#: Links after which a task hands on what it has gathered, and documents that it may span (16 bits).
FLUSH_LINKS, FLUSH_DOCS = 1 << 20, 1 << 16
#: Units, and pieces of units, in a generation of what a worker remembers.
REMEMBERED = 200_000

#: A space where a token of either tokenizer starts, whatever stands around.
GAP = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: Before such a space, or a line break that is a token of its own in both.
UNIT = re.compile(r"(?<=[!-~\w])(?=[ \n][!-~\w])")
#: Characters on which Python's classes agree with A's pre-tokenizer: ASCII but 0x1C-0x1F, and the letters of
#: Latin-1 and Latin Extended-A/B. Its pattern (fixed value), in Python's classes.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Units that are cut further, where only the first sign may be a space or line break: at changes of kind, but for an
#: apostrophe before letters, as A takes some of them together.
LETTER = re.compile(r"[^\W\d_]")
WORDS = re.compile(r"[ \n]?[!-~À-ÖØ-öø-ɏ]+")
UNIT_PIECES = re.compile(r"\n|'[^\W\d_]+| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+")
MISSPELT = (b"", b"", -1, -1)
DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PACKED = "stripe int, base long, links long, b binary, a binary, doc binary, times binary"


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def kind_of(character: str) -> str:
    return "letter" if LETTER.match(character) else "digit" if character.isdigit() else "other"


class Vocabularies:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        as_byte = byte_level()
        added = self.a.get_added_tokens_decoder()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if i in added else bytes(as_byte[c] for c in token)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces
        ]
        if not (all(self.a_bytes) and all(self.b_bytes)):
            raise ValueError("every token must have bytes")
        #: Units may be encoded alone if no piece goes on over a word's end.
        self.split = all("▁" not in p.lstrip("▁") for _, p in pieces)
        #: So may letters, digits and other signs of a plain word, if no piece of such signs has two of these kinds.
        own = [p.lstrip("▁") for i, p in pieces if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.finer = self.split and all(len(set(map(kind_of, p))) < 2 for p in own if WORDS.fullmatch(p))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]


class Aligner:
    """Aligns texts unit by unit, and remembers units and their pieces.

    A unit starts with the space or line break before it. What is known of it:
    its groups as text, linked pairs as 64-bit codes, and the tokens of A and B;
    nothing where the bytes differ.
    """

    def __init__(self, a_file: str, b_file: str):
        self.v = Vocabularies(a_file, b_file)
        self.a_size = len(self.v.a_bytes)
        self._known = Recent(REMEMBERED)
        self._model = self.v.a.model
        self._char = {b: c for c, b in byte_level().items()}
        self._lengths = [list(map(len, x)) for x in (self.v.a_bytes, self.v.b_bytes)]
        self._names = [list(map(str, range(len(x)))) for x in (self.v.a_bytes, self.v.b_bytes)]

    def units(self, part: str) -> list[str]:
        """Units of a slice after a space, each with the space or line break that it starts with."""
        return UNIT.split(" " + part) if self.v.split else [" " + part]

    def _ids_a(self, unit: str) -> list[int]:
        """Ids of a unit by A; a plain one's pre-tokens go to the tokenizer's model."""
        if not PLAIN.fullmatch(unit):
            return self.v.encode_a([unit])[0]
        spelt = ("".join(map(self._char.__getitem__, x.encode())) for x in PIECES.findall(unit))
        return [t.id for x in spelt for t in self._model.tokenize(x)]

    def _unit(self, unit: str, b: list[int]):
        a, bytes_a, bytes_b = self._ids_a(unit), self.v.a_bytes, self.v.b_bytes
        raw = unit.encode()
        if b"".join([bytes_a[i] for i in a]) != raw or b"".join([bytes_b[i] for i in b]) != raw:
            return None
        (size_a, size_b), (name_a, name_b) = self._lengths, self._names
        groups, codes, own_a, own_b, at_a, at_b, k = [], array("q"), [], [], 0, 0, 0
        for i in a:
            at_a += size_a[i]
            own_a.append(name_a[i])
            while at_b < at_a:
                j = b[k]
                at_b += size_b[j]
                own_b.append(name_b[j])
                k += 1
            if at_a == at_b:
                groups.append(f"{','.join(own_a)}|{','.join(own_b)}")
                codes.append(j * self.a_size + i)
                own_a, own_b = [], []
        return ";".join(groups).encode(), codes.tobytes(), len(a), len(b)

    def _encoded_b(self, units: list[str]) -> Iterator[list[int]]:
        """B puts a space before each text; a unit without one is encoded after a line break, which stands alone."""
        spelt = [u[1:] if u[0] == " " else "\n" + u for u in units]
        ids = self.v.b.encode(spelt, num_threads=1)
        return (x if u[0] == " " else x[2:] for u, x in zip(units, ids, strict=True))

    def _learn(self, units: list[str]) -> dict[str, tuple]:
        """What new units give; those of several kinds of signs are put together from their pieces, which are remembered alike."""
        known, made = self._known, {}
        cut = {u: UNIT_PIECES.findall(u) if self.v.finer and WORDS.fullmatch(u) else [u] for u in units}
        new = [p for p in dict.fromkeys(p for x in cut.values() for p in x) if p not in known.young and known.again(p) is None]
        for p, ids in zip(new, self._encoded_b(new), strict=True):
            made[p] = x = self._unit(p, ids) or MISSPELT
            if len(p) <= 64:
                known.keep(p, x)
        for u, pieces in cut.items():
            if u in made:
                continue
            fresh = False
            found = []
            for p in pieces:
                x = made.get(p)
                fresh = fresh or x is not None
                found.append(x or known.young.get(p) or known.old.get(p))
            if MISSPELT in found:
                x = MISSPELT
            else:
                groups, codes, n_a, n_b = zip(*found, strict=True)
                x = b";".join(groups), b"".join(codes), sum(n_a), sum(n_b)
            made[u] = x
            # A unit with a new piece is likely to be rare; it is remembered if it comes again.
            if not fresh and len(u) <= 64:
                known.keep(u, x)
        return made

    def parts(self, part: str) -> list:
        """What the units of a text's slice give, in order."""
        units = self.units(part)
        found = list(map(self._known.young.get, units))
        if None in found:
            again = self._known.again
            found = [again(u) if x is None else x for u, x in zip(units, found, strict=True)]
            if None in found:
                made = self._learn([u for u, x in zip(units, found, strict=True) if x is None])
                found = [made[u] if x is None else x for u, x in zip(units, found, strict=True)]
        return found

    def slices(self, text: str) -> Iterator[str]:
        return slices(text, GAP) if self.v.split else iter([text])

    def align(self, text: str) -> Iterator[tuple[bytes, bytes, int, int]]:
        """Per slice: groups, codes and token counts; nothing where the text is not spelt by both."""
        if not text:
            return
        parts = list(self.slices(text))
        if len(parts) > 1 and any(x is MISSPELT for p in parts for x in self.parts(p)):
            return
        for p in parts:
            found = self.parts(p)
            if MISSPELT in found:
                return
            groups, codes, n_a, n_b = zip(*found, strict=True)
            yield b";".join(groups), b"".join(codes), sum(n_a), sum(n_b)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One a Python worker and pair of files."""
    key = a_file, b_file
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


class Packer:
    """Gathers links of documents and packs them by stripes."""

    def __init__(self, a_size: int, stripes: int):
        self.a_size, self.stripes, self.base = a_size, stripes, None
        self.keys, self.held = [], 0

    def full(self, number: int) -> bool:
        return self.held >= FLUSH_LINKS or self.base is not None and not 0 <= number - self.base < FLUSH_DOCS

    def add(self, number: int, codes: np.ndarray) -> None:
        if self.base is None:
            self.base = number
        self.keys.append(codes * FLUSH_DOCS + (number - self.base))
        self.held += len(codes)

    def flush(self) -> list[tuple]:
        keys, times = np.unique(np.concatenate(self.keys), return_counts=True)
        code, doc = np.divmod(keys, FLUSH_DOCS)
        b, a = np.divmod(code, self.a_size)
        stripe = b % self.stripes
        order = np.argsort(stripe, kind="stable")
        first = np.searchsorted(stripe[order], np.arange(self.stripes + 1))
        local, a, doc, times = (x[order] for x in (b // self.stripes, a, doc, times))
        wide = np.dtype("<u2") if self.a_size <= 1 << 16 else np.dtype("<u4")
        rows = []
        for s in np.flatnonzero(np.diff(first)):
            x = slice(first[s], first[s + 1])
            arrays = (local[x].astype("<u2"), a[x].astype(wide), doc[x].astype("<u2"), times[x].astype("<u4"))
            rows.append((int(s), self.base, int(times[x].sum()), *(y.tobytes() for y in arrays)))
        self.keys, self.held, self.base = [], 0, None
        return rows


def _encode(files: tuple[str, str] | None, stripe_rows: int, schema: pa.Schema):
    """(id, number, text) -> rows of documents and packed rows, in one schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*(files or default_files()))
        packer = Packer(align.a_size, -(-len(align.v.b_bytes) // stripe_rows))

        def links(rows: list[tuple]) -> pa.RecordBatch:
            columns = dict(zip(schema.names[-7:], zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in schema],
                schema=schema,
            )

        for batch in batches:
            numbers, texts, docs = batch.column("n").to_pylist(), batch.column("text"), []
            for i, number in enumerate(numbers):
                digest, n_a, n_b, n_links = hashlib.sha256(), 0, 0, 0
                for groups, codes, x, y in align.align(texts[i].as_py() or ""):
                    if packer.full(number):
                        yield links(packer.flush())
                    if n_links:
                        digest.update(b";")
                    digest.update(groups)
                    codes = np.frombuffer(codes, np.int64)
                    packer.add(number, codes)
                    n_a, n_b, n_links = n_a + x, n_b + y, n_links + len(codes)
                docs.append((n_a, n_b, n_links, n_links, digest.hexdigest() if n_links else ""))
            columns = [batch.column("id"), batch.column("n"), *map(pa.array, zip(*docs, strict=True))] if docs else []
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, schema, strict=False)]
                    + [pa.nulls(len(docs), f.type) for f in list(schema)[len(columns) :]],
                    schema=schema,
                )
        if packer.held:
            yield links(packer.flush())

    return run


class Block:
    """The dense counts of one stripe: its B ids by A ids."""

    def __init__(self, rows: int, a_size: int):
        self.counts, self.used = np.zeros((rows, a_size), np.int64), False

    def clear(self) -> None:
        if self.used:
            self.counts[:] = 0
        self.used = False

    def add(self, b, a, n) -> None:
        np.add.at(self.counts, (b, a), n)
        self.used = True

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, a = np.nonzero(self.counts)
        return b, a, self.counts[b, a]


def _unpack(row: dict, wide: str) -> tuple[np.ndarray, ...]:
    kinds = {"b": "<u2", "a": wide, "doc": "<u2", "times": "<u4"}
    return tuple(np.frombuffer(row[k], kind) for k, kind in kinds.items() if k in row)


def _count(stripe_rows: int, a_size: int, stripes: int):
    """Packed rows, those of a part of a stripe in a row -> cells of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, wide = Block(stripe_rows, a_size), None, "<u2" if a_size <= 1 << 16 else "<u4"

        def cells() -> pa.RecordBatch:
            b, a, n = block.cells()
            stripe = at[0]
            block.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array((b * stripes + stripe).astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(n)],
                names=["b_id", "a_id", "count"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                key = row["stripe"], row["part"]
                if at is not None and key != at:
                    yield cells()
                at = key
                b, a, times = _unpack(row, wide)
                block.add(b, a, times)
        if at is not None:
            yield cells()

    return run


def _score(stripe_rows: int, a_size: int, stripes: int):
    """Cells of a part's stripe, then its packed links -> (n, n_best, count_sum) for each row's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, best, wide = Block(stripe_rows, a_size), None, None, "<u2" if a_size <= 1 << 16 else "<u4"
        for batch in batches:
            stripe, part = (batch.column(k).to_numpy() for k in ("stripe", "part"))
            cut = np.flatnonzero((np.diff(stripe) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(stripe)], strict=True):
                if lo == hi:
                    continue
                if at != (key := (stripe[lo], part[lo])):
                    block.clear()
                    at, best = key, None
                run_of = batch.slice(lo, hi - lo)
                cells = run_of.slice(0, run_of.num_rows - run_of.column("b_id").null_count)  # they come before links
                if cells.num_rows:
                    b, a, n = (cells.column(k).to_numpy() for k in ("b_id", "a_id", "count"))
                    block.add(b // stripes, a, n)
                for row in run_of.slice(cells.num_rows).select(["base", "b", "a", "doc", "times"]).to_pylist():
                    if best is None:
                        best = block.counts.max(axis=1)
                    b, a, doc, times = _unpack(row, wide)
                    count, times = block.counts[b, a], times.astype(np.int64)
                    order = np.argsort(doc, kind="stable")
                    docs, first = np.unique(doc[order], return_index=True)
                    sums = [np.add.reduceat(x[order], first) for x in (times * (count == best[b]), times * count)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs.astype(np.int64) + row["base"]), *map(pa.array, sums)], names=["n", "n_best", "count_sum"]
                    )

    return run


class Alignment:
    """A corpus's alignment: ``documents()`` and ``cells()``, from one reading of the texts."""

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        files: tuple[str, str] | None = None,
        stripe_rows: int = STRIPE_ROWS,
        part_links: int = PART_LINKS,
    ):
        self.id_col, self.scratch = id_col, Scratch(docs.sparkSession)
        vocabularies = Vocabularies(*(files or default_files()))
        self.shape = stripe_rows, len(vocabularies.a_bytes), -(-len(vocabularies.b_bytes) // stripe_rows)
        texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n"), F.col(text_col).alias("text"))
        kind = texts.schema["id"].dataType.simpleString()
        ddl = f"id {kind}, n long, {DIGEST}, {PACKED}"
        schema = docs.sparkSession.createDataFrame([], ddl).toArrow().schema
        rows = self.scratch.save(texts.mapInArrow(_encode(files, stripe_rows, schema), ddl), "rows", compression="zstd")
        self._docs = rows.where("n IS NOT NULL").select("id", "n", *[c.split()[0] for c in DIGEST.split(", ")])
        packed = rows.where("stripe IS NOT NULL").select(*[c.split()[0] for c in PACKED.split(", ")])
        size = packed.groupBy("stripe").agg(F.sum("links").alias("links")).collect()  # one row a stripe
        parts = {r["stripe"]: -(-r["links"] // part_links) for r in size}
        every = F.array(*[F.lit(parts.get(s, 1)) for s in range(self.shape[2])])
        self._parts = lambda stripe: F.get(every, stripe)
        self._links = packed.withColumn("part", F.pmod(F.xxhash64("base"), self._parts(F.col("stripe"))).cast("int"))
        self._cells = None

    def cells(self) -> DataFrame:
        """(b_id, a_id, count): the links of each pair of ids, over the corpus."""
        if self._cells is None:
            dealt = self._links.select("stripe", "part", "b", "a", "times").repartition("stripe", "part")
            partial = dealt.sortWithinPartitions("stripe", "part").mapInArrow(_count(*self.shape), "b_id int, a_id int, count long")
            self._cells = self.scratch.save(partial.groupBy("b_id", "a_id").agg(F.sum("count").alias("count")), "cells")
        return self._cells

    def best(self) -> DataFrame:
        """(b_id, a_id, count): for each B id, the A ids that it is linked with most, ties included."""
        top = self.cells().groupBy("b_id").agg(F.max("count").alias("count"))
        return self.cells().join(top, ["b_id", "count"]).select("b_id", "a_id", "count")

    def documents(self) -> DataFrame:
        """One row for each document: counts, digest of its groups, and its links' scores."""
        stripe = F.pmod("b_id", F.lit(self.shape[2])).cast("int")
        cells = self.cells().withColumn("stripe", stripe)
        cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), self._parts(F.col("stripe")).cast("int") - 1)))
        both = self._links.unionByName(cells, allowMissingColumns=True).repartition("stripe", "part")
        ordered = both.sortWithinPartitions("stripe", "part", F.col("b_id").isNull())
        scores = ordered.mapInArrow(_score(*self.shape), "n long, n_best long, count_sum long")
        scores = scores.groupBy("n").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return self._docs.join(scores, "n", "left").select(
            F.col("id").alias(self.id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
        )


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents()
