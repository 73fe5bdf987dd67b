"""Benchmark decontamination (operator 3), as DataFrame expressions only.

A window is 13 consecutive words of a benchmark item, or all words of a shorter
item. The set of normalised windows is a broadcast hash set; a document's words
in any occurrence of a window are hit. Three steps, each exact after the last:

1. Anchors. A window of L words holds, at one of its first few places, a gram of
   ``(L + 1) // 2`` words that begins at a multiple of ``L - gram + 1`` in the
   document. Only these grams are hashed and looked up in a bit set of the
   benchmark's grams, so most texts are passed over after a few look-ups.
2. Windows. Documents with an anchor look up the hash of every window.
3. Verification. Windows that remain are written out as text and joined with
   the benchmark's windows by their words.

The bit sets are constants of the plan. A benchmark of more windows than
``MAX_BITS`` allows for is dealt into shards, runs of ``RUN`` windows of an item
staying together; each shard is one pass over the texts by the same three
steps, and the passes' hits are put together.

Defined results: a null text has no words; a document or item without words
hits nothing; repeated items count under each of their ids; rows are judged by
id and content, so rows with a null or repeated id get what their own text
gives, and equal rows equal results; windows of any place and length that
overlap count a word once; a very long text is taken whole, with one hash a word
and one number a listed window; an empty benchmark hits nothing; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.columns import LOWER, UPPER, bit_is_set, content_hash, indices, long_array, matches, text_or_empty, without
from tallyforge.llm.scratch import Scratch

#: ASCII letters and digits, and everything beyond ASCII; either case, as lower-casing follows.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Bits of one shard's set of windows, and windows of an item that stay in one shard.
MAX_BITS = 1 << 22
BITS_EACH = 32
RUN = 4096


@dataclass(frozen=True)
class BitSet:
    n_bits: int
    words: list[int]

    def has(self, hashed: Column) -> Column:
        return bit_is_set(long_array(self.words), self.n_bits, hashed)


def bit_set(hashes: DataFrame) -> BitSet:
    """The column ``h`` as a bit set of ``BITS_EACH`` bits a value or more."""
    n_bits = max(64, 1 << max(1, hashes.count() * BITS_EACH - 1).bit_length())
    at = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    rows = (
        hashes.select(F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    )
    words = [0] * (n_bits // 64)
    for row in rows.collect():
        words[row["word"]] = row["bits"]
    return BitSet(n_bits, words)


def _hashes(words: Column) -> Column:
    """Word hashes; full lower-casing only widens the candidates, which are compared exactly later."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _gram(hashes: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])


def _gram_size(length: int) -> tuple[int, int]:
    """(words in an anchor gram, distance between places where grams are taken)."""
    gram = (length + 1) // 2
    return gram, length - gram + 1


def _text(words: Column, first: Column, n: int) -> Column:
    return F.translate(F.array_join(F.slice(words, first + 1, n), " "), UPPER, LOWER)


def benchmark_windows(items: DataFrame, scratch: Scratch, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(length, window, item, run, hashes): the windows of every item, its run and its word hashes."""
    words = items.select(F.col(id_col).alias("item"), matches(text_or_empty(text_col), WORDS).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("hashes", _hashes(F.col("words")))
    words = words.withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))
    placed = words.select("item", "length", "words", "hashes", F.explode(indices(0, F.size("words") - F.col("length"))).alias("i"))
    full = F.translate(F.array_join(F.slice("words", F.col("i") + 1, F.col("length")), " "), UPPER, LOWER)
    part = F.slice("hashes", F.col("i") + 1, F.col("length"))
    run = F.xxhash64("item", F.floor(F.col("i") / RUN)).alias("run")
    return scratch.save(placed.select("item", "length", full.alias("window"), run, part.alias("hashes")), "windows")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, content_hash.

    The hash of the text tells apart rows that share an id.
    """
    scratch = Scratch(docs.sparkSession)
    bench = benchmark_windows(items, scratch, item_id_col, item_text_col)
    texts = docs.select(
        F.col(id_col).alias("_id"),
        content_hash(text_col).alias("content_hash"),
        matches(text_or_empty(text_col), WORDS).alias("_words"),
    )
    shards = max(1, -(-bench.count() // max(1, MAX_BITS // BITS_EACH)))
    passes = []
    for k in range(shards):
        part = _candidates(texts, bench.where(F.pmod("run", F.lit(shards)) == k))
        # The first pass keeps every row, the others what they found.
        passes.append(scratch.save(part if k == 0 else part.where(F.size("_windows") > 0), f"pass-{k}"))
    rows = passes[0]
    hits = reduce(DataFrame.unionByName, [p.where(F.size("_windows") > 0) for p in passes])
    hits = hits.select("_id", "content_hash", F.inline("_windows")).join(
        bench.select("length", "window", "item"), ["length", "window"]
    )
    # A group is one text's hits, bounded by its own words and by the benchmark's items.
    covered = (
        hits.groupBy("_id", "content_hash")
        .agg(
            F.sort_array(F.collect_set(F.struct("i", "length"))).alias("at"),
            F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
        )
        .select(F.col("_id").alias("_hit"), F.col("content_hash").alias("_hash"), _covered(F.col("at")).alias("n_hit"), "items")
    )
    same = rows["_id"].eqNullSafe(covered["_hit"]) & (rows["content_hash"] == covered["_hash"])
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(covered, same, "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "content_hash",
    )


def _candidates(texts: DataFrame, bench: DataFrame) -> DataFrame:
    """_id, content_hash, n_words and the places that a shard's bit sets pass, each with its words."""
    lengths = sorted(r["length"] for r in bench.select("length").distinct().collect())  # WINDOW values at most
    anchors: dict[int, BitSet] = {}
    whole: dict[int, BitSet] = {}
    for n in lengths:
        own = bench.where(F.col("length") == n)
        gram, _ = _gram_size(n)
        grams = own.select(F.explode(F.transform(indices(0, F.lit(n - gram)), lambda i: _gram(F.col("hashes"), i, gram))).alias("h"))
        anchors[n] = bit_set(grams.distinct())
        whole[n] = bit_set(own.select(_gram(F.col("hashes"), F.lit(0), n).alias("h")).distinct())
    step = texts.select("_id", "content_hash", "_words", F.size("_words").alias("_n"), _hashes(F.col("_words")).alias("_h"))
    h, size = F.col("_h"), F.col("_n")
    maybe = F.lit(False)
    for n in lengths:
        gram, distance = _gram_size(n)
        maybe = maybe | ((size >= n) & F.exists(indices(0, size - gram, distance), _listed(anchors[n], h, gram)))
    found = [F.transform(F.filter(indices(0, size - n), _listed(whole[n], h, n)), _written_out(n)) for n in lengths]
    empty = F.array().cast("array<struct<length:int,i:int,window:string>>")
    step = step.withColumn("_maybe", maybe)
    windows = F.when(F.col("_maybe"), F.concat(*found)).otherwise(empty) if found else empty
    return step.select("_id", "content_hash", size.cast("long").alias("n_words"), windows.alias("_windows"))


def _listed(known: BitSet, hashes: Column, n: int):
    return lambda i: known.has(_gram(hashes, i, n))


def _written_out(n: int):
    return lambda i: F.struct(F.lit(n).alias("length"), i.alias("i"), _text(F.col("_words"), i, n).alias("window"))


def _covered(at: Column) -> Column:
    """Words in the union of sorted (i, length) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        at,
        start,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["i"] + s["length"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), s["i"] + s["length"] - F.greatest(a["end"], s["i"]))).alias("total"),
        ),
        lambda a: a["total"],
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ).drop("content_hash")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns: the pipeline's third stage.

    Rows go by id and content, so of rows that share an id only those with a
    contaminated text go, and repeated rows stay or go together. Null and empty
    texts, which hit nothing, stay; very long texts are judged whole; no rows
    give none; without items all rows stay. Other columns are kept, whatever
    their names.
    """
    return without(docs, contamination(docs, items).where("contaminated"), "doc_id", content_hash("text"))


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP3_SQL = f"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM item_words WHERE len(w) > 0),
spots AS (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM sized),
bench AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM spots),
lengths AS (SELECT DISTINCT n FROM bench),
places AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM doc_words, lengths WHERE len(w) >= n),
hits AS (
  SELECT r, i, p.n, item_id FROM (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM places) p
  JOIN bench b ON p.n = b.n AND p.win = b.win),
spans AS (SELECT DISTINCT r, i, n FROM hits),
pos AS (SELECT r, unnest(range(i, i + n)) AS p FROM spans),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM pos GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
