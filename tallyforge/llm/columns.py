"""Column expressions that the native operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every leftmost non-overlapping match, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def indices(first, last: Column, step: int = 1) -> Column:
    """first..last by step; empty where last < first."""
    first = F.lit(first)
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def named(value: Column, use) -> Column:
    """use(value), with the value computed once a row even where it is used inside another lambda."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, block: int, start: Column, total, put, ended, rows) -> Column:
    """A running scan over an array in time linear in its length, for arrays of up to block**2 items or so.

    ``total(block)`` is what a block adds to the state and ``put(state, total)``
    the state after it; ``rows(block, state, next state)`` gives the block's
    results from the state before it. States pass from block to block, so no
    array grows with every item. ``ended(results, last state)`` makes the answer.
    """

    def over(blocks: Column) -> Column:
        states = F.aggregate(
            F.transform(blocks, total),
            F.array(start),
            lambda a, x: F.concat(a, F.array(put(F.element_at(a, -1), x))),
        )
        return named(
            states,
            lambda s: ended(
                F.transform(blocks, lambda b, i: rows(b, F.get(s, i), F.get(s, i + 1))),
                F.element_at(s, -1),
            ),
        )

    return named(items, lambda x: named(F.transform(indices(0, F.size(x) - 1, block), lambda i: F.slice(x, i + 1, block)), over))


def covered_words(positions: Column, width: int) -> Column:
    """How many words lie in windows of ``width`` words that begin at the sorted positions."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        positions,
        start,
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(width), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )


def long_array(values) -> Column:
    """A constant array<bigint>, folded to one literal when the query is planned."""
    values = [int(v) for v in values]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def bit_is_set(bits: Column, n_bits: int, hashed: Column) -> Column:
    """Whether the bit a 64-bit hash points at is set; n_bits is a power of two of 64 or more."""
    at = hashed.bitwiseAND(F.lit(n_bits - 1))
    word = F.get(bits, F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few constant rows as a plan of constants; no Python worker makes them."""
    struct = T.StructType.fromDDL(schema)
    data = json.dumps([dict(zip(struct.names, r, strict=True)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(data), T.ArrayType(struct))))


def content_hash(*names: str) -> Column:
    """Tells apart rows of one id by what they hold."""
    return F.xxhash64(*[F.col(n) for n in names])


def without(docs: DataFrame, rejected: DataFrame, id_col: str, content: Column) -> DataFrame:
    """The rows of docs but for those with the id and the content hash of a rejected row.

    Only ids and hashes of rejected rows are moved to the documents, if they are few.
    """
    gone = rejected.select(F.col(id_col).alias("_gone"), F.col("content_hash").alias("_hash")).distinct()
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (content == gone["_hash"])
    return docs.join(gone, same, "left_anti")
