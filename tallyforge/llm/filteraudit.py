"""Filter interaction audit (operator 12): what each filter removes in every order of a set of filters.

A document's failures are a bit mask, so a part of the corpus (a language) is
told by at most 2**k cells: documents, good and toxic ones for each mask. Spark
finds the cells; what follows needs nothing else. All k! orders are then walked
by swaps of neighbours (each order differs from the one before in two
neighbouring filters). A swap changes what those two steps remove and what is
kept between them, and nothing before or after, so only these are summed anew
from the cells. A filter's Shapley sum is carried along: what it removed counts
for as many orders as it stayed unchanged.

Texts are read once. Duplicates are found by the SHA-256 of the text, which is
written with the mask; the smallest id of each text comes from a partial
aggregate, so a text that a third of all rows repeat is one row a task, and the
join back is by text and id together. Parts are grouped with at most 2**k cells
each and walked in the tasks, some hundred at a time.

Defined results: a null text is an empty one, and identical to it; a null part
is the empty string. A row without an id is no copy, makes none
and has no label; rows of the
same id and text are no copies of each other. Several labels of an id: it is
good (toxic) if one says so; without labels it is neither. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.columns import matches, text_or_empty
from tallyforge.llm.scratch import Scratch

GAP = r"[\x20\x09-\x0D]+"
TALLIES = ["n", "good", "toxic"]
#: Parts that a task walks together.
TOGETHER = 100

OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by the filter's letter."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.size(matches(text, "[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def swaps(k: int) -> Iterator[int]:
    """Positions i whose swap with i + 1 leads through all orders of k things, each once."""
    order, way = list(range(k)), [-1] * k
    while True:
        movable = [
            x for i, x in enumerate(order) if 0 <= i + way[x] < k and order[i + way[x]] < x
        ]
        if not movable:
            return
        x = max(movable)
        i = order.index(x)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, k):
            way[y] = -way[y]
        yield min(i, j)


class Walk:
    """One order after another over the cells of several parts: cells[tally, part, mask]."""

    def __init__(self, cells: np.ndarray, k: int):
        self.cells, self.k, self.masks = cells, k, np.arange(1 << k)
        self.order = list(range(k))
        self.lost = np.zeros((k, *cells.shape[:2]), np.int64)  # by step
        self.kept = np.zeros((k, cells.shape[1]), np.int64)
        self.total = np.zeros((k, cells.shape[1]), np.int64)  # Shapley sums by filter
        self.since, self.visits = [0] * k, 0
        for step in range(k):
            self._step(step)

    def _step(self, i: int) -> None:
        """What step i removes, from the masks that fail it and nothing before."""
        before = sum(1 << f for f in self.order[:i])
        meets = (self.masks >> self.order[i] & 1 == 1) & (self.masks & before == 0)
        self.lost[i] = self.cells[:, :, meets].sum(axis=2)
        left = self.kept[i - 1] if i else self.cells[0].sum(axis=1)
        self.kept[i] = left - self.lost[i, 0]

    def _carry(self, i: int) -> None:
        f = self.order[i]
        self.total[f] += self.lost[i, 0] * (self.visits - self.since[f])
        self.since[f] = self.visits

    def swap(self, i: int) -> None:
        self.visits += 1
        self._carry(i)
        self._carry(i + 1)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self._step(i)
        self._step(i + 1)

    def shapley(self) -> np.ndarray:
        """After the last order."""
        self.visits += 1
        for i in range(self.k):
            self._carry(i)
        return self.total


def orders_audited(cells: np.ndarray, names: str) -> Iterator[tuple[str, int, np.ndarray]]:
    """(order, step, values[column, part]) for every order and step."""
    k = len(names)
    masks = np.arange(1 << k)
    fails = [cells[0][:, masks >> f & 1 == 1].sum(axis=1) for f in range(k)]
    walk, rows = Walk(cells, k), []

    def seen() -> None:
        order = "".join(names[f] for f in walk.order)
        for i, f in enumerate(walk.order):
            lost = walk.lost[i]
            rows.append((order, i, f, np.stack([walk.kept[i], lost[0], fails[f] - lost[0], cells[0][:, 1 << f], lost[1], lost[2]])))

    seen()
    for i in swaps(k):
        walk.swap(i)
        seen()
    shapley = walk.shapley()
    for order, i, f, values in rows:
        yield order, i + 1, np.vstack([values, shapley[f]])


def _audited(names: str):
    schema = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                parts = some.column("part")
                cells = np.zeros((len(TALLIES), len(parts), 1 << len(names)), np.int64)
                for p, found in enumerate(some.column("cells").to_pylist()):
                    for c in found:
                        cells[:, p, c["mask"]] = [c[t] for t in TALLIES]
                for order, step, values in orders_audited(cells, names):
                    same = [pa.array([x] * len(parts), t) for x, t in ((order, pa.string()), (step, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([parts, *same, *map(pa.array, values)], names=schema)

    return run


def audit(judged: DataFrame, names: str) -> DataFrame:
    """Every order and step for rows of (part, mask, good, toxic); bit i of the mask is a failure of names[i]."""
    sums = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in TALLIES[1:]]]
    cells = judged.groupBy("part", "mask").agg(*sums)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *TALLIES)).alias("cells"))  # 2**k at most
    return parts.mapInArrow(_audited(names), OUT)


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, good, toxic) for each document: failures of A to D by its text, of E as a later copy of one."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text")
    )
    texts = texts.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    mask = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text"), F.col("words")).values()))
    rows = scratch.save(texts.select("id", "part", mask.alias("mask"), F.sha2("text", 256).alias("sha")), "judged")
    first = rows.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        rows.join(first, ["sha", "id"], "left")
        .join(known, "id", "left")
        .select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), zero("good"), zero("toxic"))
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(judged(docs, labels), "ABCDE")


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM docs LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1 : i - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) AS r(i)),
done AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (earlier + bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM done
"""
