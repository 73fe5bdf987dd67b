"""Near-duplicate groups by SuperMinHash (operator 5).

1. Each text becomes the set of its distinct word shingles, as 64-bit hashes.
   Texts with the same set are one class, found by a 128-bit fingerprint; a
   class is one node, and only one of its documents goes on.
2. A SuperMinHash signature of 128 values per class. The elements give their
   ranks level by level; once every slot holds a value of an earlier level, no
   later one can lower it, so a long text needs one or two levels.
3. Banding: classes that agree in 4 values of one of 32 bands share a bucket.
   Two sets of similarity 0.8 share none with a chance of about 5e-8.
4. Verification, on full sets. Every member of a bucket is compared with the
   bucket's first and last class: a number of pairs that grows with the
   members, not with their square. Buckets of four or more whose members are
   not connected by then are finished in blocks: a task holds two blocks of a
   bucket, compares all pairs that no link connects yet, and returns links.
5. Grouping: each task reduces its links to a forest by union-find; rounds of
   large-star and small-star steps join the forests into stars, wherever the
   links lie.

No link between different sets is left out at any step: steps 1 and 4 are
exact, step 3 up to its stated chance. Links and components stay distributed.
Where a key can be hot (a bucket, a star's centre, a component, a class), the
smaller side of the join is a written table, so that Spark's adaptive skew join
splits the hot key over tasks; sums by such keys are partial first.

Defined results: a null or empty text, or one without words, has no shingles
and is its own component; ids may be of any orderable type; rows that share an
id are judged by their own texts, and a row's component is the smallest id in
its text's component; a null id has a null component and is kept; of equal
candidates the smallest id and then the smallest hash of the text represents a
group; a very long text is hashed whole, its set is held by one task at a time;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bytescan
from tallyforge.llm.columns import content_hash, without
from tallyforge.llm.scratch import Scratch

SLOTS, ROWS_PER_BAND = 128, 4
BANDS = SLOTS // ROWS_PER_BAND
#: Members of one bucket that a task compares at once, on either side.
BLOCK = 1024

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; all its words as one if they are fewer."""
    starts, ends, bounds = bytescan.words(raw, at)
    words = bytescan.hash_spans(raw, starts, ends)
    grams = words
    for k in range(1, min(width, len(words))):
        grams = bytescan.combine(grams[:-1], words[k:])
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        n = last - first
        if n >= width:
            yield np.unique(grams[first : last - width + 1])
        elif n:
            yield np.array([reduce(lambda a, b: bytescan.combine(a, b), words[first:last].reshape(-1, 1))[0]], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int = SLOTS) -> np.ndarray:
    """(n_sets, slots) signatures of many sets at once; ``owner`` gives each element's set, ascending.

    At level j an element offers j + r to the j-th place of its own random
    permutation of the slots. A set drops out once its largest slot is below
    the next level.
    """
    signature = np.full(n_sets * slots, np.inf)
    permutation = None
    for level in range(slots):
        state = bytescan.mix(elements + np.uint64((int(_GOLDEN) * (2 * level + 1)) % 2**64))
        value = level + (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = level + (bytescan.mix(state) % np.uint64(slots - level)).astype(np.int64)
        if level == 0:
            slot, first_pick = pick, pick
        else:
            if permutation is None:  # the first swap is made up for, for those that need a second level
                permutation = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(elements), 1))
                rows = np.arange(len(elements))
                permutation[rows, first_pick] = 0
                permutation[:, 0] = first_pick
            rows = np.arange(len(elements))
            slot = permutation[rows, pick].astype(np.int64)
            permutation[rows, pick] = permutation[:, level]
            permutation[:, level] = slot
        np.minimum.at(signature, owner * slots + slot, value)
        unfinished = signature.reshape(n_sets, slots).max(axis=1) >= level + 1
        on = unfinished[owner]
        if not on.any():
            break
        elements, owner = elements[on], owner[on]
        if permutation is None:
            first_pick = first_pick[on]
        else:
            permutation = permutation[on]
    return signature.reshape(n_sets, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n_sets, BANDS) 64-bit bucket keys."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, ROWS_PER_BAND)
    key = bytescan.mix(np.arange(bits.shape[1], dtype=np.uint64) + np.uint64(1)) + np.zeros((len(signature), 1), np.uint64)
    for k in range(ROWS_PER_BAND):
        key = bytescan.combine(key, bits[:, :, k])
    return key


def fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    if not len(elements):
        return 0, 0
    mixed = bytescan.mix(elements + _GOLDEN)
    return int(elements.sum(dtype=np.uint64).view(np.int64)), int((mixed ^ (mixed * _GOLDEN)).sum(dtype=np.uint64).view(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in bytescan.slices(batch.column(2)):
                sets = list(shingle_hashes(raw, at, width))
                sizes = np.array([len(s) for s in sets], np.int64)
                prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                owner = np.repeat(np.arange(len(sets)), sizes)
                full = sizes > 0
                keys = np.zeros((0, BANDS), np.uint64)
                if full.any():
                    dense = np.cumsum(full) - 1
                    keys = band_keys(super_minhash(np.concatenate(sets), dense[owner], int(full.sum())))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(sizes),
                        pa.array(prints[:, 0]),
                        pa.array(prints[:, 1]),
                        _lists(_signed(keys).ravel(), full * BANDS),
                    ],
                    names=["doc", "content", "n", "f1", "f2", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in bytescan.slices(batch.column(1)):
                sets = list(shingle_hashes(raw, at, width))
                values = _signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), _lists(values, np.array([len(s) for s in sets], np.int64))],
                    names=["id", "set"],
                )

    return run


def _union(parent: dict[int, int], a: int, b: int) -> bool:
    """Joins two nodes' trees under the smaller root; False if they were one."""
    a, b = _root(parent, a), _root(parent, b)
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


def _root(parent: dict[int, int], a: int) -> int:
    while (up := parent.get(a, a)) != a:
        parent[a] = parent.get(up, up)
        a = up
    return a


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links, reduced batch by batch: at most one link per node stays."""
    for batch in batches:
        parent: dict[int, int] = {}
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _union(parent, a, b)
        pairs = [(x, _root(parent, x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"]
        )


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): for each node of the links (a, b) the smallest node it reaches.

    Alternating large-star and small-star steps on links (u, v) with u > v,
    until a round changes no link; each round is written, so lineage stays short.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = scratch.save(edges.mapInArrow(_forest, "u long, v long").distinct(), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low-{turn}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = scratch.save(small, f"{name}-{turn}")
        # Both are sets of links, so nothing changed if none is new and none is gone.
        same = small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"{name}-{turn - 1}", f"{name}-low-{turn}")
        edges = small
        if same:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _similar(a: list[np.ndarray], b: list[np.ndarray], threshold: int) -> np.ndarray:
    """(len(a), len(b)) booleans: 100 * intersection >= threshold * union; on full sets."""
    known, inverse = np.unique(np.concatenate(a), return_inverse=True)
    rows = np.repeat(np.arange(len(a)), [len(x) for x in a])
    common = np.zeros((len(a), len(b)))
    # Columns of the left sets' elements, some at a time, keep the matrices small.
    width = max(1, (1 << 21) // max(len(a), len(b)))
    at = [np.searchsorted(known, x) for x in b]
    other = np.concatenate(at)
    hit = other < len(known)
    hit[hit] = known[other[hit]] == np.concatenate(b)[hit]
    cols = np.repeat(np.arange(len(b)), [len(x) for x in b])[hit]
    other = other[hit]
    for low in range(0, len(known), width):
        high = min(low + width, len(known))
        left = np.zeros((len(a), high - low), np.float32)
        own = (inverse >= low) & (inverse < high)
        left[rows[own], inverse[own] - low] = 1
        right = np.zeros((len(b), high - low), np.float32)
        own = (other >= low) & (other < high)
        right[cols[own], other[own] - low] = 1
        common += left @ right.T
    n_a = np.array([len(x) for x in a])[:, None]
    n_b = np.array([len(x) for x in b])[None, :]
    return 100 * common >= threshold * (n_a + n_b - common)


def _finish(threshold: int):
    """Compares what no link connects yet in one pair of blocks of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        comps = table.column("component").to_numpy()
        side = table.column("side").to_numpy()
        values = table.column("set").combine_chunks()
        values = values if isinstance(values, pa.ListArray) else values.chunk(0)
        flat, at = values.values.to_numpy(), values.offsets.to_numpy()
        sets = [flat[at[i] : at[i + 1]].view(np.uint64) for i in range(len(ids))]
        diagonal = bool((side == 2).all())
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0)
        # Within one block, members of the largest component need no comparison with each other.
        parent: dict[int, int] = {}
        out: list[tuple[int, int]] = []
        values_, counts = np.unique(comps, return_counts=True)
        main = values_[counts.argmax()]
        if diagonal:
            left = left[comps[left] != main]
        for low in range(0, len(left), 128):
            some = left[low : low + 128]
            for start in range(0, len(right), 256):
                others = right[start : start + 256]
                if (comps[some][:, None] == comps[others][None, :]).all():
                    continue
                close = _similar([sets[i] for i in some], [sets[i] for i in others], threshold)
                close &= comps[some][:, None] != comps[others][None, :]
                for i, j in zip(*np.nonzero(close), strict=True):
                    a, b = int(comps[some[i]]), int(comps[others[j]])
                    if _union(parent, a, b):
                        out.append((int(ids[some[i]]), int(ids[others[j]])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int, scratch: Scratch) -> DataFrame:
    """For each row of docs its id, content hash, set size, component (smallest id) and whether it represents it."""
    content = F.xxhash64(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc"), content.alias("content"), F.col(text_col).alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    signed = scratch.save(
        texts.mapInArrow(_sign(width), f"doc {kind}, content long, n long, f1 long, f2 long, bands array<long>"), "signed"
    )
    classes = (
        signed.where("n > 0 AND doc IS NOT NULL")
        .groupBy("f1", "f2", "n")
        .agg(F.min(F.struct("doc", "content", "bands")).alias("x"))
        .select(
            F.monotonically_increasing_id().alias("id"), "f1", "f2", "n",
            F.struct("x.doc", "x.content").alias("rep"), F.col("x.bands").alias("bands"),
        )
    )
    # Numbers are fixed by writing them.
    classes = scratch.save(classes, "classes")
    placed = classes.select(F.explode("bands").alias("key"), "id", "rep.doc")
    # Copies mostly follow their original, so the smallest id is close to most of a bucket.
    buckets = placed.groupBy("key").agg(
        F.count("*").alias("n"), F.min_by("id", "doc").alias("low"), F.max_by("id", "doc").alias("high")
    ).where("n > 1")
    members = scratch.save(placed.drop("doc").join(scratch.save(buckets, "buckets"), "key"), "members")
    pivots = (
        members.select("id", F.explode(F.array("low", "high")).alias("pivot")).where("id <> pivot")
        .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    )
    # Sets are made again only for one text of each class that shares a bucket.
    wanted = members.select("id").distinct().join(classes.select("id", "rep.doc", "rep.content"), "id")
    once = texts.join(wanted, ["doc", "content"]).groupBy("doc", "content", "id").agg(F.first("text").alias("text"))
    sets = scratch.save(once.select("id", "text").mapInArrow(_sets(width), "id long, set array<long>"), "sets")
    both = (
        pivots.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    )
    links = scratch.save(
        both.where(100 * F.col("c") >= threshold * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b"), "links"
    )
    found = components(links, scratch, "first")
    more = scratch.save(_unfinished(members, found, sets, threshold, scratch), "more")
    found = components(links.unionByName(more), scratch, "all")
    scratch.drop("sets", "members", "buckets")
    found = classes.select("id", "f1", "f2", "n", "rep").join(found, "id", "left")
    found = found.select("f1", "f2", "n", "rep", F.coalesce("component", "id").alias("component"))
    first = scratch.save(found.groupBy("component").agg(F.min("rep").alias("first")), "representatives")
    answer = scratch.save(found.join(first, "component").select("f1", "f2", "n", "first"), "answer")
    judged = signed.select("doc", "content", "n", "f1", "f2").join(answer, ["f1", "f2", "n"], "left")
    own = F.struct("doc", "content")
    # A null id, or a text without shingles, is in no class.
    judged = judged.select(
        "doc", "content", "n",
        F.when(F.col("doc").isNotNull(), F.coalesce("first.doc", "doc")).alias("component"),
        (F.col("first").isNull() | F.col("doc").isNull() | (F.col("first") == own)).alias("represents"),
    )
    return judged


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80
) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs; threshold in percent of the union."""
    return _judged(docs, id_col, text_col, width, threshold, Scratch(docs.sparkSession)).select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
    )


def _unfinished(members: DataFrame, found: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Links between components in buckets of four or more, from all pairs not yet connected.

    A bucket's rows are dealt into blocks. Rows outside the bucket's first
    component must meet every row; rows inside it need not meet each other, so
    only blocks of the former are paired with all blocks. A pair of blocks is
    one group, of 2 * BLOCK rows or so.
    """
    labelled = (
        members.where("n > 3").join(found, "id", "left")
        .select("key", "id", F.coalesce("component", "id").alias("component"), "low")
    )
    labelled = scratch.save(labelled, "labelled")
    # The first document's component stands for the bucket; it needs no look-up by key twice.
    mixed = labelled.groupBy("key").agg(
        F.min("component").alias("c0"),
        F.max("component").alias("c1"),
        F.max(F.when(F.col("id") == F.col("low"), F.col("component"))).alias("main"),
        F.count("*").alias("n"),
    ).where("c0 <> c1").select("key", "main", "n")
    mixed = scratch.save(mixed, "mixed")
    rows = scratch.save(labelled.drop("low").join(mixed, "key"), "mixed-rows")
    others = rows.groupBy("key").agg(F.count_if(F.col("component") != F.col("main")).alias("n_out"))
    rows = rows.join(scratch.save(others, "mixed-outside"), "key").select(
        "key", "id", "component",
        (F.col("component") != F.col("main")).alias("out"),
        F.ceil(F.col("n_out") / BLOCK).cast("int").alias("k_out"),
        F.ceil((F.col("n") - F.col("n_out")) / BLOCK).cast("int").alias("k_in"),
    )
    block = F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("k_out")).otherwise(F.col("k_in"))).cast("int")
    rows = rows.withColumn("block", block)
    # Pairs of blocks: out i with out j >= i (side 2 where they are one), out i with in j.
    outs = F.sequence(F.lit(0), F.col("k_out") - 1)
    ins = F.when(F.col("k_in") > 0, F.sequence(F.lit(0), F.col("k_in") - 1)).otherwise(F.array().cast("array<int>"))
    me = F.col("block")

    def seat(i, j, inside, side):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(inside).alias("inside"), side.alias("side"))

    with_outs = F.transform(
        outs,
        lambda j: seat(
            F.least(me, j), F.greatest(me, j), False, F.when(me == j, 2).when(me < j, 0).otherwise(1)
        ),
    )
    with_ins = F.transform(ins, lambda j: seat(me, j, True, F.lit(0)))
    inside = F.transform(outs, lambda i: seat(i, me, True, F.lit(1)))
    seats = F.when(F.col("out"), F.concat(with_outs, with_ins)).otherwise(inside)
    seated = rows.select("key", "id", "component", F.explode(seats).alias("s")).select("key", "id", "component", "s.*")
    seated = seated.join(sets, "id")
    return seated.groupBy("key", "i", "j", "inside").applyInArrow(_finish(threshold), "a long, b long")


#: The contract's shingles are pairs of words.
CONTRACT_WIDTH = 2


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=CONTRACT_WIDTH)


def keep_one_each(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each near-duplicate group, with its columns: the pipeline's second stage.

    The one that stays is that with the smallest id. Rows are told apart by id and content, so of rows that share an id only
    those go whose own text has a representative elsewhere. Of rows equal in id
    and text one stays, whatever its other columns. Rows without words or with
    a null id stay; null, empty and very long texts and clashing columns are as
    in the operator.
    """
    scratch = Scratch(docs.sparkSession)
    judged = scratch.save(_judged(docs, "doc_id", "text", width, threshold, scratch), "judged")
    gone = judged.where("NOT represents").select(F.col("doc").alias("doc_id"), F.col("content").alias("content_hash"))
    stay = without(docs, gone, "doc_id", content_hash("text"))
    repeated = judged.where("represents AND n > 0 AND doc IS NOT NULL").groupBy("doc", "content").count()
    repeated = scratch.save(repeated.where("count > 1").select(F.col("doc").alias("_doc"), F.col("content").alias("_hash")), "repeated")
    if repeated.isEmpty():
        return stay
    same = (stay["doc_id"] == repeated["_doc"]) & (content_hash("text") == repeated["_hash"])
    once = stay.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(repeated, same, "left_anti").unionByName(once)


OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM docs),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id <= coalesce(m, doc_id) AS kept
FROM sized LEFT JOIN low USING (doc_id)
"""
