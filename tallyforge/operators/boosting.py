"""Boosted trees for censored durations: an accelerated-failure-time model with a normal error.

A row's gradient depends on its features, its duration and whether it is
censored, and on nothing else. So rows are first counted by these (one partial
aggregate and shuffle), and every later pass reads that smaller table, which is
written once. The result is that of training on all rows; nothing is sampled.

A tree grows level by level. For a level, tasks run the trees so far over their
rows, add gradients and Hessians up by node, feature and bin, and Spark adds the
tasks' histograms; the driver sees at most nodes x bins of them and picks the
splits. The pass of a tree's root also gives the loss of the model so far on the
training and validation rows, so early stopping costs no further pass. The
trees' sum per row is written anew every few rounds, so a pass runs a bounded
number of trees.

Categories are split by the order of their gradient to Hessian ratio, numbers by
cut points. A null, or a category that training did not have, takes the side
with the larger Hessian.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import calibration
from tallyforge.sources.shared import written

#: Bins of a number, a null's bin not counted.
NUMBER_BINS = 255


@dataclass(frozen=True)
class Settings:
    rounds: int = 500
    depth: int = 6
    rate: float = 0.05
    least_hessian: float = 50.0
    penalty: float = 1.0
    scale: float = 1.0
    patience: int = 30
    #: Rounds after which sums are written anew.
    rewrite: int = 25


@lru_cache(maxsize=1)
def _hazard_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, the normal density over the upper tail, and the logarithm of the upper tail."""
    z = np.linspace(-12, 12, 120_001)
    tail = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in z])
    return z, np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail, np.log(tail)


def losses(z: np.ndarray, event: np.ndarray, scale: float, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) by the location, of z = (log duration - location) / scale.

    An event's loss is minus the log density of its duration, a censored row's
    minus the log of the chance to last longer.
    """
    grid, hazard, log_tail = _hazard_table()
    inside = np.clip(z, grid[0], grid[-1])
    h = np.interp(inside, grid, hazard)
    # Beyond the grid the ratio is z + 1/z, up to 1/z^3.
    h = np.where(z > grid[-1], z + 1 / np.maximum(z, 1), h)
    far = np.maximum(z, grid[-1])
    beyond = log_tail[-1] - (far * far - grid[-1] ** 2) / 2 - np.log(far / grid[-1])
    censored = -np.where(z > grid[-1], beyond, np.interp(inside, grid, log_tail))
    observed = z * z / 2 + math.log(scale * math.sqrt(2 * math.pi)) + logs
    return (
        np.where(event, observed, censored),
        np.where(event, -z, -h) / scale,
        np.where(event, 1.0, np.maximum(h * (h - z), 1e-12)) / scale**2,
    )


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf's feature is -1. ``left`` holds the bins that go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left: list[np.ndarray | None] = field(default_factory=lambda: [None])
    children: list[tuple[int, int]] = field(default_factory=lambda: [(-1, -1)])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        self.feature.append(-1)
        self.left.append(None)
        self.children.append((-1, -1))
        self.value.append(0.0)
        return len(self.feature) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has reached."""
        at = np.zeros(len(bins), np.int64)
        for node, f in enumerate(self.feature):  # a child comes after its parent
            if f >= 0:
                here = np.flatnonzero(at == node)
                low, high = self.children[node]
                at[here] = np.where(self.left[node][bins[here, f]], low, high)
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass(frozen=True)
class Space:
    """Features as bins: categories with their codes, numbers with their cut points. Bin 0 is a null or unknown value."""

    categories: tuple[tuple[str, tuple[str, ...]], ...]
    numbers: tuple[tuple[str, tuple[float, ...]], ...]

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.categories] + [c for c, _ in self.numbers]

    @property
    def sizes(self) -> list[int]:
        return [len(v) + 1 for _, v in self.categories] + [len(v) + 2 for _, v in self.numbers]

    def columns(self) -> list[Column]:
        return [F.col(c).cast("string").alias(c) for c, _ in self.categories] + [F.col(c).cast("double").alias(c) for c, _ in self.numbers]

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = []
        for c, values in self.categories:
            found = pc.index_in(batch.column(c), pa.array(values, pa.string()))
            out.append(pc.fill_null(found, -1).to_numpy() + 1)
        for c, cuts in self.numbers:
            x = batch.column(c).to_numpy(zero_copy_only=False)
            out.append(np.where(np.isnan(x), 0, np.searchsorted(np.array(cuts), x, side="left") + 1))
        return np.column_stack(out).astype(np.int64)


def feature_space(train: DataFrame, categories: list[str], numbers: list[str]) -> Space:
    """The values of each category in training, in order, and quantiles of each number; bounded lists.

    A category must have a bounded number of values (codes, districts); they go to every task.
    """
    codes = calibration.category_codes(train, categories)
    known: dict[str, list[str]] = {c: [] for c in categories}
    for r in codes.orderBy("column", "code").collect():
        known[r["column"]].append(r["value"])
    shares = [F.lit(k / NUMBER_BINS) for k in range(1, NUMBER_BINS)]
    cuts = train.agg(*[F.approx_percentile(F.col(c).cast("double"), F.array(*shares), F.lit(10_000)).alias(c) for c in numbers]).first() if numbers else {}
    return Space(
        tuple((c, tuple(known[c])) for c in categories),
        tuple((c, tuple(sorted(set(cuts[c] or [])))) for c in numbers),
    )


@dataclass
class Model:
    """Locations are ``base`` plus the trees' values."""

    space: Space
    settings: Settings
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: (round, training loss, validation loss) a row, before the round's tree.
    history: list[tuple[int, float, float | None]] = field(default_factory=list)

    def located(self, rows: DataFrame, name: str = "location") -> DataFrame:
        """rows with the model's location, the mean of the log duration."""
        base, trees = self.base, list(self.trees)
        # Features under names of their own; all columns of rows pass through as they are.
        mark = "_x"
        while any(c.startswith(mark) for c in rows.columns):
            mark += "_"
        own = [mark + n for n in self.space.names]
        k = len(self.space.categories)
        space = Space(
            tuple((n, v) for n, (_, v) in zip(own, self.space.categories, strict=False)),
            tuple((n, v) for n, (_, v) in zip(own[k:], self.space.numbers, strict=True)),
        )

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = space.bins(batch)
                total = np.full(len(bins), base)
                for tree in trees:
                    total += tree.values(bins)
                kept = batch.columns[: batch.num_columns - len(own)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(total)], names=[*batch.schema.names[: len(kept)], name])

        given = rows.select("*", *[c.alias(n) for c, n in zip(self.space.columns(), own, strict=True)])
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` double"
        return given.mapInArrow(locate, ddl)


def split(g: np.ndarray, h: np.ndarray, is_category: bool, settings: Settings) -> tuple[float, np.ndarray] | None:
    """(gain, bins that go left) of a feature's best split of a node, from its bins' sums; bin 0 has the nulls."""
    total_g, total_h = g.sum(), h.sum()
    used = np.flatnonzero(h[1:] > 0) + 1
    if is_category:
        used = used[np.argsort(g[used] / (h[used] + settings.penalty), kind="stable")]
    if len(used) < 2:
        return None
    left_g, left_h = np.cumsum(g[used])[:-1], np.cumsum(h[used])[:-1]
    known_h = h[used].sum()
    # Nulls go where more of the known weight is.
    nulls_left = left_h >= known_h - left_h
    left_g, left_h = left_g + np.where(nulls_left, g[0], 0), left_h + np.where(nulls_left, h[0], 0)
    right_g, right_h = total_g - left_g, total_h - left_h
    score = lambda a, b: a * a / (b + settings.penalty)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)
    gain[(left_h < settings.least_hessian) | (right_h < settings.least_hessian)] = -np.inf
    best = int(np.argmax(gain))
    if not gain[best] > 1e-9:
        return None
    left = np.zeros(len(g), bool)
    left[used[: best + 1]] = True
    if not is_category:  # cut points between used bins belong to the left
        left[1 : used[best] + 1] = True
        left[used[best + 1] :] = False
    unseen = np.setdiff1d(np.arange(1, len(g)), used) if is_category else np.array([], int)
    left[0] = left[unseen] = bool(nulls_left[best])
    return float(gain[best]), left


def _pass(space: Space, settings: Settings, trees: list[Tree], tree: Tree, open_nodes: list[int]):
    """Histograms (slot, g, h) of the open nodes; slots -1 and -2 hold loss and weight of training and validation rows."""
    offsets = np.concatenate([[0], np.cumsum(space.sizes)])
    width = int(offsets[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(open_nodes) * width))
        ends = np.zeros((2, 2))
        place = np.full(len(tree.feature), -1)
        place[open_nodes] = np.arange(len(open_nodes))
        for batch in batches:
            bins = space.bins(batch)
            n, logs, event, held, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "logs", "event", "held", "total"))
            total = total.copy()
            for t in trees:
                total += t.values(bins)
            loss, g, h = losses((logs - total) / settings.scale, event.astype(bool), settings.scale, logs)
            held = held.astype(bool)
            for k, rows in enumerate((~held, held)):
                ends[k] += (loss * n)[rows].sum(), n[rows].sum()
            at = place[tree.nodes(bins)]
            rows = np.flatnonzero(~held & (at >= 0))
            for f in range(len(space.sizes)):
                slot = at[rows] * width + offsets[f] + bins[rows, f]
                for k, x in enumerate((g, h)):
                    sums[k] += np.bincount(slot, (x * n)[rows], sums.shape[1])
        used = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-1, -2], used])),
                pa.array(np.concatenate([ends[:, 0], sums[0, used]])),
                pa.array(np.concatenate([ends[:, 1], sums[1, used]])),
            ],
            names=["slot", "g", "h"],
        )

    return run


@dataclass
class Sums:
    """A level's histograms by node (gradients, Hessians), and the mean losses."""

    nodes: np.ndarray
    loss: float
    held_loss: float | None


def _summed(table: DataFrame, space: Space, settings: Settings, trees: list[Tree], tree: Tree, level: list[int]) -> Sums:
    found = table.mapInArrow(_pass(space, settings, trees, tree, level), "slot long, g double, h double")
    found = found.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    slot, g, h = (found.column(c).to_numpy() for c in ("slot", "g", "h"))
    ends = {int(s): float(x / y) for s, x, y in zip(slot, g, h, strict=True) if s < 0 and y}
    nodes = np.zeros((2, len(level) * sum(space.sizes)))
    nodes[:, slot[slot >= 0]] = g[slot >= 0], h[slot >= 0]
    return Sums(nodes.reshape(2, len(level), -1).transpose(1, 0, 2), ends[-1], ends.get(-2))


def _grow(tree: Tree, level: list[int], sums: Sums, space: Space, settings: Settings) -> list[int]:
    """Splits the nodes of a level where it gains; the new nodes."""
    offsets = np.concatenate([[0], np.cumsum(space.sizes)])
    value = lambda g, h: -settings.rate * g / (h + settings.penalty)
    below: list[int] = []
    for node, own in zip(level, sums.nodes, strict=True):
        each = [own[:, a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        tree.value[node] = value(*each[0].sum(axis=1))
        found = [split(*x, f < len(space.categories), settings) for f, x in enumerate(each)]
        choices = [(round(s[0], 9), -f) for f, s in enumerate(found) if s]
        if choices:
            f = -max(choices)[1]  # of equal gains the first feature's
            left = found[f][1]
            tree.feature[node], tree.left[node] = f, left
            tree.children[node] = tree.add(), tree.add()
            for child, side in zip(tree.children[node], (left, ~left), strict=True):
                tree.value[child] = value(*each[f][:, side].sum(axis=1))
            below += tree.children[node]
    return below


def _advanced(table: DataFrame, space: Space, trees: list[Tree]) -> DataFrame:
    """The table with the trees' values added to ``total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = space.bins(batch)
            total = batch.column("total").to_numpy().copy()
            for t in trees:
                total += t.values(bins)
            yield batch.set_column(batch.schema.get_field_index("total"), "total", pa.array(total))

    return written(table.mapInArrow(run, table.schema), "boosting")


def fit(
    train: DataFrame,
    categories: list[str],
    numbers: list[str],
    duration: str = "duration_days",
    event: str = "event_observed",
    settings: Settings | None = None,
    validation: DataFrame | None = None,
    weight: str | None = None,
) -> Model:
    """Trains on all rows of train; with validation rows, stops early and keeps the trees up to the least loss there.

    ``weight`` names a column that says for how many equal rows a row stands.
    """
    settings = settings or Settings()
    space = feature_space(train, categories, numbers)
    parts = [train.withColumn("held", F.lit(False))]
    if validation is not None:
        parts.append(validation.withColumn("held", F.lit(True)))
    logs = F.log(F.greatest(F.col(duration).cast("double"), F.lit(1.0)))
    rows = None
    for p in parts:
        p = p.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
        n = (F.col(weight) if weight else F.lit(1)).cast("double").alias("n")
        p = p.select(*space.columns(), logs.alias("logs"), F.col(event).cast("boolean").alias("event"), "held", n)
        rows = p if rows is None else rows.unionByName(p)
    counted = rows.groupBy(*rows.columns[:-1]).agg(F.sum("n").alias("n")).withColumn("total", F.lit(0.0))
    table = written(counted, "boosting")
    base = table.where("NOT held").agg((F.sum(F.col("logs") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
    if base is None:
        raise ValueError("there are no rows to train on")
    model = Model(space, settings, float(base))
    table, fresh = table.withColumn("total", F.lit(model.base)), []
    best, best_round = math.inf, 0
    for k in range(settings.rounds + 1):
        tree, level = Tree(), [0]
        sums = _summed(table, space, settings, fresh, tree, level)
        model.history.append((k, sums.loss, sums.held_loss))
        judged = sums.loss if validation is None else sums.held_loss
        if judged < best:
            best, best_round = judged, k
        if k == settings.rounds or validation is not None and k - best_round >= settings.patience:
            break
        for depth in range(settings.depth):
            level = _grow(tree, level, sums, space, settings)
            if not level or depth + 1 == settings.depth:
                break
            sums = _summed(table, space, settings, fresh, tree, level)
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) >= settings.rewrite:
            table, fresh = _advanced(table, space, fresh), []
    if validation is not None:
        model.trees = model.trees[:best_round]
    return model
