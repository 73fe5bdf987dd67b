"""Language-model scoring with a gated recurrent network (operator 10).

Counting. Each task counts the words of its training documents by 64-bit hash;
Spark adds the counts up. Words with at least ``floor`` occurrences, where the
floor is the least that keeps them within ``HEAD`` words, form the head, a table
of bounded size that every task holds. All other words are looked up by a join.
So every word of the corpus counts, and only the head is broadcast.

The model. A GRU over the ``VOCAB`` most frequent words, one symbol for all
others, and the end token. Its output softmax is factored by class: first the
class of the next word, then the word inside the class. A word outside the
vocabulary gets the probability of that symbol times its share of the base
model's mass outside the vocabulary, so the model spreads exactly 1 over all
words and one unseen word, like the base model. It starts as the base model
(biases at the logarithm of the counts).

Training. Truncated backpropagation in numpy. Tasks train copies of the model
on their own training documents and Spark averages the copies by documents
trained, for ``ROUNDS`` rounds (one: a second adds little and costs as much as
the first). What the mean gains over the base depends on the documents a task
has, and does not shrink with more tasks of as many documents. Every training document is read whole, its
windows in order and the end token included: ``LANES`` documents go side by
side, the state is carried from window to window, and a document that ends
makes room for the next, which starts from a zero state. Each window has the
same weight, however many documents are left beside it.

Scoring. Whole documents go through the network in batches of similar length;
the state is carried from window to window, from the first word to the end.

Defined results: a null or empty text is one end token; a null id belongs to
the training part; ids may be of any type; repeated rows count and are scored
each; words of equal count enter the vocabulary by their hash; a very long text
is read whole, in windows, so only its words' hashes and symbols are held at
once; an empty table gives no rows; other columns, whatever their names, are
ignored. Float sums may differ in the last
digits between runs, as tasks end in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bytescan
from tallyforge.llm.scratch import Scratch

SMOOTH = 0.1
HEAD = 1 << 18
VOCAB = 2046
HIDDEN = 16
WINDOW = 16
#: Documents that a task trains on side by side: with fewer, a task takes more steps over the same documents, at a higher cost.
LANES = 128
ROUNDS = 1
RATE = 0.75
#: Symbols of documents that wait for a lane.
POOL = 1 << 18
#: Documents that go through the network side by side, and tokens from which a task picks documents of like length.
BATCH = 512
AT_ONCE = 1 << 21
#: The end token's place among hashes; no word's hash is likelier to be it than any other value.
END = np.uint64(0x656E64)


@dataclass
class Model:
    """Weights; the symbol ``VOCAB + 1`` stands for words outside the vocabulary, 0 for the end."""

    embed: np.ndarray  # symbols x 3H, the input's part of update, reset and candidate
    recur: np.ndarray  # H x 2H, of update and reset
    cand: np.ndarray  # H x H, of the candidate
    class_w: np.ndarray  # H x C
    class_b: np.ndarray  # C
    word_w: np.ndarray  # C x S x H
    word_b: np.ndarray  # C x S; -inf where a class has fewer words


def new_model(counts: np.ndarray, hidden: int, seed: int = 7) -> Model:
    """A model that predicts the symbols' shares whatever came before."""
    rng = np.random.default_rng(seed)
    n = len(counts)
    size = int(np.ceil(np.sqrt(n)))
    classes = -(-n // size)
    grid = np.full(classes * size, 0.0)
    grid[:n] = np.maximum(counts, 0.5)
    grid = grid.reshape(classes, size)
    with np.errstate(divide="ignore"):
        word_b = np.log(grid / grid.sum(1, keepdims=True))
    f = np.float32
    return Model(
        rng.normal(0, 0.1, (n, 3 * hidden)).astype(f),
        rng.normal(0, 0.2, (hidden, 2 * hidden)).astype(f),
        rng.normal(0, 0.2, (hidden, hidden)).astype(f),
        np.zeros((hidden, classes), f),
        np.log(grid.sum(1) / grid.sum()).astype(f),
        np.zeros((classes, size, hidden), f),
        np.maximum(word_b, -1e9).astype(f),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Written over x."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(m: Model, h: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """(next state, update, reset, candidate)."""
    return _cell(m, h, m.embed[symbols])


def _cell(m: Model, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    n = h.shape[1]
    zr = _sigmoid(x[:, : 2 * n] + h @ m.recur)
    z, r = zr[:, :n], zr[:, n:]
    c = np.tanh(x[:, 2 * n :] + (r * h) @ m.cand)
    return h + z * (c - h), z, r, c


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones((x.shape[1], 1), x.dtype)


def _log_softmax_at(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The logarithm of each row's softmax in the row's own column; x is overwritten."""
    x -= x.max(1, keepdims=True)
    own = x[np.arange(len(x)), column]
    return own - np.log(_row_sums(np.exp(x, out=x))[:, 0])


def _softmax(x: np.ndarray) -> np.ndarray:
    """Each row's softmax, written over x."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= _row_sums(x)
    return x


def _by_class(m: Model, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts rows by class, and (class, first row, last + 1) of each class that occurs."""
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(len(m.class_b) + 1))
    return order, [(int(k), int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges))]


def _word_logits(m: Model, states: np.ndarray, cls: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words' logits inside each row's class; rows sorted by class."""
    out = m.word_b[cls]
    for k, a, b in runs:
        out[a:b] += states[a:b] @ m.word_w[k].T
    return out


def log_probs(m: Model, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural logarithm of each symbol's probability after its state."""
    size = m.word_b.shape[1]
    cls = symbols // size
    out = _log_softmax_at(states @ m.class_w + m.class_b, cls).astype(np.float64)
    order, runs = _by_class(m, cls)
    out[order] += _log_softmax_at(_word_logits(m, states[order], cls[order], runs), symbols[order] % size)
    return out


def train_window(m: Model, h: np.ndarray, prev: np.ndarray, target: np.ndarray, rate: float) -> np.ndarray:
    """One step of truncated backpropagation over (time, batch) symbols; target -1 is padding. Returns the last state."""
    steps, batch = prev.shape
    hidden, size = h.shape[1], m.word_b.shape[1]
    x = m.embed[prev]
    states = np.empty((steps + 1, batch, hidden), np.float32)
    zs, rs, cs = (np.empty((steps, batch, hidden), np.float32) for _ in range(3))
    states[0] = h
    for t in range(steps):
        states[t + 1], zs[t], rs[t], cs[t] = _cell(m, states[t], x[t])
    real = target.ravel() >= 0
    y = target.ravel()[real]
    hs = states[1:].reshape(-1, hidden)[real]
    scale = np.float32(rate / max(1, batch))
    # Output layer: class, then word inside the class.
    cls, within = y // size, y % size
    every = np.arange(len(y))
    g = _softmax(hs @ m.class_w + m.class_b)
    g[every, cls] -= 1
    d_hs = g @ m.class_w.T
    d_class_w, d_class_b = hs.T @ g, g.sum(0)
    order, runs = _by_class(m, cls)
    sorted_hs = hs[order]
    gw = _softmax(_word_logits(m, sorted_hs, cls[order], runs))
    gw[every, within[order]] -= 1
    d_sorted = np.empty_like(sorted_hs)
    with_one = np.concatenate([sorted_hs, np.ones((len(y), 1), np.float32)], axis=1)
    d_word = np.empty((len(runs), size, hidden + 1), np.float32)
    for n, (k, a, b) in enumerate(runs):
        d_sorted[a:b] = gw[a:b] @ m.word_w[k]
        d_word[n] = gw[a:b].T @ with_one[a:b]
    d_hs[order] += d_sorted
    own = [k for k, _, _ in runs]
    m.word_w[own] -= scale * _clip_each(d_word[:, :, :hidden], batch)
    m.word_b[own] -= scale * _clip_each(d_word[:, :, hidden], batch)
    d_out = np.zeros((steps * batch, hidden), np.float32)
    d_out[real] = d_hs
    d_out = d_out.reshape(steps, batch, hidden)
    # Back through time, inside the window only.
    before = states[:-1]
    by_c, by_z, by_r = zs * (1 - cs * cs), (cs - before) * zs * (1 - zs), before * rs * (1 - rs)
    stay = 1 - zs
    d_h = np.zeros((batch, hidden), np.float32)
    d_x = np.empty((steps, batch, 3 * hidden), np.float32)
    recur_t, cand_t = np.ascontiguousarray(m.recur.T), np.ascontiguousarray(m.cand.T)
    for t in reversed(range(steps)):
        d_h += d_out[t]
        d_c = d_h * by_c[t]
        d_rh = d_c @ cand_t
        d = d_x[t]
        d[:, :hidden], d[:, hidden : 2 * hidden], d[:, 2 * hidden :] = d_h * by_z[t], d_rh * by_r[t], d_c
        d_h = d_h * stay[t] + d_rh * rs[t] + d[:, : 2 * hidden] @ recur_t
    flat = d_x.reshape(-1, 3 * hidden)
    m.recur -= scale * _clip(before.reshape(-1, hidden).T @ flat[:, : 2 * hidden], batch)
    m.cand -= scale * _clip((rs * before).reshape(-1, hidden).T @ flat[:, 2 * hidden :], batch)
    m.class_w -= scale * _clip(d_class_w, batch)
    m.class_b -= scale * _clip(d_class_b, batch)
    place = np.argsort(prev.ravel(), kind="stable")
    symbols, first = np.unique(prev.ravel()[place], return_index=True)
    m.embed[symbols] -= scale * _clip(np.add.reduceat(flat[place], first), batch)
    return states[-1]


def _clip(g: np.ndarray, batch: int) -> np.ndarray:
    norm = float(np.sqrt((g * g).sum()))
    return g * np.float32(min(1.0, batch / norm)) if norm > 0 else g


def _clip_each(g: np.ndarray, batch: int) -> np.ndarray:
    """``_clip`` of each part along the first axis."""
    flat = g.reshape(len(g), -1)
    norms = np.sqrt((flat * flat).sum(1))
    return (flat * np.minimum(1, batch / np.maximum(norms, 1e-30))[:, None].astype(np.float32)).reshape(g.shape)


# Reading documents


@dataclass
class Tokens:
    """Words of a run of documents: hashes in order, an end after each document."""

    hashes: np.ndarray
    bounds: np.ndarray


def read_tokens(raw: np.ndarray, at: np.ndarray) -> Tokens:
    starts, ends, bounds = bytescan.words(raw, at)
    rows = len(at) - 1
    out = np.empty(len(starts) + rows, np.uint64)
    is_end = np.zeros(len(out), bool)
    edges = bounds + np.arange(rows + 1)
    is_end[edges[1:] - 1] = True
    out[~is_end] = bytescan.hash_spans(raw, starts, ends)
    out[is_end] = END
    return Tokens(out, edges)


def in_training(ids: pa.Array) -> np.ndarray:
    """Documents whose crc32 of the id as text is not 0 modulo 10."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i in ids.to_pylist()], bool)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's word counts, in partial sums of a bounded number of words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(place, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    def rows(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

    for batch in batches:
        train = in_training(batch.column(0))
        for a, b, raw, at in bytescan.slices(batch.column(1)):
            tokens = read_tokens(raw, at)
            own = np.repeat(train[a:b], np.diff(tokens.bounds))
            words, counts = np.unique(tokens.hashes[own], return_counts=True)
            held.append((words, counts))
            size += len(words)
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())


@dataclass
class Head:
    """Frequent words in the order of their hashes, with counts and the model's symbols; and the totals."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    total: int
    distinct: int
    rest_mass: float

    @property
    def denominator(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether there)."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return place, self.words[place] == hashes


def make_head(words: np.ndarray, counts: np.ndarray, total: int, distinct: int, vocab: int) -> tuple[Head, np.ndarray]:
    """The head and the symbols' counts: end, ``vocab`` frequent words, all others."""
    order = np.lexsort((words, -counts))
    order = order[words[order] != END][:vocab]
    symbols = np.full(len(words), vocab + 1, np.int32)
    symbols[order] = np.arange(1, len(order) + 1)
    symbols[words == END] = 0
    by_symbol = np.zeros(vocab + 2)
    by_symbol[1 : len(order) + 1] = counts[order]
    by_symbol[0] = counts[words == END].sum()
    by_symbol[vocab + 1] = max(0, total - by_symbol.sum())
    known = by_symbol[: vocab + 1].sum() + SMOOTH * (len(order) + bool((words == END).any()))
    rest = total + SMOOTH * (distinct + 1) - known
    return Head(words, counts, symbols, total, distinct, rest), by_symbol


def _to_symbols(head: Head, tokens: Tokens, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, there = head.find(tokens.hashes)
    symbols = np.where(there, head.symbols[place], vocab + 1) if len(head.words) else np.full(len(place), vocab + 1)
    symbols[tokens.bounds[1:] - 1] = 0
    return symbols.astype(np.int64), place, there


def train_documents(m: Model, documents: Iterator[np.ndarray], window: int, rate: float, lanes: int = LANES) -> int:
    """Trains on every window of every document's symbols, in order; returns the number of documents.

    Waiting documents lie one after another in a pool. A lane is a place in the
    pool, the end of its document, the symbol before the place and the state.
    """
    waiting = _pools(documents)
    pool = np.zeros(0, np.int32)
    at = stop = last = firsts = ends = np.zeros(0, np.int64)
    h = np.zeros((0, m.recur.shape[0]), np.float32)
    steps = np.arange(window)
    trained = 0
    while True:
        while len(at) < lanes:
            if not len(firsts):
                if (more := next(waiting, None)) is None:
                    break
                # What the lanes still have to read moves to the new pool.
                sizes = stop - at
                kept = [pool[x:y] for x, y in zip(at, stop, strict=True)]
                at = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
                stop = at + sizes
                bounds = int(sizes.sum()) + np.concatenate(([0], np.cumsum([len(x) for x in more]))).astype(np.int64)
                pool = np.concatenate([*kept, *more])
                firsts, ends = bounds[:-1], bounds[1:]
            new = min(lanes - len(at), len(firsts))
            at, stop = np.concatenate([at, firsts[:new]]), np.concatenate([stop, ends[:new]])
            last = np.concatenate([last, np.zeros(new, np.int64)])
            h = np.concatenate([h, np.zeros((new, h.shape[1]), np.float32)])
            firsts, ends = firsts[new:], ends[new:]
            trained += new
        if not len(at):
            return trained
        place = at + steps[:, None]
        target = np.where(place < stop, pool[np.minimum(place, len(pool) - 1)], -1).astype(np.int64)
        prev = np.concatenate([last[None], np.maximum(target[:-1], 0)])
        # A step over few documents moves the model by their share of a full one.
        h = train_window(m, h, prev, target, rate * len(at) / lanes)
        live = np.flatnonzero(at + window < stop)
        at, stop, last, h = at[live] + window, stop[live], target[-1, live], h[live]


def _pools(documents: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents in lists of about ``POOL`` symbols; one without symbols has nothing to train on."""
    held: list[np.ndarray] = []
    size = 0
    for own in documents:
        if len(own):
            held.append(own)
            size += len(own)
        if size >= POOL:
            yield held
            held, size = [], 0
    if held:
        yield held


def _train(shared, head_shared, vocab: int, window: int, rate: float):
    names = [f.name for f in fields(Model)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*[x.copy() for x in shared.value])
        head = head_shared.value

        def documents() -> Iterator[np.ndarray]:
            for batch in batches:
                train = in_training(batch.column(0))
                for a, b, raw, at in bytescan.slices(batch.column(1)):
                    tokens = read_tokens(raw, at)
                    symbols = _to_symbols(head, tokens, vocab)[0].astype(np.int32)
                    for r in np.flatnonzero(train[a:b]):
                        # A copy, so that a lane does not hold the slice.
                        yield symbols[tokens.bounds[r] : tokens.bounds[r + 1]].copy()

        trained = train_documents(model, documents(), window, rate)
        if trained:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names),
                    pa.array([trained] * len(names), pa.int64()),
                    pa.array([np.ascontiguousarray(getattr(model, n), np.float32).tobytes() for n in names], pa.binary()),
                ],
                names=["part", "docs", "weights"],
            )

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the models that a task is handed, one model in memory at a time."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for part, n, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            part, n = part.as_py(), n.as_py()
            value = np.frombuffer(data.as_py(), np.float32) * np.float64(n)
            sums[part] = sums[part] + value if part in sums else value
            docs[part] = docs.get(part, 0) + n
    if sums:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums)),
                pa.array([docs[p] for p in sums], pa.int64()),
                pa.array([(sums[p] / docs[p]).astype(np.float32).tobytes() for p in sums], pa.binary()),
            ],
            names=["part", "docs", "weights"],
        )


MODEL_ROWS = "part string, docs long, weights binary"


def averaged(models: DataFrame, scratch: Scratch, name: str, fan_in: int = 16) -> list:
    """The documents-weighted mean of all tasks' models, by a tree of partial means; seven rows reach the driver."""
    rows = scratch.save(models, name)
    n = rows.where("part = 'embed'").count()
    while n > 1:
        n = -(-n // fan_in)
        rows = rows.repartition(n).mapInArrow(_average, MODEL_ROWS)
    return rows.collect()


def _score(shared, head_shared, vocab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = Model(*shared.value), head_shared.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            held_out = ~in_training(batch.column(1))
            for a, b, raw, at in bytescan.slices(batch.column(2)):
                tokens = read_tokens(raw, at)
                symbols, place, there = _to_symbols(head, tokens, vocab)
                own = (batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), held_out[a:b])
                held.append((*own, symbols, tokens.bounds, *_direct(head, tokens, symbols, place, there, vocab)))
                size += len(symbols)
                if size >= AT_ONCE:
                    yield _scored(model, held)
                    held, size = [], 0
        if held:
            yield _scored(model, held)

    return run


def _direct(head: Head, tokens: Tokens, symbols: np.ndarray, place: np.ndarray, there: np.ndarray, vocab: int) -> tuple:
    """Per document: known tokens, base score and share of words in the head, and the list of words that are not."""
    low, rows = tokens.bounds[:-1], len(tokens.bounds) - 1
    smoothed = np.where(there, head.counts[place] if len(head.words) else 0, 0) + SMOOTH
    base = np.where(there, np.log10(smoothed / head.denominator), 0.0)
    # A word outside the vocabulary shares the other words' mass by its count.
    share = np.where(there & (symbols == vocab + 1), np.log10(smoothed / max(head.rest_mass, SMOOTH)), 0.0)
    missing = np.flatnonzero(~there)
    owner = np.searchsorted(tokens.bounds, missing, "right") - 1
    sizes = np.bincount(owner, minlength=rows)
    tail = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(tokens.hashes[missing].view(np.int64))
    )
    return np.add.reduceat(there.astype(np.int64), low), np.add.reduceat(base, low), np.add.reduceat(share, low), tail


def _scored(model: Model, held: list[tuple]) -> pa.RecordBatch:
    rows, ids, held_out, symbols, bounds, known, base, share, tail = zip(*held, strict=True)
    sizes = np.concatenate([np.diff(b) for b in bounds])
    whole = np.concatenate(([0], np.cumsum(sizes)))
    score = document_scores(model, np.concatenate(symbols), whole) / np.log(10) + np.concatenate(share)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays(rows),
            pa.concat_arrays(ids),
            pa.array(np.concatenate(held_out)),
            pa.array(sizes.astype(np.int64)),
            pa.array(np.concatenate(known)),
            pa.array(np.concatenate(base)),
            pa.array(score),
            pa.concat_arrays(tail),
        ],
        names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
    )


def document_scores(m: Model, symbols: np.ndarray, bounds: np.ndarray, batch: int = BATCH, window: int = 32) -> np.ndarray:
    """Each whole document's log-likelihood; documents of like length side by side, state carried between windows."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    hidden = m.recur.shape[0]
    for first in range(0, len(order), batch):
        own = order[first : first + batch]
        h = np.zeros((len(own), hidden), np.float32)
        last = np.zeros(len(own), np.int64)
        for low in range(0, int(sizes[own[0]]), window):
            live = int(np.searchsorted(-sizes[own], -low, "left"))  # longest first
            h, last = h[:live], last[:live]
            states, wanted, rows = [], [], []
            for t in range(low, min(low + window, int(sizes[own[0]]))):
                n = int(np.searchsorted(-sizes[own[:live]], -t, "left"))
                if n == 0:
                    break
                new, *_ = step(m, h[:n], last[:n])
                h[:n] = new
                last[:n] = symbols[bounds[own[:n]] + t]
                states.append(new), wanted.append(last[:n].copy()), rows.append(np.arange(n))
            logs = log_probs(m, np.concatenate(states), np.concatenate(wanted))
            out[own[:live]] += np.bincount(np.concatenate(rows), weights=logs, minlength=live)
    return out


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: int = VOCAB,
    hidden: int = HIDDEN,
    head_words: int = HEAD,
    rounds: int = ROUNDS,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    context = spark.sparkContext
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    counts = scratch.save(
        texts.mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts"
    )
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = totals[0] or 0, totals[1]
    floor = head_floor(counts, head_words)
    frequent = counts.where(F.col("c") >= floor).toArrow() if floor else counts.limit(0).toArrow()
    words = frequent.column("word").to_numpy().view(np.uint64)
    by_hash = np.argsort(words)
    head, by_symbol = make_head(words[by_hash], frequent.column("c").to_numpy()[by_hash], total, distinct, vocab)
    head_shared = context.broadcast(head)

    model = new_model(by_symbol, hidden)
    names = [f.name for f in fields(Model)]
    for turn in range(rounds):
        shared = context.broadcast([getattr(model, n) for n in names])
        trained = texts.mapInArrow(
            _train(shared, head_shared, vocab, WINDOW, RATE / (turn + 1)), MODEL_ROWS
        )
        rows = {r["part"]: r["weights"] for r in averaged(trained, scratch, f"models-{turn}")}
        if rows:
            model = Model(*[np.frombuffer(rows[n], np.float32).reshape(getattr(model, n).shape) for n in names])
    shared = context.broadcast([getattr(model, n) for n in names])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    scored = scratch.save(
        numbered.mapInArrow(
            _score(shared, head_shared, vocab),
            f"row long, id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>",
        ),
        "scored",
    )
    # Words outside the head: their counts by a join, their share of both scores by document.
    tail = scored.where(F.size("tail") > 0).select("row", F.explode("tail").alias("word"))
    tail = tail.groupBy("row", "word").agg(F.count("*").alias("k"))
    rare = counts.where(F.col("c") < floor) if floor else counts
    c = F.coalesce("c", F.lit(0)) + SMOOTH
    tail = (
        tail.join(rare, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("k") * F.log10(c / F.lit(head.denominator))).alias("tail_base"),
            F.sum(F.col("k") * F.log10(c / F.lit(max(head.rest_mass, SMOOTH)))).alias("tail_score"),
        )
    )
    zero = F.lit(0)
    return scored.join(tail, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("tail_score", zero)).alias("score"),
    )


def head_floor(counts: DataFrame, head_words: int) -> int:
    """The least count such that at most ``head_words`` words have it; 0 where there is none.

    Counts are grouped by power of two and then by value inside one power, so
    the driver sees at most some dozens and then some thousands of rows.
    """
    power = F.length(F.bin("c")) - 1
    by_power = sorted(counts.groupBy(power.alias("p")).count().collect(), key=lambda r: -r["p"])
    n = floor = 0
    for r in by_power:
        if n + r["count"] > head_words:
            inside = counts.where((power == r["p"]) & (F.col("c") < 2**20)).groupBy("c").count().orderBy(F.desc("c"))
            for x in inside.limit(1 << 20).toLocalIterator():
                if n + x["count"] > head_words:
                    break
                n, floor = n + x["count"], x["c"]
            break
        n, floor = n + r["count"], 2 ** r["p"]
    return floor


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
