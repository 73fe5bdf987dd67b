"""Personal data by patterns and a linear-chain conditional random field (operator 2).

Four fixed patterns give the base spans. The field adds what they miss, such as
phone numbers in national form or spelled-out addresses: it labels words by the
shapes of a word and its neighbours, with weights learned from a small labelled
table by the exact gradient of its log-likelihood, and decodes by Viterbi.

Decoding is exact on whole documents, yet touches few words. A word without a
digit, ``@`` or ``+`` is plain, and so are most words' neighbours. If the margin
of the label O at a plain word between plain words is larger than any two
transitions can make up for, such a word is O on the best path, so the chain
falls apart there. ``Field.anchored`` says whether the learned weights satisfy
this; if not, whole documents are decoded. The pieces are decoded side by side
in numpy batches.

An added span must hold together (digits for a phone, a check digit for a card,
a host for an address) and must not touch an accepted base span.

Defined results: a null text is an empty one and has no spans; rows with a null
or repeated id, and repeated rows, are searched one by one; of paths with equal
scores the one with the earlier label wins; spans that begin together go by kind;
a very long text is searched whole, its stretches decoded a bounded number of
words at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bytescan

#: Words whose emissions and paths are held at once.
CELLS = 1 << 14

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", "EMAIL", "IP", "CARD", "PHONE"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins at the first digit of a run or right after another match, which ends a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, accepted) of every match of the base patterns."""
    found = [(a, 0, b, True) for a, b in _emails(text)] if "@" in text else []
    if any(map(text.__contains__, "0123456789")):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            found.append((m.start(), 1, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            found.append((m.start(), 2, m.end(), 14 <= len(d) <= 19 and _luhn(d)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                found.append((m.start(), 3, m.end(), 10 <= len(_digits(m.group())) <= 15))
    return found


# The field's features

_SHAPES = [(re.compile("[0-9]+"), "9"), (re.compile("[A-Z]+"), "A"), (re.compile("[^\\W\\d_A-Z]+"), "a")]


#: The shape of every word without a digit, ``@`` or ``+`` that is no cue, and of what lies outside a text.
PLAIN = "plain"


def is_hot(word: str) -> bool:
    return "@" in word or "+" in word or any(map(word.__contains__, "0123456789"))


def shape(word: str) -> str:
    """Runs of digits, capitals and small letters as 9, A and a; hot words also carry their number of digits."""
    if not is_hot(word):
        bare = word.strip(".,;:!?()[]\"'")
        if bare in ("at", "dot", "[at]", "[dot]"):
            return f"<{bare.strip('[]')}>"
        return PLAIN
    n = sum(c in "0123456789" for c in word)
    out = word
    for pattern, mark in _SHAPES:
        out = pattern.sub(mark, out)
    return f"{out[:24]}#{min(n, 20) if n < 5 else n // 3 * 3}"


def features(shapes: list[str], i: int) -> list[str]:
    """The features of place i: its shape, its neighbours' and their pairs."""
    own = shapes[i]
    left = shapes[i - 1] if i else PLAIN
    right = shapes[i + 1] if i + 1 < len(shapes) else PLAIN
    digits = own.rpartition("#")[2] if "#" in own else "-"
    return ["bias", f"w={own}", f"d={digits}", f"l={left}", f"r={right}", f"lw={left}|{own}", f"wr={own}|{right}"]


@dataclass
class Field:
    weights: dict[str, np.ndarray]
    transitions: np.ndarray  # (labels + edge) x (labels + edge); the edge is the last
    anchored: bool = False

    def emissions(self, shapes: list[str]) -> np.ndarray:
        out = np.zeros((len(shapes), len(LABELS)))
        for i in range(len(shapes)):
            for f in features(shapes, i):
                w = self.weights.get(f)
                if w is not None:
                    out[i] += w
        return out


def _margin(field: Field) -> bool:
    """Whether a plain word between plain words is O on every best path.

    Changing such a word's label to O gains the difference of its emissions and
    loses at most what the two transitions around another label are better by.
    """
    t = field.transitions
    e = sum((field.weights.get(f, 0) for f in features([PLAIN] * 3, 1)), np.zeros(len(LABELS)))
    k = len(LABELS)
    return all(e[0] - e[y] > (t[:, y] - t[:, 0]).max() + (t[y, :] - t[0, :]).max() for y in range(1, k))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(sentences: list[tuple[list[str], list[str]]], turns: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood by AdaGrad on the whole table; (words, labels) per sentence."""
    k = len(LABELS)
    shaped = [[shape(w) for w in words] for words, _ in sentences]
    names: dict[str, int] = {}
    longest = max(len(s) for s in shaped)
    width = len(features(["x"], 0))
    index = np.zeros((len(shaped), longest, width), np.int64)
    gold = np.full((len(shaped), longest), -1)
    for s, (shapes, (_, labels)) in enumerate(zip(shaped, sentences, strict=True)):
        for i in range(len(shapes)):
            index[s, i] = [names.setdefault(f, len(names) + 1) for f in features(shapes, i)]
            gold[s, i] = LABELS.index(labels[i])
    n = (gold >= 0).sum(1)
    w = np.zeros((len(names) + 1, k))
    t = np.zeros((k + 1, k + 1))
    w_sum, t_sum = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    rows = np.arange(len(n))
    for _ in range(turns):
        e = w[index].sum(2)
        alpha = np.zeros((len(n), longest, k))
        beta = np.zeros_like(alpha)
        alpha[:, 0] = e[:, 0] + t[k, :k]
        for i in range(1, longest):
            alpha[:, i] = e[:, i] + _logsum(alpha[:, i - 1, :, None] + t[None, :k, :k], 1)
        beta[:] = t[:k, k]
        for i in range(longest - 2, -1, -1):
            inner = _logsum(t[None, :k, :k] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where((i + 1 < n)[:, None], inner, t[:k, k])
        log_z = _logsum(alpha[rows, n - 1] + t[:k, k], 1)
        p = np.exp(alpha + beta - log_z[:, None, None]) * (gold >= 0)[:, :, None]
        g_e = -p
        s_, i_ = np.nonzero(gold >= 0)
        g_e[s_, i_, gold[s_, i_]] += 1
        g_w = np.zeros_like(w)
        np.add.at(g_w, index.reshape(-1, width), np.repeat(g_e.reshape(-1, 1, k), width, 1))
        g_w[0] = 0
        g_t = np.zeros_like(t)
        for i in range(1, longest):
            live = i < n
            pair = alpha[live, i - 1, :, None] + t[None, :k, :k] + (e[live, i] + beta[live, i])[:, None, :]
            g_t[:k, :k] -= np.exp(pair - log_z[live, None, None]).sum(0)
            np.add.at(g_t, (gold[live, i - 1], gold[live, i]), 1)
        g_t[k, :k] -= p[:, 0].sum(0)
        np.add.at(g_t, (np.full(len(n), k), gold[:, 0]), 1)
        g_t[:k, k] -= p[rows, n - 1].sum(0)
        np.add.at(g_t, (gold[rows, n - 1], np.full(len(n), k)), 1)
        # Transitions are held back more, which keeps their reach below the words' margins.
        g_w, g_t = g_w - decay * w, g_t - 20 * decay * len(n) * t
        w_sum, t_sum = w_sum + g_w**2, t_sum + g_t**2
        w, t = w + rate * g_w / np.sqrt(w_sum), t + 0.2 * rate * g_t / np.sqrt(t_sum)
    field = Field({f: w[i] for f, i in names.items()}, t)
    field.anchored = _margin(field)
    return field


def viterbi(field: Field, pieces: list[np.ndarray], outer: list[tuple[int, int]]) -> list[np.ndarray]:
    """Best labels of each piece of emissions, between its given outer labels.

    Pieces of like length are decoded side by side, ``CELLS`` words at once; a
    longer piece is decoded alone.
    """
    out: list[np.ndarray] = [np.zeros(0, int)] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * len(pieces[order[high]]) <= CELLS:
            high += 1
        own = order[low:high]
        for i, labels in zip(own, _decoded(field, [pieces[i] for i in own], [outer[i] for i in own]), strict=True):
            out[i] = labels
        low = high
    return out


def _decoded(field: Field, pieces: list[np.ndarray], outer: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    k = len(LABELS)
    t = field.transitions
    n = np.array([len(p) for p in pieces])
    longest = int(n.max())
    e = np.zeros((len(pieces), longest, k))
    for j, piece in enumerate(pieces):
        e[j, : n[j]] = piece
    first, last = np.array(outer).T
    best = e[:, 0] + t[first, :k]
    back = np.zeros((len(pieces), longest, k), np.int8)
    ended = best.copy()
    for i in range(1, longest):
        paths = best[:, :, None] + t[None, :k, :k]
        back[:, i] = paths.argmax(1)
        best = paths.max(1) + e[:, i]
        ended[i < n] = best[i < n]
    at = (ended + t[:k, last].T).argmax(1)
    labels = np.zeros((len(pieces), longest), np.int8)
    rows = np.arange(len(pieces))
    for i in range(longest - 1, -1, -1):
        labels[rows, i] = at
        at = np.where((i < n) & (i > 0), back[rows, i, at], at)
    for j in range(len(pieces)):
        yield labels[j, : n[j]]


def decode_long(field: Field, emitted: Callable[[int, int], np.ndarray], n: int, outer: tuple[int, int]) -> np.ndarray:
    """The same for one piece of n words whose emissions are made ``CELLS`` words at a time.

    Only the way back, a byte a word and label, is held for the whole piece.
    """
    k = len(LABELS)
    t = field.transitions
    back = np.zeros((n, k), np.int8)
    best = np.full(k, -np.inf)
    inner = t[:k, :k]
    every = np.arange(k)
    for low in range(0, n, CELLS):
        e = emitted(low, min(low + CELLS, n))
        for i in range(len(e)):
            if low + i == 0:
                best = e[0] + t[outer[0], :k]
                continue
            paths = best[:, None] + inner
            back[low + i] = way = paths.argmax(0)
            best = paths[way, every] + e[i]
    labels = np.zeros(n, np.int8)
    at = int((best + t[:k, outer[1]]).argmax())
    for i in range(n - 1, -1, -1):
        labels[i] = at
        at = int(back[i, at])
    return labels


# Applying it

_STRIP = b".,;:!?()[]<>\"'"
_HOT = np.zeros(256, bool)
_HOT[[*range(0x30, 0x3A), ord("@"), ord("+")]] = True
_CUES = (b"at", b"dot", b"[at]", b"[dot]")


_SPELLED = re.compile(r"\S+\s+\[?at\]?\s+\S+\s+\[?dot\]?\s+[A-Za-z]{2,}")


def _accept(label: str, text: str) -> bool:
    """Whether what the field marks can be personal data at all."""
    n = len(_digits(text))
    if label == "PHONE":
        return 7 <= n <= 15 and not re.search("[A-Za-z]", text)
    if label == "CARD":
        return 14 <= n <= 19 and _luhn(_digits(text))
    if label == "IP":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(_SPELLED.fullmatch(text) or re.fullmatch(r"[^\s@]+@[A-Za-z0-9][^\s@]+", text))


def field_spans(field: Field, raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, str, int]]]:
    """For each row of a slice the (first byte, label, end byte) of marked runs of words."""
    starts, ends, bounds = bytescan.words(raw, at)
    rows = len(at) - 1
    found: list[list[tuple[int, str, int]]] = [[] for _ in range(rows)]
    if not len(starts):
        return found
    data = raw.tobytes()
    hot_before = np.concatenate(([0], np.cumsum(_HOT[raw])))
    wanted = hot_before[ends] > hot_before[starts]
    # Cue words that spell out an address count as hot, so that the margin need not hold for them.
    short = np.flatnonzero((ends - starts <= 7) & ~wanted)
    letters = raw[starts[short]]
    short = short[np.isin(letters, [ord("a"), ord("d"), ord("["), ord("("), ord('"'), ord("'")])]
    for i in short:
        if data[starts[i] : ends[i]].strip(b".,;:!?()\"'") in _CUES:
            wanted[i] = True
    if not field.anchored:
        wanted[:] = True
    owner = np.searchsorted(bounds, np.arange(len(starts)), "right") - 1
    hot = np.flatnonzero(wanted)
    near = np.zeros(len(starts), bool)
    for d in (-1, 0, 1):
        j = hot + d
        ok = (j >= 0) & (j < len(starts))
        ok[ok] = owner[j[ok]] == owner[hot[ok]]
        near[j[ok]] = True
    chosen = np.flatnonzero(near)
    if not len(chosen):
        return found
    cuts = np.flatnonzero((np.diff(chosen) > 1) | (np.diff(owner[chosen]) > 0)) + 1
    edge = len(LABELS)

    def emitted(a: int, b: int, row: int) -> np.ndarray:
        low, high = max(a - 1, bounds[row]), min(b + 1, bounds[row + 1])
        shapes = [shape(data[starts[i] : ends[i]].decode()) for i in range(low, high)]
        return field.emissions(shapes)[a - low : b - low]

    def decoded() -> Iterator[tuple[np.ndarray, int, int]]:
        """(labels, first word, row) of every run; short runs wait until they fill a batch."""
        held: list[tuple[np.ndarray, tuple[int, int], int, int]] = []
        size = 0
        for run in np.split(chosen, cuts):
            a, b = int(run[0]), int(run[-1]) + 1
            row = int(owner[a])
            ends_at = (edge if a == bounds[row] else 0, edge if b == bounds[row + 1] else 0)
            if b - a > CELLS:
                yield decode_long(field, lambda x, y: emitted(a + x, a + y, row), b - a, ends_at), a, row  # noqa: B023
                continue
            held.append((emitted(a, b, row), ends_at, a, row))
            size += b - a
            if size > 4 * CELLS:
                yield from flushed(held)
                held, size = [], 0
        if held:
            yield from flushed(held)

    def flushed(held: list) -> Iterator[tuple[np.ndarray, int, int]]:
        for labels, (_, _, a, row) in zip(viterbi(field, [h[0] for h in held], [h[1] for h in held]), held, strict=True):
            yield labels, a, row

    for labels, a, row in decoded():
        i = 0
        while i < len(labels):
            j = i + 1
            while j < len(labels) and labels[j] == labels[i]:
                j += 1
            if labels[i]:
                first, last = int(starts[a + i]), int(ends[a + j - 1])
                piece = data[first:last]
                first += len(piece) - len(piece.lstrip(_STRIP))
                piece = piece.strip(_STRIP)
                if piece and _accept(LABELS[labels[i]], piece.decode(errors="replace")):
                    found[row].append((first - int(at[row]), LABELS[labels[i]], first - int(at[row]) + len(piece)))
            i = j
    return found


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in bytescan.slices(batch.column(1)):
                marked = field_spans(field, raw, at)
                data = raw.tobytes()
                spans: list[list[tuple[int, str, int]]] = []
                counts = np.zeros((b - a, len(KINDS)), np.int64)
                digests: list[str] = []
                for r in range(b - a):
                    encoded = data[at[r] : at[r + 1]]
                    text = encoded.decode()
                    base = base_matches(text)
                    good = sorted((s, k, e) for s, k, e, ok in base if ok)
                    for _, k, _ in good:
                        counts[r, k] += 1
                    own = [f"{KINDS[k]}:{s}:{e}" for s, k, e in good]
                    digests.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                    rows = [(s, k, KINDS[k], e) for s, k, e in good]
                    for first, label, last in marked[r]:
                        s = len(encoded[:first].decode())
                        e = s + len(encoded[first:last].decode())
                        if all(e <= x[0] or s >= x[2] for x in good):
                            rows.append((s, len(KINDS) + LABELS.index(label), f"field_{label.lower()}", e))
                    spans.append([(s, kind, e) for s, _, kind, e in sorted(rows)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *[pa.array(counts[:, k]) for k in range(len(KINDS))],
                        pa.array(digests, pa.string()),
                        pa.array([",".join(f"{k}:{s}:{e}" for s, k, e in row) for row in spans], pa.string()),
                    ],
                    names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    return run


def find_personal_data(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_words: int = 100_000
) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs.

    ``labelled`` has (sentence, place, word, label); whole sentences in order of their number, of at most ``max_words``
    words together, are used to train.
    """
    table = labelled_rows() if labelled is None else first_sentences(labelled, max_words)
    sentences: dict[int, list[tuple[int, str, str]]] = {}
    for sentence, place, word, label in table:
        sentences.setdefault(sentence, []).append((place, word, label))
    field = train([([w for _, w, _ in sorted(s)], [x for _, _, x in sorted(s)]) for s in sentences.values()])
    texts = docs.select(id_col, text_col)
    kind = texts.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return texts.mapInArrow(_find(field), columns).withColumnRenamed("id", id_col)


def first_sentences(labelled: DataFrame, max_words: int) -> list[tuple[int, str, str, str]]:
    """(sentence, place, word, label) of the first whole sentences with at most so many words together."""
    names = labelled.columns[:4]
    sizes = labelled.groupBy(names[0]).agg(F.count("*").alias("n")).orderBy(names[0]).limit(max_words).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > max_words:
            break
        last = r[0]
    if last is None:
        raise ValueError(f"no labelled sentence has at most {max_words} words")
    return [tuple(r) for r in labelled.select(*names).where(F.col(names[0]) <= last).collect()]


def labelled_rows(sentences: int = 300, seed: int = 11) -> list[tuple[int, int, str, str]]:
    """The small labelled table: sentences made by rule from frames of invented words and personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    number = lambda n: "".join(str(rng.integers(10)) for _ in range(n))

    def word() -> str:
        w = "".join(pick("an", "be", "co", "du", "el", "fi", "gor", "hin", "ist", "ka") for _ in range(rng.integers(1, 4)))
        return pick(w, w, w, w.capitalize(), w + ",", w + ".", w.upper(), f"({w})", "--", "|", w + ";")

    def personal() -> list[tuple[str, str]]:
        kind = pick("EMAIL", "EMAIL", "IP", "CARD", "PHONE", "PHONE", "PHONE")
        name = word().strip(".,;()|-").lower() or "an"
        if kind == "EMAIL":
            text = pick(
                f"{name}@{name}.com", f"{name}.{name}{number(2)}@mail.{name}.org", f"{name} at {name} dot com",
                f"{name} [at] {name} [dot] org", f"{name}{number(1)}@{name}.example.net",
            )
        elif kind == "IP":
            text = ".".join(str(rng.integers(1, 256)) for _ in range(4))
        elif kind == "CARD":
            text = pick(number(16), f"{number(4)} {number(4)} {number(4)} {number(4)}", "-".join(number(4) for _ in range(4)))
        else:
            text = pick(
                f"+{number(2)} {number(3)} {number(7)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}",
                f"{number(3)}.{number(3)}.{number(4)}", f"0{number(3)} {number(3)} {number(4)}", f"+{number(1)}-{number(3)}-{number(3)}-{number(4)}",
                f"+{number(1)} {number(3)} {number(3)}-{number(4)}", f"0{number(3)}/{number(7)}",
            )
        text = pick(text, text, text + ".", text + ",")
        return [(w, kind) for w in text.split()]

    def harmless() -> list[tuple[str, str]]:
        text = pick(
            number(1), number(2), f"20{number(2)}", f"20{number(2)}-0{number(1)}-1{number(1)}", f"1{number(1)}:{number(2)}", f"{number(2)}.{number(1)}",
            f"${number(2)}.{number(2)}", f"{number(2)}%", f"v{number(1)}.{number(1)}.{number(1)}", f"{number(1)}-{number(1)}", f"{number(3)},{number(3)}",
            f"item{number(2)}", f"{number(1)}st", f"a{number(3)}f{number(4)}be{number(5)}c", f"{number(1)}+{number(1)}", "@an", f"{number(3)}", f"{number(4)}",
            f"at the {word()}", f"the dot {word()}", f"{number(3)}-{number(4)}", f"{number(5)}", f"{number(8)}", f"{number(20)}", f"{number(11)}",
        )
        return [(w, "O") for w in text.split()]

    rows = []
    for s in range(sentences):
        words: list[tuple[str, str]] = []
        for _ in range(rng.integers(2, 5)):
            words += [(word(), "O") for _ in range(rng.integers(1, 6))]
            words += pick(personal, harmless, harmless)() if rng.random() < 0.8 else []
        words += [(word(), "O") for _ in range(rng.integers(0, 3))]
        rows += [(s, i, w, x) for i, (w, x) in enumerate(words)]
    return rows


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
