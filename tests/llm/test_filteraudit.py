"""Every order of filters against plain filtering, and the query against its SQL."""

import re
from itertools import permutations
from math import factorial

import duckdb
import numpy as np
import pytest

from tallyforge.llm import filteraudit


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6])
def test_swaps_visit_every_order_once(k):
    order = list(range(k))
    seen = {tuple(order)}
    for i in filteraudit.swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == factorial(k)


def test_walk_sums_only_two_steps_a_swap(monkeypatch):
    calls = []
    step = filteraudit.Walk._step
    monkeypatch.setattr(filteraudit.Walk, "_step", lambda self, i: (calls.append(i), step(self, i)))
    cells = np.random.default_rng(1).integers(0, 50, (3, 4, 32))
    list(filteraudit.orders_audited(cells, "ABCDE"))
    assert len(calls) == 5 + 2 * 119


def fails(text, doc_id, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and any(o is not None and o < doc_id for o in smaller[text]),
    }


def plain(rows, labels):
    """Applies the filters one after another, order by order."""
    by_text, good, toxic = {}, {}, {}
    for doc_id, text, *_ in rows:
        by_text.setdefault(text or "", []).append(doc_id)
    for doc_id, q, t in labels:
        if doc_id is None:
            continue
        good[doc_id] = good.get(doc_id, False) or q == 1
        toxic[doc_id] = toxic.get(doc_id, False) or t == 1
    docs = {}
    for doc_id, text, lang in rows:
        docs.setdefault(lang or "", []).append((fails(text or "", doc_id, by_text), good.get(doc_id, False), toxic.get(doc_id, False)))
    out = {}
    for part, found in docs.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = found
            for step, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = [d for d in found if d[0][f]]
                alone = sum(sum(d[0].values()) == 1 for d in failing)
                lost = [sum(d[1] for d in gone), sum(d[2] for d in gone)]
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(failing) - len(gone), alone, *lost]
                shapley[f] += len(gone)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"),
    (2, LONG, "en"),
    (2, LONG, "en"),
    (0, LONG, "fr"),
    (3, None, None),
    (4, "", ""),
    (None, "", "en"),
    (None, LONG, "en"),
    (5, "UPPER # case", "de"),
    (6, "same word " * 150, "de"),
    (7, "same word " * 150 + "\x0b|", "de"),
    (8, LONG.upper(), "it"),
    (9, " \n" + LONG + "\t", "it"),
    (10, "ÀÉ ÜÖ\x1c\x85 漢字 " * 120, "fr"),
    (11, "a" * 200_000 + " b" * 100_000, "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_rows_against_plain_filtering(spark):
    """Nulls, empty and long texts, copies, repeated rows, labels that repeat, clashing columns."""
    docs = spark.createDataFrame([(*r, 7, "x", True) for r in ROWS], "doc_id long, text string, lang string, mask int, sha string, first boolean")
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    out = filteraudit.audit(filteraudit.judged(docs.repartition(3), labels), "ABCDE").collect()
    want = plain(ROWS, LABELS)
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in out} == want and len(out) == len(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(filteraudit.judged(docs, labels), "ABCDE").collect() == []


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    out = filteraudit.op12_filter_audit(spark, d).collect()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert sorted(tuple(r) for r in out) == sorted(con.execute(filteraudit.OP12_SQL).fetchall())
