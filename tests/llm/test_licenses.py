"""License scans: planted notices, changed words, and texts without any."""

import random
import re

import numpy as np

from tallyforge.llm import licenses


def test_planted_notices(spark):
    grant = licenses.TEMPLATES["mit-grant"]
    changed = grant.replace("hereby granted", "now given").replace("publish, ", "")
    rows = [
        (1, "Été filler words. Released under the MIT License. more words", 0),
        (2, "one two\n" + changed + "\nthree", 0),
        (3, "nothing of the kind, only license talk", 0),
        (None, None, 0),
        (4, "", 0),
        (5, "Licensed under CC BY-NC 4.0. x y z Licensed under CC BY-NC 4.0.", 0),
        (6, "filler " * 30000 + "Licensed under the Apache License, Version 2.0.", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int")
    out = licenses.license_matches(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    got = sorted((r.doc_id, r.license, texts[r.doc_id][r.start : r.end]) for r in out)
    assert (1, "mit", "Released under the MIT License") in got
    assert [x[0] for x in got] == [1, 2, 5, 5, 6]
    two = next(r for r in out if r.doc_id == 2)
    assert two.license == "mit-grant" and two.matched_words == two.template_words - 3
    assert texts[2][two.start : two.end].startswith("Permission") and texts[2][two.start : two.end].endswith("Software")
    assert licenses.license_matches(docs.limit(0)).count() == 0


def places(text, templates=licenses.TEMPLATES):
    import numpy as np

    index = licenses.build_index(templates)
    raw = np.frombuffer(text.encode(), np.uint8)
    *_, words = licenses._words(raw, np.array([0, len(raw)]))
    return [(index.names[t], m, a, b) for t, m, a, b in licenses.scan_words(words, index, licenses.MIN_COVERAGE)]


def test_adjacent_copies():
    for name, notice in licenses.TEMPLATES.items():
        n = next(p[1] for p in places(notice) if p[0] == name)
        for copies in (2, 3, 5):
            for gap in range(10):
                got = sorted(p for p in places((notice + " x" * gap + " ") * copies) if p[0] == name)
                assert got == [(name, n, k * (n + gap), k * (n + gap) + n) for k in range(copies)], (name, copies, gap)
    got = sorted(p for p in places("Released under the BSD License. " + licenses.TEMPLATES["mit"]) if p[0] == "mit")
    assert got == [("mit", 4, 0, 5), ("mit", 5, 5, 10)]
    got = sorted(p for p in places("Released under the MIT thing. " + licenses.TEMPLATES["mit"]) if p[0] == "mit")
    assert got == [("mit", 4, 0, 4), ("mit", 5, 5, 10)]


def test_short_notices_with_changed_words():
    assert [p[:2] for p in places("x Released under MIT License x")] == [("mit", 4)]
    for name, notice in licenses.TEMPLATES.items():
        words = notice.replace(".", " ").replace("-", " ").replace(",", " ").split()
        if len(words) < 16:
            for k in range(1, len(words) - 1):
                for middle in ([], ["other"]):
                    got = places(" ".join(words[:k] + middle + words[k + 1 :]))
                    assert (name, len(words) - 1) in [p[:2] for p in got], (name, k, middle)


def full_alignment(doc, template):
    """(score, matched) of the best local alignment without any band, by plain dynamic programming."""
    best = (0, 0)
    row = [(0, 0)] * (len(doc) + 1)
    for t in template:
        new = [(0, 0)]
        for j, d in enumerate(doc):
            same = t == d
            s, m = row[j]
            options = [(s + (2 if same else -1), m + same), (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1]), (0, 0)]
            new.append(max(options))
        row = new
        best = max(best, max(row))
    return best


def test_against_full_alignment():
    """A noisy notice among other words is found where the best alignment of all covers it, with as many matched words."""
    rng = random.Random(6)
    for name in ("mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0"):
        template = [w.lower() for w in re.findall("[A-Za-z0-9]+", licenses.TEMPLATES[name])]
        for _ in range(60):
            noisy = [rng.choice(["other", None]) if rng.random() < 0.12 else w for w in template]
            filler = [f"x{k}" for k in range(rng.randrange(1, 30))]
            doc = filler + [w for w in noisy if w] + filler[::-1]
            _, matched = full_alignment(doc, template)
            got = [p for p in places(" ".join(doc)) if p[0] == name]
            if matched >= licenses.MIN_COVERAGE * len(template):
                assert [p[1] for p in got] == [matched], (name, doc)
            else:
                assert got == [], (name, doc)


def test_whole_texts_are_found(spark):
    """Whole license texts with changed words; repeated rows and null ids are scanned one by one."""
    text = licenses.TEMPLATES["mit-text"]
    changed = text.replace("AUTHORS", "CONTRIBUTORS").replace("Software is furnished", "Software was given")
    rows = [(None, "top\n" + changed), (7, licenses.TEMPLATES["isc-text"]), (7, licenses.TEMPLATES["isc-text"])]
    out = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license) for r in out) == [("7", "isc-text")] * 2 + [("None", "mit-grant"), ("None", "mit-text")]
    whole = next(r for r in out if r.license == "mit-text")
    assert whole.matched_words == whole.template_words - 3


def test_dense_hits_are_ruled_out_before_they_are_aligned(monkeypatch):
    """A text full of a notice's common words takes no alignment; the notice inside it is found all the same."""
    calls = []
    align = licenses.align
    monkeypatch.setattr(licenses, "align", lambda *a, **k: (calls.append(1), align(*a, **k))[1])
    dense = "the cat sat under the table and looked " * 5000
    assert places(dense) == [] and not calls
    text = dense + "Released under the MIT License. " + dense
    assert [(x[0], x[1]) for x in places(text)] == [("mit", 5)] and 0 < len(calls) < 60


def test_the_bound_never_rules_out_a_match():
    rng = random.Random(5)
    index = licenses.build_index(licenses.TEMPLATES)
    for _ in range(60):
        t = rng.randrange(len(index.texts))
        template = index.texts[t].tolist()
        doc = [rng.randrange(9) for _ in range(rng.randrange(30))]
        for w in template:
            x = rng.random()
            doc += [w, rng.randrange(9)] if x < 0.05 else [rng.randrange(9)] if x < 0.12 else [] if x < 0.15 else [w]
        words = np.array(doc + [rng.randrange(9) for _ in range(rng.randrange(30))], np.uint64)
        order = np.argsort(words, kind="stable")
        for diagonal in range(-8, 40):
            matched, *_ = licenses.align(words, index.texts[t], diagonal)
            assert licenses.possible(words, order, index.texts[t], np.array([diagonal]), matched)[0]


def test_recall_of_winnowed_templates():
    """With 18 % of their words changed at random, at least nine of ten long templates are found (here, nearly all)."""
    rng = random.Random(11)
    filler = [f"word{i}" for i in range(50)]
    for name in ("mit-text", "isc-text", "bsd-clause", "apache-notice", "gpl-notice"):
        if name not in licenses.TEMPLATES:
            continue
        words = licenses.TEMPLATES[name].split()
        found = 0
        for _ in range(40):
            own = [rng.choice(filler) if rng.random() < 0.18 else w for w in words]
            while sum(a == b for a, b in zip(own, words)) < 0.81 * len(words):
                k = rng.randrange(len(words))
                own[k] = words[k]
            text = " ".join([*rng.choices(filler, k=20), *own, *rng.choices(filler, k=20)])
            found += any(x[0] == name for x in places(text))
        assert found >= 36, (name, found)


def test_many_templates_in_shards(spark):
    docs = spark.createDataFrame([(i, "so it begins. " + t + " and ends.") for i, t in enumerate(licenses.TEMPLATES.values())], "doc_id long, text string")
    rows = lambda most: sorted(map(tuple, licenses.license_matches(docs, shard_words=most).collect()))
    assert rows(1) == rows(60) == rows(licenses.SHARD_WORDS) and len(rows(60)) >= len(licenses.TEMPLATES)
    assert [len(x) for x in licenses.shards_of({"a": "x y", "b": "x", "c": "x y z w"}, 3)] == [2, 1]
    assert licenses.license_matches(docs, templates={}).count() == 0
