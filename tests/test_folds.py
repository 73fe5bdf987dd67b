"""Rolling folds against the rules applied case by case."""

import math
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import boosting, folds
from tallyforge.operators.survival import KEYS, LEVELS
from tallyforge.plans import evaluation, fixtures

SF = "/root/testdata/sf0.001"
GRID = (100, 365, 730)
RULES = folds.Rules(GRID, training_cases=8, certify_cases=6, certify_error=0.25, slice_cases=10)


def made(spark):
    """Two districts that behave unlike each other, a small third, an unsupported family, nulls, repeated rows; some years of each."""
    rows, n = [], 0
    for year in range(2000, 2008):
        for k in range(36):
            district = "ab"[k % 2] if k < 32 else "c"
            family = "unsupported" if k % 12 == 11 else "tort" if k % 3 else "civil"
            days = 40 + 37 * ((k * 7 + year) % 25) + (300 if district == "b" else 0)
            event = days < 900
            rows.append((n, district, family, None if k % 16 == 5 else "1", str(k % 2), date(year, 1 + k % 12, 1 + k % 28), days if event else 1500, event))
            n += 1
    rows += rows[:10]
    return spark.createDataFrame(rows, "id int, district_code string, nature_family string, jurisdiction_code string, origin_code string, filed_date date, duration_days int, event_observed boolean")


FOLDS = [
    folds.Fold("one", ("2000-01-01", "2003-12-31"), ("2004-01-01", "2004-12-31"), ("2005-01-01", "2005-12-31")),
    folds.Fold("two", ("2000-01-01", "2004-12-31"), ("2005-01-01", "2005-12-31"), ("2006-01-01", "2007-12-31")),
]


def survival_at(cases, t):
    s = 1.0
    for day in sorted({c["duration_days"] for c in cases if c["duration_days"] <= t}):
        risk = sum(c["duration_days"] >= day for c in cases)
        s *= 1 - sum(c["duration_days"] == day and c["event_observed"] for c in cases) / risk
    return s


def plain(cases, fold, rules):
    window = lambda w: [c for c in cases if w[0] <= c["filed_date"].isoformat() <= w[1]]
    end = date.fromisoformat(fold.train[1])
    recent = [c for c in window(fold.train) if c["filed_date"] > end.replace(year=end.year - rules.years) and c["nature_family"] != "unsupported"]
    groups = defaultdict(list)
    for c in recent:
        for level, keys in LEVELS:
            groups[level, *[c[k] for k in keys]].append(c)
    curves = {k: [1 - survival_at(v, t) for t in rules.grid] for k, v in groups.items() if len(v) >= rules.training_cases}

    def route(c, allowed=None):
        if c["nature_family"] == "unsupported":
            return None
        for level, keys in LEVELS:
            key = (level, *[c[k] for k in keys])
            if key in curves and (allowed is None or key in allowed):
                return key
        return None

    y = lambda c, t: float(c["event_observed"] and c["duration_days"] <= t)
    pairs = [(math.log(q / (1 - q)), y(c, t)) for c in window(fold.validate) if (key := route(c)) for p, t in zip(curves[key], rules.grid) for q in [min(max(p, 1e-6), 1 - 1e-6)]]
    loss = lambda a, b: sum((1 / (1 + math.exp(-(a + math.exp(b) * x))) - o) ** 2 for x, o in pairs)
    a = b = 0.0
    step = 1.0
    while step > 1e-6:
        near = [(min(max(a + i * step, -5), 5), min(max(b + j * step, -math.log(4)), math.log(4))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        best = min(near, key=lambda v: loss(*v))
        if loss(*best) < loss(a, b):
            a, b = best
        else:
            step /= 2
    calibrated = {k: [1 / (1 + math.exp(-(a + math.exp(b) * math.log(q / (1 - q))))) for p in v for q in [min(max(p, 1e-6), 1 - 1e-6)]] for k, v in curves.items()}
    checked = defaultdict(list)
    for c in window(fold.validate):
        if key := route(c):
            checked[key].append(c)
    at = rules.places
    allowed = {
        k for k, v in checked.items()
        if len(v) >= rules.certify_cases and max(abs(calibrated[k][i] - sum(y(c, rules.grid[i]) for c in v) / len(v)) for i in at) <= rules.certify_error
    }
    assessed = window(fold.assess)
    known = [(c, calibrated[key]) for c in assessed if (key := route(c, allowed))]
    errors = [abs(sum(y(c, rules.grid[i]) - p[i] for c, p in known) / len(known)) for i in at]
    brier = 0.0
    for c, p in known:
        square = [(p[i] - y(c, t)) ** 2 for i, t in enumerate(rules.grid)]
        brier += sum((square[i] + square[i + 1]) / 2 * (rules.grid[i + 1] - rules.grid[i]) for i in range(len(square) - 1)) / (rules.grid[-1] - rules.grid[0])
    slices = defaultdict(list)
    for c, p in known:
        for k in KEYS:
            slices[k, c[k]].append([y(c, rules.grid[i]) - p[i] for i in at])
    worst = [max(abs(sum(r[i] for r in v) / len(v)) for i in range(len(at))) for v in slices.values() if len(v) >= rules.slice_cases]
    return (len(assessed), len(known), *errors, brier / len(known), max(worst), len(worst), len(allowed), a, math.exp(b))


NAMES = ("eligible_cases", "estimated_cases", "abs_error_365", "abs_error_730", "brier", "worst_slice_error", "slices", "certified_keys", "intercept", "slope")


def test_folds_case_by_case(spark):
    rows = made(spark)
    cases = [r.asDict() for r in rows.collect()]
    found = {r["fold"]: tuple(r[n] for n in NAMES) for r in folds.rolling_folds(rows.repartition(3), FOLDS, RULES).collect()}
    for fold in FOLDS:
        want = plain(cases, fold, RULES)
        assert found[fold.name] == pytest.approx(want, abs=2e-3), fold.name
        assert found[fold.name][:2] == want[:2] and found[fold.name][6:8] == want[6:8]
    assert 0 < found["one"][1] < found["one"][0]


def test_an_uncertified_key_falls_through_to_the_next_wider_one(spark):
    rows = spark.createDataFrame(
        [("f", "a", [("exact", "x", [0.1]), ("nature", "n", [0.3])]), ("f", "b", [("exact", "z", [0.2])])],
        "fold string, district_code string, candidates array<struct<level:string,key:string,p:array<double>>>",
    ).select("*", *[F.lit("v").alias(k) for k in KEYS[1:]])
    keys = spark.createDataFrame([("f", "x", False), ("f", "n", True), ("g", "z", True)], "fold string, key string, certified boolean")
    out = {r["district_code"]: r["chosen"] for r in folds.covered(rows, keys).collect()}
    assert out["a"]["key"] == "n" and out["b"] is None


def test_certification_counts_each_key_apart(spark):
    """A key that is well calibrated does not certify another of its level; a small one is not certified."""
    rows = [("f", "k1", 200.0, [80.0]), ("f", "k2", 200.0, [180.0]), ("f", "k3", 199.0, [79.6])]
    df = spark.createDataFrame(rows, "fold string, key string, n double, y array<double>")
    df = df.withColumn("candidates", F.array(F.struct(F.lit("exact").alias("level"), "key", F.array(F.lit(0.4)).alias("p"))))
    rules = folds.Rules((365,), (365,), certify_cases=200, certify_error=0.1)
    out = {r["key"]: r["certified"] for r in folds.certified(df, F.array(F.lit(0.4)), rules).collect()}
    assert out == {"k1": True, "k2": False, "k3": False}


def test_incomplete_windows_are_refused(spark):
    late = made(spark).withColumn("event_observed", F.col("id") != 200)
    with pytest.raises(ValueError, match="censored before"):
        folds.rolling_folds(late.withColumn("duration_days", F.when(F.col("id") == 200, 10).otherwise(F.col("duration_days"))), FOLDS, RULES)


def test_challenger_beside_the_curves(spark):
    settings = boosting.Settings(rounds=6, depth=2, rate=0.5, least_hessian=3.0, patience=3)
    out = {r["estimator"]: r for r in folds.rolling_folds(made(spark), FOLDS[1:], RULES, settings).collect()}
    assert set(out) == {"curves", "boosted"} and out["boosted"]["eligible_cases"] == out["curves"]["eligible_cases"]
    assert 0 < out["boosted"]["brier"] < 0.25


def test_queries(spark):
    """The registered folds on the given tables, case by case."""
    cases = [r.asDict() for r in fixtures.cases(fixtures.facts(spark, SF)).select(*KEYS, "filed_date", "duration_days", "event_observed").collect()]
    found = evaluation.rolling_folds(spark, SF).collect()
    assert {r["fold"] for r in found} == {f.name for f in evaluation.FOLDS}
    for r in found:
        if r["estimated_cases"]:
            fold = next(f for f in evaluation.FOLDS if f.name == r["fold"])
            want = plain(cases, fold, evaluation.RULES)
            assert tuple(r[n] for n in NAMES)[:2] == want[:2]
            assert [r[n] for n in ("abs_error_365", "brier", "intercept")] == pytest.approx([want[2], want[4], want[8]], abs=5e-3)
