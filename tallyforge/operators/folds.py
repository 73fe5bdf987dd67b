"""Rolling development folds: routed curves and a boosted challenger, jointly calibrated, certified by route key, assessed.

For each fold, curves come from the last years of the training window. A case's
route candidates are the levels whose curve has enough cases, from the most to
the least exact. One logit-affine calibration over the whole time grid is fitted
on the validation window; a route key (a level with its values) is certified
there, on calibrated probabilities, by its number of cases and its worst error
at the horizons. In the assessed window a case takes its first candidate that is
certified; without one it counts as not estimated. Windows with a case that is
censored before the last time are refused.

All folds are computed together. Cases are read once and counted by fold, role,
route values, intake quarter and duration; everything after this works on the
counts (units), whose outcome at each time is a number of resolved cases. What
reaches the driver is bounded: counts by bin of a probability for a calibration.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.semantics import UNSUPPORTED
from tallyforge.operators import boosting, calibration, survival
from tallyforge.operators.survival import KEYS, LEVELS
from tallyforge.sources.shared import written


@dataclass(frozen=True)
class Fold:
    """Filing windows of one development fold: [start, end] as dates."""

    name: str
    train: tuple[str, str]
    validate: tuple[str, str]
    assess: tuple[str, str]

    def recent(self, years: int) -> tuple[str, str]:
        """The last years of the training window, from which curves are made."""
        end = date.fromisoformat(self.train[1])
        try:
            back = end.replace(year=end.year - years)
        except ValueError:  # the 29th of February
            back = end.replace(year=end.year - years, day=28)
        return max(self.train[0], (back + timedelta(days=1)).isoformat()), self.train[1]


@dataclass(frozen=True)
class Rules:
    """The reference's thresholds by default (fixed values)."""

    grid: tuple[int, ...]
    horizons: tuple[int, ...] = (365, 730)
    training_cases: int = 500
    certify_cases: int = 200
    certify_error: float = 0.10
    slice_cases: int = 200
    years: int = 3

    @property
    def places(self) -> list[int]:
        return [self.grid.index(h) for h in self.horizons]


def tagged(cases: DataFrame, folds: list[Fold], years: int) -> DataFrame:
    """Cases once for each fold and role (train, curve, validate, assess) whose window has their filing date."""
    inside = lambda w: F.col("filed_date").between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))
    roles = [
        F.when(inside(w), F.struct(F.lit(f.name).alias("fold"), F.lit(role).alias("role")))
        for f in folds
        for role, w in (("train", f.train), ("curve", f.recent(years)), ("validate", f.validate), ("assess", f.assess))
    ]
    return cases.withColumn("_tag", F.explode(F.array_compact(F.array(*roles)))).select("*", "_tag.*").drop("_tag")


def counted(cases: DataFrame, folds: list[Fold], rules: Rules) -> DataFrame:
    """(fold, role, route values, filing year and quarter, duration, event, n), written."""
    rows = tagged(cases, folds, rules.years).select(
        "fold", "role", *KEYS, F.year("filed_date").alias("filing_year"), F.quarter("filed_date").alias("filing_quarter"), "duration_days", "event_observed"
    )
    return written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "folds")


def _curves(counts: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """Curves by fold and key with enough cases: (fold, keys, p), p the chance of an event by each time of the grid."""
    by = ["fold", *keys]
    counts = counts.groupBy(*by, "duration_days").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    curves = survival.at_times(survival.curve(counts, by), by, list(rules.grid)).where(F.col("support") >= rules.training_cases)
    return curves.select(*by, F.array(*[1 - F.col(f"s_{t}") for t in rules.grid]).alias("p"))


def units(counts: DataFrame, rules: Rules) -> DataFrame:
    """Validation and assessment counts with outcomes (y, an array by time) and route candidates (level, key, p), written."""
    y = [F.sum(F.when(F.col("event_observed") & (F.col("duration_days") <= t), F.col("n")).otherwise(0)).cast("double") for t in rules.grid]
    by = ["fold", "role", *KEYS, "filing_year", "filing_quarter"]
    out = counts.where("role IN ('validate', 'assess')").groupBy(*by).agg(F.sum("n").cast("double").alias("n"), F.array(*y).alias("y"))
    exact = counts.where((F.col("role") == "curve") & (F.col("nature_family") != UNSUPPORTED))
    exact = exact.groupBy("fold", *KEYS, "duration_days").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("event_observed"), F.col("n")).otherwise(0)).alias("d"))
    candidates: list[Column] = []
    for level, keys in LEVELS:
        c = _curves(exact, keys, rules).select(*[F.col(k).alias(f"_{k}") for k in ("fold", *keys)], F.col("p").alias(f"_p_{level}"))
        same = out["fold"] == c["_fold"]
        for k in keys:
            same = same & out[k].eqNullSafe(c[f"_{k}"])
        out = out.join(c, same, "left").drop(*[f"_{k}" for k in ("fold", *keys)])
        key = F.to_json(F.struct(F.lit(level).alias("level"), *keys))
        candidates.append(F.when(F.col(f"_p_{level}").isNotNull(), F.struct(F.lit(level).alias("level"), key.alias("key"), F.col(f"_p_{level}").alias("p"))))
    known = F.coalesce(F.col("nature_family") != UNSUPPORTED, F.lit(False))
    found = F.when(known, F.array_compact(F.array(*candidates)))
    return written(out.select(*by, "n", "y", F.coalesce(found, F.array().cast("array<struct<level:string,key:string,p:array<double>>>")).alias("candidates")), "units")


def fit_jointly(validated: DataFrame, p: Column, rules: Rules) -> dict[str, tuple[float, float]]:
    """(intercept, log slope) by fold, of least squared error over all cases and times of the grid."""
    pairs = validated.select("fold", "n", F.explode(F.arrays_zip(p.alias("p"), F.col("y").alias("y"))).alias("x")).select("fold", "n", F.col("x.p").alias("p"), F.col("x.y").alias("y"))
    width = 2 * math.log(1 / calibration.EDGE) / calibration.BINS
    x = calibration.logit(F.col("p"))
    bins = pairs.groupBy("fold", F.floor(x / width).alias("bin")).agg(
        (F.sum(x * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"), (F.sum("y") / F.sum("n")).alias("y")
    )
    by_fold: dict[str, list] = {}
    for r in bins.orderBy("fold", "bin").collect():
        by_fold.setdefault(r["fold"], []).append((r["x"], r["n"], r["y"]))
    return {f: calibration.least_logit_affine(*map(list, zip(*rows, strict=True))) for f, rows in by_fold.items()}


def _calibrated(p: Column, fitted: dict[str, tuple[float, float]]) -> Column:
    """p (an array) under its fold's calibration."""
    a = b = F.lit(0.0)
    for fold, (x, y) in fitted.items():
        a, b = F.when(F.col("fold") == fold, x).otherwise(a), F.when(F.col("fold") == fold, math.exp(y)).otherwise(b)
    return F.transform(p, lambda v: 1 / (1 + F.exp(-(a + b * calibration.logit(v)))))


def certified(validated: DataFrame, p: Column, rules: Rules) -> DataFrame:
    """(fold, key, cases, max_abs_error, certified) of each first candidate of the validation window."""
    rows = validated.where(F.size("candidates") > 0).withColumn("_p", p)
    errors = [F.abs(F.sum(F.col("_p")[k] * F.col("n")) - F.sum(F.col("y")[k])) / F.sum("n") for k in rules.places]
    worst = F.greatest(*errors) if len(errors) > 1 else errors[0]
    out = rows.groupBy("fold", F.col("candidates")[0]["key"].alias("key")).agg(F.sum("n").cast("long").alias("cases"), worst.alias("max_abs_error"))
    return out.withColumn("certified", (F.col("cases") >= rules.certify_cases) & (F.col("max_abs_error") <= rules.certify_error))


def covered(assessed: DataFrame, keys: DataFrame) -> DataFrame:
    """Assessed units with their first certified candidate (``chosen``, null without one)."""
    by = ["fold", *KEYS]
    routes = assessed.groupBy(*by).agg(F.first("candidates").alias("candidates"))  # the same for all units of the route values
    each = routes.select(*by, F.posexplode("candidates").alias("place", "c"))
    kept = keys.where("certified").select(F.col("fold").alias("_f"), F.col("key").alias("_k"))
    first = each.join(kept, (F.col("fold") == F.col("_f")) & (F.col("c.key") == F.col("_k"))).groupBy(*by).agg(F.min_by("c", "place").alias("chosen"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in by], "chosen")
    same = assessed["fold"] == first["_fold"]
    for k in KEYS:
        same = same & assessed[k].eqNullSafe(first[f"_{k}"])
    return assessed.join(first, same, "left").drop(*[f"_{c}" for c in by])


def assessment(rows: DataFrame, p: Column, rules: Rules) -> DataFrame:
    """By fold: cases, estimated cases, coverage, absolute error at each horizon, worst slice error and mean integrated Brier score."""
    rows = rows.withColumn("p", F.when(F.col("chosen").isNotNull(), p))
    n, at = F.when(F.col("p").isNotNull(), F.col("n")), rules.places
    error = lambda k: F.abs(F.sum(F.col("y")[k] - F.col("p")[k] * F.col("n"))) / F.sum(n)
    # A unit's squared errors: n p^2 - 2 p y + y, as outcomes are 0 or 1.
    square = [F.col("n") * F.col("p")[k] ** 2 - 2 * F.col("p")[k] * F.col("y")[k] + F.col("y")[k] for k in range(len(rules.grid))]
    area = sum(((square[k] + square[k + 1]) / 2 * (b - a) for k, (a, b) in enumerate(zip(rules.grid[:-1], rules.grid[1:], strict=True))), F.lit(0.0))
    rows = rows.withColumn("area", F.when(F.col("p").isNotNull(), area / (rules.grid[-1] - rules.grid[0])))
    whole = rows.groupBy("fold").agg(
        F.sum("n").cast("long").alias("eligible_cases"), F.coalesce(F.sum(n), F.lit(0.0)).cast("long").alias("estimated_cases"),
        *[error(k).alias(f"abs_error_{h}") for k, h in zip(at, rules.horizons, strict=True)], (F.sum("area") / F.sum(n)).alias("brier"),
    )
    value = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in KEYS])).alias("s")
    slices = rows.where("p IS NOT NULL").select("*", value).groupBy("fold", "s").agg(F.sum("n").alias("m"), F.greatest(F.lit(0.0), *[error(k) for k in at]).alias("e"))
    worst = slices.where(F.col("m") >= rules.slice_cases).groupBy("fold").agg(F.max("e").alias("worst_slice_error"), F.count("*").alias("slices"))
    out = whole.join(worst, "fold", "left")
    return out.withColumn("coverage", F.col("estimated_cases") / F.col("eligible_cases")).withColumn("slices", F.coalesce("slices", F.lit(0).cast("long")))


def _judged(found: DataFrame, p_validate: Column, p_assess: Column, rules: Rules, name: str) -> tuple[DataFrame, DataFrame]:
    """(one row a fold, assessed units with p) of one estimator."""
    validated = found.where("role = 'validate'")
    fitted = fit_jointly(validated.where(F.size("candidates") > 0), p_validate, rules)
    keys = certified(validated, _calibrated(p_validate, fitted), rules)
    rows = covered(found.where("role = 'assess'"), keys)
    calibrated = _calibrated(p_assess, fitted)
    out = assessment(rows, calibrated, rules)
    n = keys.groupBy("fold").agg(F.count_if("certified").alias("certified_keys"))
    params = F.lit(None).cast("struct<intercept:double,slope:double>")
    for fold, (a, b) in fitted.items():
        params = F.when(F.col("fold") == fold, F.struct(F.lit(a).alias("intercept"), F.lit(math.exp(b)).alias("slope"))).otherwise(params)
    out = out.join(n, "fold", "left").withColumn("_x", params).select("*", "_x.*").drop("_x").withColumn("estimator", F.lit(name))
    return out, rows.withColumn("p", F.when(F.col("chosen").isNotNull(), calibrated))


def rolling_folds(cases: DataFrame, folds: list[Fold], rules: Rules, challenger: boosting.Settings | None = None) -> DataFrame:
    """One row for each fold and estimator: curves, and with settings the boosted challenger."""
    late = [F.col("filed_date").between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date")) for f in folds for w in (f.validate, f.assess)]
    any_of = late[0]
    for x in late[1:]:
        any_of = any_of | x
    survival.complete_outcomes(cases.where(any_of), max(rules.grid))
    counts = counted(cases, folds, rules)
    found = units(counts, rules)
    out, _ = _judged(found, F.col("candidates")[0]["p"], F.col("chosen.p"), rules, "curves")
    if challenger:
        parts = []
        for fold in folds:
            own = counts.where(F.col("fold") == fold.name)
            train, held = (own.where(F.col("role") == role) for role in ("train", "validate"))
            model = boosting.fit(train, KEYS, ["filing_year", "filing_quarter"], settings=challenger, validation=held, weight="n")
            parts.append(model.located(found.where(F.col("fold") == fold.name)))
        located = parts[0]
        for p in parts[1:]:
            located = located.unionByName(p)
        times = [calibration.aft_probability(F.greatest("location", F.lit(0.0)), t, scale=challenger.scale) for t in rules.grid]
        p = F.array(*times)
        out = out.unionByName(_judged(located, p, p, rules, "boosted")[0])
    return out
