"""Queries over resampled intervals, development folds and the boosted challenger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import boosting, calibration, folds, survival
from tallyforge.operators.survival import KEYS
from tallyforge.plans import fixtures as fx
from tallyforge.plans import registry as core
from tallyforge.plans.registry import SEED, TIMES, query, rounded
from tallyforge.sources.shared import written

# Intervals

_EARLIER = ("1995-01-01", "1996-12-31")


@query(
    "cluster_interval",
    core._CLUSTERS
    + f""", rate AS (SELECT count(*) FILTER (event_observed AND duration_days <= 365)::DOUBLE / count(*) AS rate
  FROM cases WHERE filed_date BETWEEN DATE '{_EARLIER[0]}' AND DATE '{_EARLIER[1]}')"""
    + core._drawn_sql(
        "SELECT strftime(filed_month, '%Y-%m-%d') || '|' || district_code || '|' || nature_family || '|' || origin_code AS key, cases AS n, resolved FROM clusters",
        "key", {"n": "n", "resolved": "resolved"}, "abs((SELECT rate FROM rate) - resolved / n)",
        "(SELECT round(abs((SELECT rate FROM rate) - sum(resolved)::DOUBLE / sum(n)), 9) FROM keyed) AS abs_error",
    ),
)
def cluster_interval(spark, d):
    """The error, in a later window, of the rate that an earlier window gives."""
    rate = survival.resolution_training(fx.cases(fx.facts(spark, d)), *_EARLIER, 365).first()["rate"]
    return rounded(calibration.cluster_interval(core._clusters(spark, d), ["filed_month", "district_code", "nature_family", "origin_code"], rate, seed=SEED))


def _brier_sql(p: str) -> str:
    square = {t: f"pow({p.format(t=t)} - {core._Y[t]}, 2)" for t in TIMES}
    return "(" + " + ".join(f"({square[a]} + {square[b]}) / 2 * {b - a}" for a, b in zip(TIMES[:-1], TIMES[1:], strict=True)) + f") / {TIMES[-1] - TIMES[0]}"


@query(
    "improvement_interval",
    core._SCORED
    + core._drawn_sql(
        f"SELECT source_record_identifier, {_brier_sql('p_{t}')} AS routed, {_brier_sql('(1 - g.s_{t})')} AS flat FROM scored, km_global g WHERE p_{TIMES[0]} IS NOT NULL",
        "source_record_identifier", {"flat": "flat", "routed": "routed"}, "1 - routed / flat", "(SELECT round(1 - sum(routed) / sum(flat), 9) FROM keyed) AS improvement",
    ),
)
def improvement_interval(spark, d):
    """The routed curves against one curve for all, on the same cases."""
    train, _ = core._split(spark, d)
    routed = survival.integrated_brier(core._scored(spark, d), TIMES).withColumnRenamed("brier", "routed").where("routed IS NOT NULL")
    whole = survival.km_curves(train.where(F.col("nature_family") != "unsupported"), TIMES, []).select(*[F.col(f"s_{t}").alias(f"_s_{t}") for t in TIMES])
    flat = routed.crossJoin(F.broadcast(whole)).withColumns({f"p_{t}": 1 - F.col(f"_s_{t}") for t in TIMES})  # one row
    flat = survival.integrated_brier(flat, TIMES)
    return rounded(calibration.improvement_interval(flat, ["source_record_identifier"], "brier", "routed", seed=SEED))


# Folds

FOLDS = [
    folds.Fold(f"y{y}", ("1995-01-01", f"{y - 2}-12-31"), (f"{y - 1}-01-01", f"{y - 1}-12-31"), (f"{y}-01-01", f"{y}-12-31")) for y in (1997, 1998, 1999)
]
#: Thresholds that fit the smaller tables.
RULES = folds.Rules((30, 180, 365, 545, 730), training_cases=fx.ROUTE_SUPPORT, certify_cases=20, certify_error=0.2, slice_cases=20)
SMALL = boosting.Settings(rounds=12, depth=3, rate=0.3, least_hessian=20.0, patience=4)


def _cases(spark, d):
    """What folds and training read of the cases, written once."""
    return written(fx.cases(fx.facts(spark, d)).select("source_record_identifier", *KEYS, "filed_date", "duration_days", "event_observed"), "cases")


@query("rolling_folds")
def rolling_folds(spark, d):
    return rounded(folds.rolling_folds(_cases(spark, d), FOLDS, RULES))


@query("challenger_fold")
def challenger_fold(spark, d):
    """The last fold's curves and its boosted challenger, beside each other."""
    return rounded(folds.rolling_folds(_cases(spark, d), FOLDS[-1:], RULES, SMALL), 6)


# Challenger


def trained(spark, d) -> boosting.Model:
    rows = _cases(spark, d).where("filed_date < DATE '1998-01-01'").withColumn("filing_year", F.year("filed_date"))
    train, held = (rows.where(condition) for condition in (fx.order_key() % 5 > 0, fx.order_key() % 5 == 0))
    return boosting.fit(train, KEYS, ["filing_year"], settings=SMALL, validation=held)


@query("aft_training")
def aft_training(spark, d):
    """Mean losses of the boosted model before each round, on training cases and on the fifth that is held out."""
    model = trained(spark, d)
    rows = [(k, round(a, 6), round(b, 6), k <= len(model.trees)) for k, a, b in model.history]
    return spark.createDataFrame(rows, "round int, training_loss double, validation_loss double, kept boolean").coalesce(1)


@query("aft_forecast")
def aft_forecast(spark, d):
    """Each later case's location by the boosted model, and the chance of an event within one and two years."""
    later = fx.cases(fx.facts(spark, d)).where("filed_date >= DATE '1998-01-01'").withColumn("filing_year", F.year("filed_date"))
    rows = trained(spark, d).located(later.select("source_record_identifier", *KEYS, "filing_year"))
    chances = {f"p_{t}": calibration.aft_probability(F.greatest("location", F.lit(0.0)), t, scale=SMALL.scale) for t in (365, 730)}
    return rounded(rows.withColumns(chances).select("source_record_identifier", "location", *chances), 6)
