"""Kaplan-Meier curves with support fallback, and their evaluation, on sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.semantics import UNSUPPORTED

#: Routing levels from the most to the least exact, and their keys.
LEVELS = [
    ("exact", ["district_code", "nature_family", "jurisdiction_code", "origin_code"]),
    ("district_nature_origin", ["district_code", "nature_family", "origin_code"]),
    ("district_nature", ["district_code", "nature_family"]),
    ("nature_jurisdiction_origin", ["nature_family", "jurisdiction_code", "origin_code"]),
    ("nature", ["nature_family"]),
    ("global", []),
]
KEYS = LEVELS[0][1]


def sufficient_counts(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Deaths and departures by key and day: all that the estimator needs."""
    return cases.groupBy(*keys, "duration_days").agg(
        F.count("*").alias("n"), F.count_if("event_observed").alias("d")
    )


def curve(counts: DataFrame, keys: list[str]) -> DataFrame:
    """S after each day with a departure. Those who leave on a day are at risk on it."""
    part = [F.col(k) for k in keys] or [F.lit(0)]
    later = W.partitionBy(*part).orderBy(F.desc("duration_days")).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*part).orderBy("duration_days").rowsBetween(W.unboundedPreceding, 0)
    at_risk = counts.withColumn("at_risk", F.sum("n").over(later))
    return at_risk.withColumn("survival", F.product(1 - F.col("d") / F.col("at_risk")).over(earlier))


def at_times(curves: DataFrame, keys: list[str], times: list[int]) -> DataFrame:
    """S at given days: the last value at or before each; 1 before the first. ``support`` counts the key's cases."""
    measures = [F.sum("n").alias("support")]
    for t in times:
        inside = F.when(F.col("duration_days") <= t, F.col("duration_days"))
        measures.append(F.coalesce(F.max_by("survival", inside), F.lit(1.0)).alias(f"s_{t}"))
    if not keys:
        return curves.agg(*measures)
    return curves.groupBy(*keys).agg(*measures)


def km_curves(cases: DataFrame, times: list[int], keys: list[str] | None = None) -> DataFrame:
    keys = ["nature_family"] if keys is None else keys
    return at_times(curve(sufficient_counts(cases, keys), keys), keys, times)


def support_routes(cases: DataFrame, minimum: int) -> DataFrame:
    """For each case the first level whose group has enough cases; an unsupported code abstains.

    The levels' counts come from one table of exact counts, so the cases are
    shuffled once; wider levels are windows over that table.
    """
    exact = cases.groupBy(*KEYS).agg(F.count("*").alias("n"))
    for name, keys in LEVELS[:-1]:
        exact = exact.withColumn(f"n_{name}", F.sum("n").over(W.partitionBy(*keys)))
    route: Column = F.when(F.col("nature_family") == UNSUPPORTED, "abstain")
    for name, _ in LEVELS[:-1]:
        route = route.when(F.col(f"n_{name}") >= minimum, name)
    return exact.select(*KEYS, "n", route.otherwise("global").alias("route"))


def routed_probability(train: DataFrame, cases: DataFrame, times: list[int], minimum: int) -> DataFrame:
    """1 - S of each case's route at each time; null where the route abstains.

    One table of exact counts by the finest key and day is made from the
    training cases; every level's curve is rolled up from it. Curves have a row
    for each key of a level. Each level joins once; the first with enough
    support gives the value.
    """
    exact = sufficient_counts(train.where(F.col("nature_family") != UNSUPPORTED), KEYS)
    out = cases.withColumn("_all", F.lit(0))
    values: dict[int, list[Column]] = {t: [] for t in times}
    names: list[Column] = []
    for name, keys in LEVELS:
        counts = exact.groupBy(*keys, "duration_days").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        c = at_times(curve(counts, keys), keys, times).where(F.col("support") >= (minimum if keys else 1))
        marked = [F.col(f"s_{t}").alias(f"_{name}_{t}") for t in times]
        if keys:
            c = c.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], *marked)
            condition = out[keys[0]].eqNullSafe(c[f"_{name}_{keys[0]}"])
            for k in keys[1:]:
                condition = condition & out[k].eqNullSafe(c[f"_{name}_{k}"])
        else:  # one row
            c = F.broadcast(c.select(F.lit(0).alias("_one"), *marked))
            condition = F.col("_all") == F.col("_one")
        out = out.join(c, condition, "left")
        names.append(F.when(F.col(f"_{name}_{times[0]}").isNotNull(), name))
        for t in times:
            values[t].append(1 - F.col(f"_{name}_{t}"))
    known = F.col("nature_family") != UNSUPPORTED
    columns = {"route": F.when(known, F.coalesce(*names, F.lit("global"))).otherwise("abstain")}
    for t in times:
        columns[f"p_{t}"] = F.when(known, F.coalesce(*values[t]))
    return out.withColumns(columns).select(*cases.columns, *columns)


def route_summary(cases: DataFrame, minimum: int, horizon: int = 365) -> DataFrame:
    """Cases, resolutions within the horizon and their rate by the route that each case's group gets."""
    routes = support_routes(cases, minimum).drop("n")
    groups = cases.groupBy(*KEYS).agg(F.count("*").alias("cases"), F.sum(outcome(horizon)).cast("long").alias("resolved"))
    same = [groups[k].eqNullSafe(routes[k]) for k in KEYS]
    joined = groups.join(routes, same[0] & same[1] & same[2] & same[3])
    out = joined.groupBy("route").agg(F.sum("cases").alias("cases"), F.sum("resolved").alias("resolved"))
    return out.withColumn("rate", F.col("resolved") / F.col("cases"))


def outcome(t: int) -> Column:
    return (F.col("event_observed") & (F.col("duration_days") <= t)).cast("double")


def integrated_brier(scored: DataFrame, times: list[int]) -> DataFrame:
    """Each case's squared error integrated over the grid by trapezoids, over the grid's span."""
    total = F.lit(0.0)
    square = {t: F.pow(F.col(f"p_{t}") - outcome(t), 2) for t in times}
    for a, b in zip(times[:-1], times[1:], strict=True):
        total = total + (square[a] + square[b]) / 2 * (b - a)
    return scored.withColumn("brier", total / (times[-1] - times[0]))


def slice_calibration(scored: DataFrame, times: list[int], minimum: int) -> DataFrame:
    """Mean prediction minus mean outcome by value of each dimension and time, for values with enough cases."""
    dims = ["district_code", "nature_family", "jurisdiction_code", "origin_code"]
    rows = scored.where(F.col("route") != "abstain")
    errors = [F.avg(F.col(f"p_{t}") - outcome(t)).alias(f"error_{t}") for t in times]
    long = rows.withColumn(
        "_slice", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    )
    out = long.groupBy("_slice.dimension", "_slice.value").agg(F.count("*").alias("cases"), *errors)
    worst = F.greatest(*[F.abs(f"error_{t}") for t in times]) if len(times) > 1 else F.abs(f"error_{times[0]}")
    return out.where(F.col("cases") >= minimum).withColumn("max_abs_error", worst)


def route_certification(scored: DataFrame, times: list[int], minimum: int, limit: float) -> DataFrame:
    """Route keys (a level and its own values, other values null) with enough cases and a small calibration error at every time."""
    errors = [F.abs(F.avg(F.col(f"p_{t}") - outcome(t))) for t in times]
    worst = F.greatest(*errors) if len(errors) > 1 else errors[0]
    own = [F.when(F.col("route").isin([level for level, keys in LEVELS if k in keys]), F.col(k)).alias(k) for k in KEYS]
    out = scored.where(F.col("route") != "abstain").groupBy("route", *own).agg(F.count("*").alias("cases"), worst.alias("max_abs_error"))
    return out.withColumn("certified", (F.col("cases") >= minimum) & (F.col("max_abs_error") <= limit))


def complete_outcomes(cases: DataFrame, horizon: int) -> DataFrame:
    """cases, if none is censored before the horizon; an error otherwise."""
    early = cases.agg(F.count_if(~F.col("event_observed") & (F.col("duration_days") < horizon)).alias("n")).first()["n"]
    if early:
        raise ValueError(f"{early} cases are censored before day {horizon}")
    return cases


def resolution_clusters(cases: DataFrame, start: str, end: str, horizon: int) -> DataFrame:
    """Cases and resolutions within the horizon by filing month, district, family and origin."""
    inside = F.col("filed_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return cases.where(inside).groupBy(
        F.trunc("filed_date", "month").alias("filed_month"), "district_code", "nature_family", "origin_code"
    ).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("event_observed") & (F.col("duration_days") <= horizon)).alias("resolved"),
    )


def resolution_training(cases: DataFrame, start: str, end: str, horizon: int) -> DataFrame:
    """Cases, resolutions and their share in the mature window; no row for an empty window."""
    rows = resolution_clusters(cases, start, end, horizon)
    return rows.agg(F.sum("cases").alias("cases"), F.sum("resolved").alias("resolved")).where("cases > 0").withColumn(
        "rate", F.col("resolved") / F.col("cases")
    )


def monthly_calibration(clusters: DataFrame, rate: float, minimum: int) -> DataFrame:
    """Each month's resolved share against a predicted rate, for months with enough cases."""
    months = clusters.groupBy("filed_month").agg(F.sum("cases").alias("cases"), F.sum("resolved").alias("resolved"))
    error = F.abs(F.col("resolved") / F.col("cases") - F.lit(rate))
    return months.where(F.col("cases") >= minimum).withColumn("abs_error", error)
