"""Synthetic planning scenarios, release gates and typed refusals."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inputs of a scenario and the bounds that they must keep (fixed values).
BOUNDS = {
    "matters": (1, 10_000),
    "horizon_months": (1, 60),
    "attorney_hours_per_matter_month": (0, 500),
    "paralegal_hours_per_matter_month": (0, 500),
    "attorney_rate_usd": (0, 5_000),
    "paralegal_rate_usd": (0, 5_000),
    "productive_hours_per_fte_month": (1, 744),
    "low_multiplier": (0.1, 1.0),
    "high_multiplier": (1.0, 5.0),
}


def scenario_table(assumptions: DataFrame) -> DataFrame:
    """Low, base and high case of each row of assumptions, in decimals.

    Inputs keep six decimal places, and products keep all of theirs. Full-time equivalents are rounded half
    to even, money half up. A row with an input out of bounds or missing stops
    the query.
    """
    number = lambda c: F.col(c).cast("decimal(11,6)")
    outside = [
        F.when(number(c).between(low, high), F.lit(None)).otherwise(F.lit(c)) for c, (low, high) in BOUNDS.items()
    ]
    names = F.concat_ws(", ", *outside)
    error = F.raise_error(F.concat(F.lit("scenario assumptions outside bounds: "), names))
    one = F.lit(1).cast("decimal(11,6)")
    cases = [("low", number("low_multiplier")), ("base", one), ("high", number("high_multiplier"))]
    scale = F.explode(F.array(*[F.struct(F.lit(n).alias("case"), m.alias("multiplier")) for n, m in cases]))
    rows = assumptions.withColumn("scenario", F.when(names == "", F.col("scenario")).otherwise(error))
    rows = rows.select("*", scale.alias("_s"))
    months = (F.col("matters").cast("decimal(5,0)") * F.col("horizon_months").cast("decimal(2,0)")).cast("decimal(7,0)")
    factor = F.col("_s.multiplier")
    base = lambda c: (months * number(c)).cast("decimal(15,6)")
    hours = lambda c: base(c) * factor.cast("decimal(8,6)")
    capacity = (F.col("horizon_months").cast("decimal(2,0)") * number("productive_hours_per_fte_month")).cast("decimal(12,6)")
    attorney, paralegal = "attorney_hours_per_matter_month", "paralegal_hours_per_matter_month"
    cost = lambda c, r: hours(c) * F.col(r).cast("decimal(10,6)")
    return rows.select(
        "scenario",
        F.col("_s.case").alias("case"),
        hours(attorney).cast("double").alias("attorney_hours"),
        hours(paralegal).cast("double").alias("paralegal_hours"),
        F.bround(hours(attorney) / capacity, 2).cast("double").alias("attorney_fte"),
        F.bround(hours(paralegal) / capacity, 2).cast("double").alias("paralegal_fte"),
        F.round(cost(attorney, "attorney_rate_usd") + cost(paralegal, "paralegal_rate_usd"), 2).cast("double").alias("budget_usd"),
    )


def nearest_rank(rows: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """(p): the value whose rank is ceil(share * n); nulls do not count."""
    return rows.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias("p"))


# Gates


@dataclass(frozen=True)
class Gate:
    metric: str
    comparator: str
    threshold: float

    def holds(self, metrics: dict[str, float]) -> bool:
        """A missing or non-finite metric never passes."""
        value = metrics.get(self.metric)
        if value is None or isinstance(value, bool) or not math.isfinite(value):
            return False
        return {"<=": value <= self.threshold, ">=": value >= self.threshold, "==": value == self.threshold}[self.comparator]


def evaluate_gates(gates: list[Gate], metrics: dict[str, float]) -> dict:
    checks = {g.metric: g.holds(metrics) for g in gates}
    return {"checks": checks, "passed": bool(gates) and all(checks.values())}


def choose_champion(baseline: dict, challenger: dict, gates: list[Gate], improvement: float) -> str:
    """The challenger, if it passes every gate and its paired improvement is certain; else the baseline, else none."""
    good = evaluate_gates(gates, challenger)["passed"] and challenger.get("improvement_lower", -1.0) >= improvement
    if good:
        return "challenger"
    return "baseline" if evaluate_gates(gates, baseline)["passed"] else "none"


def loosened(old: list[Gate], new: list[Gate]) -> list[str]:
    """Metrics that a new policy drops or judges less strictly; a transition is allowed only if there are none."""
    kept = {g.metric: g for g in new}
    bad = []
    for g in old:
        n = kept.get(g.metric)
        looser = n is None or n.comparator != g.comparator
        looser = looser or (g.comparator == "<=" and n.threshold > g.threshold)
        looser = looser or (g.comparator == ">=" and n.threshold < g.threshold)
        if looser or (g.comparator == "==" and n.threshold != g.threshold):
            bad.append(g.metric)
    return bad


def policy_digest(gates: list[Gate]) -> str:
    """A frozen policy's digest; it changes with any gate, comparator or threshold."""
    rows = sorted((g.metric, g.comparator, float(g.threshold)) for g in gates)
    return hashlib.sha256(json.dumps(rows, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def evaluate_policy(gates: list[Gate], digest: str, metrics: dict[str, float], cases: dict[str, int]) -> dict:
    """Checks of a frozen policy with a reason for each failure.

    ``cases`` holds total, supported and abstained; they must add up, or nothing passes.
    """
    if policy_digest(gates) != digest:
        raise ValueError("the gate policy differs from the frozen one")
    reasons = []
    if cases["supported"] + cases["abstained"] != cases["total"]:
        reasons.append("case_accounting")
    for g in gates:
        value = metrics.get(g.metric)
        if value is None or isinstance(value, bool):
            reasons.append(f"missing:{g.metric}")
        elif not math.isfinite(value):
            reasons.append(f"not_finite:{g.metric}")
        elif not g.holds(metrics):
            reasons.append(f"failed:{g.metric}")
    return {"passed": bool(gates) and not reasons, "reasons": reasons, "policy_digest": digest}


def guard_holdout(cutoff: date, holdout_end: date, horizon_days: int, attempts: int, allowed_attempts: int = 1) -> None:
    """Refuses a sealed holdout that was used before or whose cases are not followed to the horizon."""
    if attempts >= allowed_attempts:
        raise PermissionError("the sealed holdout was used before")
    if holdout_end + timedelta(days=horizon_days) > cutoff:
        raise PermissionError("holdout cases are not followed to the horizon")


def mature_window(assessment_start: date, horizon_days: int = 365, years: int = 3) -> tuple[date, date]:
    """(start, end) of filings whose whole horizon lies before an assessment, ``years`` long."""
    end = assessment_start - timedelta(days=1 + horizon_days)
    try:
        start = end.replace(year=end.year - years)
    except ValueError:  # the last day of February
        start = end.replace(year=end.year - years, day=28)
    return start + timedelta(days=1), end


def guard_outcome_access(requested_end: date, frozen_end: date) -> None:
    """Refuses, before a plan exists, to look at outcomes past the frozen development window."""
    if requested_end > frozen_end:
        raise PermissionError(f"outcomes after {frozen_end} are sealed")


# Refusals


def milestone_availability(df: DataFrame, required: list[str]) -> dict:
    """Whether the columns that a milestone needs are there; a typed refusal where they are not."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        return {"status": "unavailable", "reason": "required_fields_missing", "missing_fields": missing}
    return {"status": "available", "missing_fields": []}


def forecast_refusal() -> dict:
    """Forecasts of single cases are always refused."""
    return {"status": "refused", "reason": "no_validated_model", "capability": "case_forecast"}


def totals_summary(portfolio: DataFrame) -> DataFrame:
    """One row: the portfolio's totals and the ratios made from them."""
    names = ["total_records", "collision_free_records", "pending_records", "matched_records", "supported_nature_records"]
    out = portfolio.agg(*[F.sum(n).alias(n) for n in names])
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total_records").cast("double"))
    return out.withColumns({"pending_share": share("pending_records"), "match_coverage": share("matched_records")})
