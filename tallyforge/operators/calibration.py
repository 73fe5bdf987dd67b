"""Calibration and resampling over scored cases, on sums that Spark adds up.

A fit looks at probabilities only through counts by bin (``BINS`` of them), so
what reaches the driver is bounded whatever the number of cases.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators import survival

#: Probabilities are kept this far from 0 and 1 (a fixed value).
EDGE = 1e-6
#: Bins of a probability or location in a fit's sufficient statistics.
BINS = 4096


# Resampling


#: Draws: a prime below 2**31 (products of two remainders fit a 64-bit integer) and multipliers.
PRIME, STEP, MIX = 2147483647, 48271, 69621
#: A weight is the number of these that the draw exceeds: the Poisson(1) distribution's first sums.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def digest_number(key: Column) -> Column:
    """A 32-bit number from the digest of a row's key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def drawn_share(digest: Column, replicate: Column, seed: int) -> Column:
    """A number in [0, 1) from a row's digest and the replicate, by two squarings modulo a prime, in integers that SQL engines share."""
    start = (digest + (replicate + F.lit(seed % PRIME)) * STEP) % PRIME + 1
    once = (start * start + replicate * MIX) % PRIME
    twice = (once * once + digest) % PRIME
    return (twice * STEP % PRIME) / PRIME


def poisson_weight(share: Column) -> Column:
    """The Poisson(1) number of a share."""
    return sum(((share > c).cast("int") for c in POISSON[1:]), (share > POISSON[0]).cast("int"))


def resampled_sums(rows: DataFrame, key: list[str], columns: list[str], replicates: int = 400, seed: int = 20260331) -> DataFrame:
    """(replicate, weight, one sum per column): sums of rows under Poisson(1) weights.

    A row's weights follow from its key, so the sums do not depend on how rows
    are dealt or in which order they come, and rows with equal keys are drawn
    together. Tasks add up their rows; ``replicates`` rows leave each.
    """
    named = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("_key")
    values = rows.select(named, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))
    values = values.withColumn("_digest", digest_number(F.col("_key"))).drop("_key")
    drawn = values.withColumn("replicate", F.explode(numbers))
    drawn = drawn.withColumn("_share", drawn_share(F.col("_digest"), F.col("replicate"), seed))
    drawn = drawn.withColumn("weight", poisson_weight(F.col("_share")))
    sums = [F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns]
    return drawn.groupBy("replicate").agg(F.sum("weight").cast("double").alias("weight"), *sums)


def interval(sums: DataFrame, statistic: Column) -> DataFrame:
    """(low, high): the 2.5 % and 97.5 % quantiles of a statistic over the replicates."""
    q = F.expr("percentile(x, array(0.025, 0.975))").alias("q")
    return sums.select(statistic.alias("x")).agg(q).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def mean_interval(rows: DataFrame, key: list[str], column: str, replicates: int = 400, seed: int = 20260331, absolute: bool = False) -> DataFrame:
    """(mean, low, high) of a mean, or of its absolute value."""
    whole = F.abs if absolute else (lambda x: x)
    found = interval(resampled_sums(rows, key, [column], replicates, seed), whole(F.col(column) / F.col("weight")))
    return _beside(rows.agg(whole(F.avg(column)).alias("mean")), found)


def improvement_interval(rows: DataFrame, key: list[str], baseline: str, challenger: str, replicates: int = 400, seed: int = 20260331) -> DataFrame:
    """(improvement, low, high) of 1 - mean challenger / mean baseline, both from the same resampled cases."""
    pairs = rows.dropna(subset=[baseline, challenger])
    found = interval(resampled_sums(pairs, key, [baseline, challenger], replicates, seed), 1 - F.col(challenger) / F.col(baseline))
    return _beside(pairs.agg((1 - F.sum(challenger) / F.sum(baseline)).alias("improvement")), found)


def cluster_interval(clusters: DataFrame, key: list[str], prediction: float, replicates: int = 400, seed: int = 20260331) -> DataFrame:
    """(abs_error, low, high) of a predicted rate against resampled clusters of (cases, resolved)."""
    error = F.abs(F.lit(prediction) - F.col("resolved") / F.col("cases"))
    found = interval(resampled_sums(clusters, key, ["cases", "resolved"], replicates, seed), error)
    whole = F.abs(F.lit(prediction) - F.sum("resolved") / F.sum("cases"))
    return _beside(clusters.agg(whole.alias("abs_error")), found)


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row each, side by side."""
    a, b = a.withColumn("_one", F.lit(1)), b.withColumn("_one", F.lit(1))
    return a.join(F.broadcast(b), "_one").drop("_one")


# Calibration


def logit(p: Column) -> Column:
    kept = F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))
    return F.log(kept / (1 - kept))


def logit_affine(p: Column, intercept: float, log_slope: float) -> Column:
    """1 / (1 + exp(-(a + e^b * logit p)))."""
    return 1 / (1 + F.exp(-(F.lit(intercept) + math.exp(log_slope) * logit(p))))


def normal_cdf(z: Column) -> Column:
    """The normal distribution by a rational approximation of Abramowitz and Stegun (7.1.26); error below 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    tail = series * F.exp(-x * x) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def aft_probability(location: Column, t: int, intercept: float = 0.0, slope: float = 1.0, scale: float = 1.0) -> Column:
    """The chance of an event by day t of an accelerated-failure-time model with a normal error."""
    return normal_cdf((F.lit(math.log(t)) - (F.lit(intercept) + slope * location)) / scale)


def _bounded_minimum(loss: Callable[[np.ndarray], float], start: list[float], bounds: list[tuple[float, float]], least_step: float = 1e-9) -> np.ndarray:
    """Least loss inside a box: coordinate steps that halve where nothing improves, until they are small."""
    x = np.array(start, float)
    low, high = np.array(bounds).T
    step = (high - low) / 4
    best = loss(x)
    for _ in range(5000):
        moved = False
        for k in range(len(x)):
            for sign in (1, -1):
                y = x.copy()
                y[k] = min(max(y[k] + sign * step[k], low[k]), high[k])
                value = loss(y)
                if value < best:
                    x, best, moved = y, value, True
        if not moved:
            step /= 2
            if step.max() < least_step:
                return x
    raise ArithmeticError("the calibration did not converge")


def least_logit_affine(x: list[float], n: list[float], y: list[float]) -> tuple[float, float]:
    """(intercept, log slope) of least squared error, from bins with a mean logit x, a weight n and a mean outcome y."""
    x, n, y = (np.array(v, float) for v in (x, n, y))
    if not len(x):
        return 0.0, 0.0

    def loss(v: np.ndarray) -> float:
        q = 1 / (1 + np.exp(-(v[0] + math.exp(v[1]) * x)))
        return float((n * (q * q - 2 * q * y)).sum())

    a, b = _bounded_minimum(loss, [0.0, 0.0], [(-5.0, 5.0), (math.log(0.25), math.log(4.0))])
    return float(a), float(b)


def fit_logit_affine(scored: DataFrame, p: str, outcome: Column) -> tuple[float, float]:
    """(intercept, log slope) of least squared error; from counts in bins of the logit."""
    width = 2 * math.log(1 / EDGE) / BINS
    bins = (
        scored.where(F.col(p).isNotNull())
        .groupBy(F.floor(logit(F.col(p)) / width).alias("bin"))
        .agg(F.avg(logit(F.col(p))).alias("x"), F.count("*").alias("n"), F.avg(outcome.cast("double")).alias("y"))
        .orderBy("bin").collect()
    )
    return least_logit_affine(*([r[k] for r in bins] for k in ("x", "n", "y")))


def fit_aft(cases: DataFrame, location: str, times: list[int], initial_scale: float = 1.0) -> tuple[float, float, float]:
    """(intercept, slope, scale) of least squared error over all times; from outcome counts in ``BINS`` bins of the location."""
    ends = cases.agg(F.min(location).alias("low"), F.max(location).alias("high")).first()
    if ends["low"] is None:
        return 0.0, 1.0, initial_scale
    width = (ends["high"] - ends["low"]) / BINS or 1.0
    outcomes = [F.avg(survival.outcome(t)).alias(f"y_{t}") for t in times]
    bins = (
        cases.where(F.col(location).isNotNull())
        .groupBy(F.least(F.floor((F.col(location) - ends["low"]) / width), F.lit(BINS - 1)).alias("bin"))
        .agg(F.avg(location).alias("x"), F.count("*").alias("n"), *outcomes)
        .orderBy("bin").collect()
    )
    x, n = (np.array([r[k] for r in bins], float) for k in ("x", "n"))
    y = np.array([[r[f"y_{t}"] for t in times] for r in bins], float)
    logs = np.log(np.array(times, float))
    cdf = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))

    def loss(v: np.ndarray) -> float:
        q = cdf((logs[None, :] - (v[0] + v[1] * x[:, None])) / math.exp(v[2]))
        return float((n[:, None] * (q * q - 2 * q * y)).sum())

    bounds = [(-2.0, 2.0), (0.5, 1.5), (math.log(0.25), math.log(4.0))]
    a, b, s = _bounded_minimum(loss, [0.0, 1.0, math.log(initial_scale)], bounds, least_step=1e-5)
    return float(a), float(b), float(math.exp(s))


def overall_calibration(scored: DataFrame, times: list[int]) -> DataFrame:
    """One row: supported cases, abstentions and the absolute mean residual at each time."""
    known = F.col("route") != "abstain"
    errors = [F.abs(F.avg(F.when(known, survival.outcome(t) - F.col(f"p_{t}")))).alias(f"abs_error_{t}") for t in times]
    return scored.agg(F.count_if(known).alias("supported_cases"), F.count_if(~known).alias("abstained_cases"), *errors)


def worst_slices(calibration: DataFrame, n: int = 20) -> DataFrame:
    """The n slices with the largest error; ties go by dimension and value."""
    return calibration.orderBy(F.desc("max_abs_error"), "dimension", "value").limit(n)


# Features


def category_codes(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): the sorted distinct values of each column, numbered from 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    known = train.select(pairs.alias("x")).select("x.column", "x.value").where("value IS NOT NULL").distinct()
    code = F.row_number().over(W.partitionBy("column").orderBy("value")) - 1
    return known.withColumn("code", code.cast("long"))


def encode_categories(rows: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """rows with ``<column>_code`` for each column; null where a value was not in training."""
    for c in columns:
        own = codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias(f"{c}_code"))
        rows = rows.join(own, F.col(c).cast("string") == F.col("_v"), "left").drop("_v")
    return rows


# Development


def guard_snapshot(rows: DataFrame, cutoff: str) -> DataFrame:
    """rows, if their latest ``as_of_date`` is the configured cut-off; an error otherwise."""
    found = rows.agg(F.max("as_of_date").cast("date").alias("d")).first()["d"]
    if found != date.fromisoformat(cutoff):
        raise ValueError(f"the snapshot is of {found}, not of {cutoff}")
    return rows


def monthly_maximum(months: DataFrame) -> DataFrame:
    """(months, max_abs_error): the largest monthly error; infinite where no month has enough cases."""
    worst = F.coalesce(F.max("abs_error"), F.lit(float("inf")))
    return months.agg(F.count("*").alias("months"), worst.alias("max_abs_error"))
