"""The aggregate cube: grouping sets over the marts, small cells suppressed.

Margins come from all rows, suppressed cells included. A rolled-up dimension is
null and ``grouping_id`` tells it from a null in the data. A cell below the
support threshold is absent, which is not the same as zero.
"""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.semantics import age_band, band_order, ratio

MINIMUM_SUPPORT = 200


def rolled_up(df: DataFrame, fixed: list[str], support: str, minimum: int, *measures: Column) -> DataFrame:
    """Sums over (fixed, district, family), (fixed, district), (fixed, family) and (fixed)."""
    d, f = "district_code", "nature_family"
    sets = [[*fixed, d, f], [*fixed, d], [*fixed, f], fixed]
    out = df.groupingSets(sets, *fixed, d, f).agg(F.grouping_id().alias("grouping"), F.sum(support).alias("_support"), *measures)
    return out.where(F.col("_support") >= minimum).drop("_support")


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def cube_portfolio(portfolio: DataFrame, durations: DataFrame, minimum: int = MINIMUM_SUPPORT) -> DataFrame:
    """Counts and shares of every published cell, with its duration columns where those are published."""
    cells = rolled_up(
        portfolio, [], "total_records", minimum,
        *_sums("total_records", "collision_free_records", "pending_records", "terminated_records", "matched_records", "supported_nature_records"),
    )
    other = cube_duration(durations, minimum)
    d, f = "district_code", "nature_family"
    other = other.select(
        F.col("grouping").alias("_g"), F.col(d).alias("_d"), F.col(f).alias("_f"),
        "duration_support_count", "observed_terminations", "censored_records", "average_observed_duration_days",
    )
    same = (F.col("grouping") == F.col("_g")) & F.col(d).eqNullSafe(F.col("_d")) & F.col(f).eqNullSafe(F.col("_f"))
    return cells.join(other, same, "left").drop("_g", "_d", "_f", "grouping").withColumns(
        {
            "pending_share": ratio(F.col("pending_records"), F.col("total_records")),
            "match_coverage": ratio(F.col("matched_records"), F.col("total_records")),
        }
    )


def cube_duration(durations: DataFrame, minimum: int = MINIMUM_SUPPORT) -> DataFrame:
    weighted = F.col("average_observed_duration_days") * F.col("observed_terminations")
    return rolled_up(
        durations, [], "support_count", minimum,
        F.sum("support_count").alias("duration_support_count"),
        *_sums("observed_terminations", "censored_records"),
        ratio(F.sum(weighted), F.sum("observed_terminations")).alias("average_observed_duration_days"),
    )


def cube_filing(cohorts: DataFrame, minimum: int = MINIMUM_SUPPORT) -> DataFrame:
    names = ("cohort_records", "observed_terminations", "pending_records", "matched_records", "followup_days")
    return rolled_up(cohorts, ["filing_year"], "cohort_records", minimum, *_sums(*names)).drop("grouping")


def cube_pending_age(inventory: DataFrame, minimum: int = MINIMUM_SUPPORT) -> DataFrame:
    weighted = F.col("average_age_days") * F.col("pending_records")
    return rolled_up(
        inventory, ["age_band"], "pending_records", minimum,
        *_sums("pending_records", "matched_pending_records"),
        ratio(F.sum(weighted), F.sum("pending_records")).alias("average_age_days"),
    ).drop("grouping")


def cell_accounting(portfolio: DataFrame, cohorts: DataFrame, inventory: DataFrame, minimum: int = MINIMUM_SUPPORT) -> DataFrame:
    """(mart, available, published): how many cells each mart has and how many reach the threshold."""
    parts = [
        df.agg(F.count("*").alias("available"), F.count_if(F.col(c) >= minimum).alias("published")).select(
            F.lit(name).alias("mart"), "available", "published"
        )
        for name, df, c in (
            ("portfolio_summary", portfolio, "total_records"),
            ("filing_cohorts", cohorts, "cohort_records"),
            ("pending_inventory", inventory, "pending_records"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dimension_lists(portfolio: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(dimension, value): the values that the marts hold."""
    d = portfolio.select(F.lit("district_code").alias("dimension"), F.col("district_code").alias("value")).distinct()
    f = portfolio.select(F.lit("nature_family").alias("dimension"), F.col("nature_family").alias("value")).distinct()
    y = cohorts.select(F.lit("filing_year").alias("dimension"), F.col("filing_year").cast("string").alias("value")).distinct()
    return d.unionByName(f).unionByName(y)


def yoy_change(filings: DataFrame, snapshot_year: int) -> DataFrame:
    """Change between the last two published complete years, by district and family.

    Years from the snapshot's own on are unfinished. A slice with one year, or
    whose earlier year has no records, has no row; rolled-up nulls are slices of
    their own. The two years need not follow each other.
    """
    slices = ["district_code", "nature_family"]
    year = F.struct(F.col("filing_year").alias("year"), F.col("cohort_records").alias("records"))
    # A slice has a row for each published year, so its years are few.
    last = filings.where(F.col("filing_year") < snapshot_year).groupBy(*slices).agg(
        F.slice(F.sort_array(F.collect_list(year), asc=False), 1, 2).alias("y")
    )
    last = last.where(F.size("y") == 2).select(
        *slices,
        F.col("y")[0]["year"].alias("current_year"), F.col("y")[1]["year"].alias("previous_year"),
        F.col("y")[0]["records"].alias("current_records"), F.col("y")[1]["records"].alias("previous_records"),
    )
    change = ratio(F.col("current_records") - F.col("previous_records"), F.col("previous_records"))
    return last.where("previous_records <> 0").withColumn("relative_change", change)


def published_pending_age(pending_ages: DataFrame) -> DataFrame:
    """Average pending age over the published bands of each district and family, weighted by their records."""
    n = F.sum("pending_records")
    return pending_ages.groupBy("district_code", "nature_family").agg(
        n.alias("pending_records"),
        F.sum("matched_pending_records").alias("matched_pending_records"),
        (F.sum(F.col("average_age_days") * F.col("pending_records")) / F.greatest(F.lit(1), n)).alias("weighted_age_days"),
        F.max(F.when(F.col("age_band") == "5_years_or_more", F.col("pending_records"))).alias("oldest_band_records"),
    )


def family_totals(cells: DataFrame) -> DataFrame:
    """Published families of all districts with their share of the published total; one window over a row a family."""
    rows = cells.where("district_code IS NULL AND nature_family IS NOT NULL").select("nature_family", "total_records")
    total = F.sum("total_records").over(W.partitionBy(F.lit(0)))
    return rows.withColumn("share", ratio(F.col("total_records"), F.greatest(F.lit(1), total)))


def marts_from_public(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(portfolio, cohorts, inventory, durations) made again from public rows, which hold months instead of days."""
    rows = rows.withColumnRenamed("nature_of_suit_family", "nature_family")
    place = ["district_code", "nature_family"]
    pending, matched = F.col("pending_status"), F.col("recap_match_available")
    portfolio = rows.groupBy(*place).agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("identity_quality_status") == "canonical").alias("collision_free_records"),
        F.count_if(pending).alias("pending_records"),
        F.count_if("event_observed").alias("terminated_records"),
        F.count_if(matched).alias("matched_records"),
        F.count_if(F.col("nature_of_suit_mapping_status") == "supported").alias("supported_nature_records"),
    )
    cohorts = rows.groupBy(F.year("filed_month").cast("long").alias("filing_year"), *place).agg(
        F.count("*").alias("cohort_records"),
        F.count_if("event_observed").alias("observed_terminations"),
        F.count_if(pending).alias("pending_records"),
        F.count_if(matched).alias("matched_records"),
        F.sum("duration_days").cast("long").alias("followup_days"),
    )
    inventory = rows.where(pending).groupBy(*place, age_band(F.col("duration_days")).alias("age_band")).agg(
        F.count("*").alias("pending_records"),
        F.count_if(matched).alias("matched_pending_records"),
        F.avg("duration_days").alias("average_age_days"),
    )
    durations = rows.groupBy(*place, "jurisdiction_code", "origin_code", "procedural_cohort").agg(
        F.count("*").alias("support_count"),
        F.count_if("event_observed").alias("observed_terminations"),
        F.count_if(pending).alias("censored_records"),
        F.avg(F.when(F.col("event_observed"), F.col("duration_days"))).alias("average_observed_duration_days"),
    )
    return portfolio, cohorts, inventory, durations


#: Dimensions in the order that published cells are sorted by (fixed order).
ORDERED = ["district_code", "nature_family", "filing_year", "age_band"]


def publication_order(cells: DataFrame) -> list[Column]:
    """Sort keys of published cells: dimensions with their totals (nulls) first, age bands by age, then all other columns."""
    known = [c for c in ORDERED if c in cells.columns]
    values = {c: F.col(c) for c in [*known, *[c for c in cells.columns if c not in known]]}
    if "age_band" in values:
        values["age_band"] = F.when(F.col("age_band").isNotNull(), band_order(F.col("age_band")))
    return [v.asc_nulls_first() for v in values.values()]


def cube_json(cells: dict[str, DataFrame], path: str) -> str:
    """Published cells as canonical JSON in publication order, put in place by a rename; returns its digest.

    The cube has at most as many rows as dimensions have values, so it passes through the driver.
    """
    body = {}
    for name, df in sorted(cells.items()):
        body[name] = [r.asDict() for r in df.orderBy(*publication_order(df)).collect()]
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), allow_nan=False, default=str).encode()
    staged = Path(f"{path}.staged")
    staged.write_bytes(text)
    os.replace(staged, path)
    return hashlib.sha256(text).hexdigest()


def ranking(cells: DataFrame, by: str, other: str, measure: str = "pending_records") -> DataFrame:
    """Margins of one dimension ranked by a measure; ties go by value."""
    rows = cells.where(F.col(by).isNotNull() & F.col(other).isNull()).select(by, measure)
    # At most as many rows as the dimension has values.
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc(measure), by)).cast("long"))
