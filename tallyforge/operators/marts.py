"""Analytics marts over the facts; each has the grain that its name says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.semantics import UNSUPPORTED, age_band, ratio
from tallyforge.operators.warehouse import with_matches


def family() -> Column:
    return F.coalesce("nature_of_suit_family", F.lit(UNSUPPORTED)).alias("nature_family")


def as_of() -> Column:
    return F.max("source_snapshot_cutoff").alias("as_of_date")


def total() -> Column:
    return F.count("*")


def _n(condition: Column | str, name: str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias(name)


def portfolio_summary(facts: DataFrame, promoted: DataFrame) -> DataFrame:
    return (
        with_matches(facts, promoted)
        .groupBy("district_code", family())
        .agg(
            total().alias("total_records"),
            _n("identity_quality_status = 'canonical'", "collision_free_records"),
            _n("NOT event_observed", "pending_records"),
            _n("event_observed", "terminated_records"),
            _n("matched", "matched_records"),
            _n("nature_of_suit_mapping_status = 'supported'", "supported_nature_records"),
            ratio(F.count_if("matched"), total()).alias("match_coverage"),
            ratio(F.count_if(~F.col("event_observed")), total()).alias("pending_share"),
            as_of(),
        )
    )


def filing_cohorts(facts: DataFrame, promoted: DataFrame) -> DataFrame:
    year = F.year("filed_date").cast("long").alias("filing_year")
    return (
        with_matches(facts, promoted)
        .groupBy(year, "district_code", family())
        .agg(
            total().alias("cohort_records"),
            _n("event_observed", "observed_terminations"),
            _n("NOT event_observed", "pending_records"),
            _n("matched", "matched_records"),
            F.sum("duration_days").alias("followup_days"),
            as_of(),
        )
    )


def pending_inventory(facts: DataFrame, promoted: DataFrame) -> DataFrame:
    return (
        with_matches(facts.where(~F.col("event_observed")), promoted)
        .groupBy("district_code", family(), age_band(F.col("duration_days")).alias("age_band"))
        .agg(
            total().alias("pending_records"),
            _n("matched", "matched_pending_records"),
            F.avg("duration_days").alias("average_age_days"),
            as_of(),
        )
    )


def duration_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("district_code", family(), "jurisdiction_code", "origin_code", "intake_procedural_cohort").agg(
        total().alias("support_count"),
        _n("event_observed", "observed_terminations"),
        _n("NOT event_observed", "censored_records"),
        F.avg("duration_days").alias("average_followup_days"),
        F.avg(F.when(F.col("event_observed"), F.col("duration_days"))).alias("average_observed_duration_days"),
        as_of(),
    )


def data_coverage(facts: DataFrame, promoted: DataFrame) -> DataFrame:
    """Coverage overall and by each of four dimensions: one scan, by grouping sets."""
    dims = {
        "district": F.col("district_code"),
        "filing_year": F.year("filed_date").cast("string"),
        "nature_family": F.coalesce("nature_of_suit_family", F.lit(UNSUPPORTED)),
        "procedural_cohort": F.col("intake_procedural_cohort"),
    }
    rows = with_matches(facts, promoted).select(
        *[c.alias(f"_{k}") for k, c in dims.items()],
        (F.col("identity_quality_status") == "canonical").alias("collision_free"),
        (F.col("nature_of_suit_mapping_status") == "supported").alias("supported_nature"),
        "matched",
    )
    names = [f"_{k}" for k in dims]
    sets = [[], *[[c] for c in names]]
    out = rows.groupingSets(sets, *names).agg(
        F.grouping_id().alias("_g"),
        total().alias("total_records"),
        _n("collision_free", "collision_free_records"),
        _n("supported_nature", "supported_nature_records"),
        _n("matched", "matched_records"),
        ratio(F.count_if("matched"), total()).alias("match_coverage"),
    )
    # In grouping_id the first column has the highest bit; a set bit means that the column is rolled up.
    every = (1 << len(names)) - 1
    kind, value = F.when(F.col("_g") == every, "overall"), F.when(F.col("_g") == every, "all")
    for k, name in enumerate(names):
        own = every & ~(1 << (len(names) - 1 - k))
        kind, value = kind.when(F.col("_g") == own, name[1:]), value.when(F.col("_g") == own, F.col(name))
    return out.select(
        kind.alias("dimension_type"),
        value.alias("dimension_value"),
        "total_records",
        "collision_free_records",
        "supported_nature_records",
        "matched_records",
        "match_coverage",
    )


def comparable_cases(case_rows: DataFrame, promoted: DataFrame) -> DataFrame:
    """Every case with the number of cases like it, itself included.

    The groups are few and may hold a large share of all cases, so they are
    counted where the cases lie and joined back, which Spark can broadcast or
    split; a window would sort a whole group in one task.
    """
    rows = with_matches(case_rows, promoted).withColumn("nature_family", family())
    keys = ["district_code", "nature_family", "jurisdiction_code", "origin_code"]
    like = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_like"))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(like[f"_{k}"])
    return rows.join(like, same).select(
        "case_identifier",
        "source_record_identifier",
        "district_code",
        "filed_date",
        "terminated_date",
        "analysis_end_date",
        "duration_days",
        "event_observed",
        "nature_family",
        "jurisdiction_code",
        "origin_code",
        "intake_procedural_cohort",
        F.col("matched").alias("has_recap_match"),
        F.col("_like").alias("comparable_group_support_count"),
        F.col("source_snapshot_cutoff").alias("as_of_date"),
    )
