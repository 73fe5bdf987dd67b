"""Profiles of the cohort: semantics audit, termination rates, drift by segment, and the assertion suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _within(days: int, name: str):
    hit = (F.col("event_observed") & (F.col("duration_days") <= days)).cast("int")
    return F.avg(hit).alias(name)


def semantics_audit(cases: DataFrame) -> DataFrame:
    """One row of counts; the last four must be zero."""
    end = F.coalesce("terminated_date", "source_snapshot_cutoff")
    return cases.agg(
        F.count("*").alias("cases"),
        F.count_if("event_observed").alias("observed_terminations"),
        F.count_if(~F.col("event_observed")).alias("right_censored"),
        F.count_if(F.col("duration_days") < 0).alias("negative_durations"),
        F.count_if(F.col("event_observed") & F.col("terminated_date").isNull()).alias("event_without_termination"),
        F.count_if(~F.col("event_observed") & F.col("terminated_date").isNotNull()).alias("censor_with_termination"),
        F.count_if(F.col("analysis_end_date") != end).alias("analysis_end_mismatches"),
    )


def cohort_profile(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.col("intake_procedural_cohort").alias("procedural_cohort")).agg(
        F.count("*").alias("cases"),
        _within(365, "termination_rate_365d"),
        _within(730, "termination_rate_730d"),
        F.avg((~F.col("event_observed")).cast("int")).alias("censored_at_snapshot_share"),
    )


def calendar_drift(cases: DataFrame, district: str = "29") -> DataFrame:
    """Rates by filing year and overlapping segment; a case is read once and counts in each segment it is in."""
    segments = F.array_compact(
        F.array(
            F.lit("all_cases"),
            F.when(F.col("district_code") == district, f"district_{district}"),
            F.when(F.col("origin_code") == "13", "origin_13"),
            F.when(F.col("nature_family") == "tort_personal_injury", "personal_injury_tort"),
            F.when(F.col("nature_family") == "social_security", "social_security"),
            F.when(F.col("intake_procedural_cohort") == "multidistrict_litigation", "multidistrict_litigation"),
        )
    )
    return (
        cases.select(F.year("filed_date").alias("filing_year"), "event_observed", "duration_days", F.explode(segments).alias("segment"))
        .groupBy("filing_year", "segment")
        .agg(F.count("*").alias("cases"), _within(365, "termination_rate_365d"), _within(730, "termination_rate_730d"))
    )


def assertions(facts: DataFrame, portfolio: DataFrame, filing: DataFrame, inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """(assertion, failures): the warehouse's zero-row tests; every count must be zero."""
    row_rules = facts.agg(
        F.count_if((F.col("source_record_count") == 1) != (F.col("identity_quality_status") == "canonical")).alias("identity_status_matches_count"),
        F.count_if((F.col("nature_of_suit_mapping_status") == "supported") != F.col("nature_of_suit_family").isNotNull()).alias("mapping_status_consistent"),
        F.count_if((F.col("duration_days") < 0) | (F.col("duration_days") != F.datediff("analysis_end_date", "filed_date"))).alias("nonnegative_exact_duration"),
        F.count_if(~F.col("event_observed") & (F.col("terminated_date").isNotNull() | F.col("censoring_date").isNull())).alias("pending_censoring_semantics"),
        F.count_if(F.col("event_observed") & (F.col("terminated_date").isNull() | F.col("censoring_date").isNotNull())).alias("terminated_event_semantics"),
        F.count_if(F.col("origin_code").isin("6", "13") & (F.col("intake_procedural_cohort") != "multidistrict_litigation")).alias("intake_procedural_cohort"),
    )
    out = row_rules.unpivot([], row_rules.columns, "assertion", "failures")

    def repeated(name: str, df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("failures")).select(F.lit(name).alias("assertion"), "failures")

    grain = [
        repeated("source_identity_unique", facts, "source_record_identifier"),
        repeated("portfolio_grain_unique", portfolio, "district_code", "nature_family"),
        repeated("filing_grain_unique", filing, "filing_year", "district_code", "nature_family"),
        repeated("inventory_grain_unique", inventory, "district_code", "nature_family", "age_band"),
        repeated("candidate_pair_unique", candidates, "case_identifier", "recap_docket_id"),
    ]
    for part in grain:
        out = out.unionByName(part)
    clash = candidates.agg(
        F.count_if((F.col("candidate_status") == "review_eligible") & ((F.col("recap_candidates_for_fjc") > 1) | (F.col("fjc_candidates_for_recap") > 1))).alias("failures")
    )
    out = out.unionByName(clash.select(F.lit("review_eligible_has_no_collision").alias("assertion"), "failures"))
    sums = [
        ("portfolio", facts.agg(F.count("*").alias("a")), portfolio.agg(F.sum("total_records").alias("b"))),
        ("filing", facts.agg(F.count("*").alias("a")), filing.agg(F.sum("cohort_records").alias("b"))),
        ("pending", facts.agg(F.count_if(~F.col("event_observed")).alias("a")), inventory.agg(F.sum("pending_records").alias("b"))),
    ]
    for name, a, b in sums:
        both = a.select("a", F.lit(None).cast("long").alias("b")).unionByName(b.select(F.lit(None).cast("long").alias("a"), "b"))
        out = out.unionByName(
            both.agg(F.max("a").alias("a"), F.max("b").alias("b")).select(
                F.lit(f"{name}_rows_reconcile").alias("assertion"), F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("failures")
            )
        )
    return out.select("assertion", F.col("failures").cast("long").alias("failures"))


#: What the bridge from the complete snapshot to the product's scope must show, and the number of districts (fixed values).
SCOPE_BRIDGE = {"filed": 0, "terminated": 61, "pending": 4896}
DISTRICTS = 94


def source_assertions(
    source: DataFrame,
    staged: DataFrame,
    records: DataFrame,
    cases: DataFrame,
    exceptions: DataFrame,
    districts: DataFrame,
    tie_out: DataFrame,
    bridge: DataFrame,
    n_districts: int = DISTRICTS,
    expected_bridge: dict[str, int] = SCOPE_BRIDGE,
) -> DataFrame:
    """(assertion, failures): tests over more than one relation; every count must be zero."""

    def total(df: DataFrame, sign: int) -> DataFrame:
        return df.agg((F.count("*") * sign).alias("n"))

    def balanced(name: str, *parts: DataFrame) -> DataFrame:
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return both.agg(F.abs(F.sum("n")).alias("failures")).select(F.lit(name).alias("assertion"), "failures")

    expected = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in expected_bridge.items()], F.lit(0))
    blocked = F.col("required_for_gate") & ~F.coalesce(F.col("passed"), F.lit(False))
    return (
        balanced("staging_source_reconciliation", total(source, 1), total(staged, -1))
        .unionByName(balanced("case_exception_partition", total(records, 1), total(cases, -1), total(exceptions, -1)))
        .unionByName(
            districts.agg(F.abs(F.count("*") - n_districts).alias("failures")).select(F.lit("district_count").alias("assertion"), "failures")
        )
        .unionByName(tie_out.agg(F.count_if(blocked).alias("failures")).select(F.lit("required_tie_out_passes").alias("assertion"), "failures"))
        .unionByName(
            bridge.agg(F.count_if(~F.col("excluded_or_quarantined_records").eqNullSafe(expected)).alias("failures")).select(
                F.lit("scope_bridge").alias("assertion"), "failures"
            )
        )
    )


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """(failures): non-null references that no parent row has."""
    known = parents.select(F.col(key).alias("_key")).distinct()
    lost = rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_key"), "left_anti")
    return lost.agg(F.count("*").alias("failures"))


def district_benchmark(rows: DataFrame, district: str) -> DataFrame:
    """A district's records, pending records and mean duration, overall (a null family) and by family."""
    own = rows.where(F.col("district_code") == district)
    return own.groupingSets([["nature_of_suit_family"], []], "nature_of_suit_family").agg(
        F.count("*").alias("statistical_records"),
        F.count_if("pending_status").alias("pending_records"),
        F.avg("duration_days").alias("mean_duration_days"),
    )
