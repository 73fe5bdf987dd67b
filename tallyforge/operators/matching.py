"""Matching with a second source and tie-out with an independent total."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.semantics import UNSUPPORTED, five_year_band, ratio
from tallyforge.operators.warehouse import with_matches

MATCH_KEYS = ["court_id", "office_code", "docket_number", "filed_date"]
TOTAL_TOLERANCE, DISTRICT_TOLERANCE = 0.005, 0.02


def match_candidates(case_rows: DataFrame, districts: DataFrame, dockets: DataFrame) -> DataFrame:
    """Pairs that agree on four keys, with how many partners either side has and a status.

    An identifier names one row of its side, so a case's partners are the
    dockets with its keys, and a docket's the cases. Both sides are dealt by the
    keys once; partners are counted there and joined there. Rows that lack a key
    match nothing. The district map has a row for each district, so Spark may
    broadcast it.
    """
    same_keys = W.partitionBy(*MATCH_KEYS)
    left = case_rows.join(districts, "district_code").dropna(subset=MATCH_KEYS).select(
        "case_identifier", "source_record_identifier", "district_code", *MATCH_KEYS, F.col("terminated_date").alias("fjc_terminated_date"),
        F.count("*").over(same_keys).alias("fjc_candidates_for_recap"),
    )
    right = dockets.dropna(subset=MATCH_KEYS).select(
        "recap_docket_id", *MATCH_KEYS, F.col("terminated_date").alias("recap_terminated_date"),
        F.count("*").over(same_keys).alias("recap_candidates_for_fjc"),
    )
    counted = left.join(right, MATCH_KEYS).select(
        "case_identifier",
        "source_record_identifier",
        "recap_docket_id",
        "district_code",
        "court_id",
        "office_code",
        F.col("docket_number").alias("docket_number_core"),
        "filed_date",
        "fjc_terminated_date",
        "recap_terminated_date",
        "recap_candidates_for_fjc",
        "fjc_candidates_for_recap",
    )
    differ = F.col("fjc_terminated_date") != F.col("recap_terminated_date")
    status = (
        F.when((F.col("recap_candidates_for_fjc") > 1) | (F.col("fjc_candidates_for_recap") > 1), "collision")
        .when(F.coalesce(differ, F.lit(False)), "evidence_conflict")
        .otherwise("review_eligible")
    )
    return counted.withColumn("candidate_status", status)


def promotion_audit(candidates: DataFrame) -> DataFrame:
    """One row: eligible pairs, distinct cases and dockets among them, and collisions."""
    good = F.col("candidate_status") == "review_eligible"
    return candidates.agg(
        F.count_if(good).alias("promoted"),
        F.countDistinct(F.when(good, F.col("case_identifier"))).alias("distinct_cases"),
        F.countDistinct(F.when(good, F.col("recap_docket_id"))).alias("distinct_dockets"),
        F.count_if(F.col("candidate_status") == "collision").alias("collisions"),
        F.count_if(F.col("candidate_status") == "evidence_conflict").alias("conflicts"),
    )


def match_coverage(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Promoted share by dimension, and of collision-free records; one scan by grouping sets."""
    promoted = candidates.where("candidate_status = 'review_eligible'").select("source_record_identifier")
    rows = with_matches(facts, promoted).select(
        F.col("district_code").alias("_district"),
        F.year("filed_date").cast("string").alias("_filing_year"),
        F.coalesce("nature_of_suit_family", F.lit(UNSUPPORTED)).alias("_nature_family"),
        (F.col("source_record_count") == 1).cast("string").alias("_collision_free"),
        "matched",
    )
    names = ["_district", "_filing_year", "_nature_family", "_collision_free"]
    out = rows.groupingSets([[], *[[n] for n in names]], *names).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("records"), F.count_if("matched").alias("matched_records")
    )
    kind, value = F.when(F.col("_g") == 15, "overall"), F.when(F.col("_g") == 15, "all")
    for k, name in enumerate(names):
        kind, value = kind.when(F.col("_g") == 15 - (8 >> k), name[1:]), value.when(F.col("_g") == 15 - (8 >> k), F.col(name))
    return out.select(
        kind.alias("dimension_type"),
        value.alias("dimension_value"),
        "records",
        "matched_records",
        ratio(F.col("matched_records"), F.col("records")).alias("coverage"),
    ).where("dimension_type <> 'collision_free' OR dimension_value = 'true'")


def population_counts(records: DataFrame, districts: DataFrame, start: str, end: str) -> DataFrame:
    """filed, terminated and pending by district and in total; districts without records stay, with zeros.

    Filings and terminations count by date inside the window; pending stock does
    not look at it.
    """
    inside = lambda c: F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    counts = records.groupingSets([["district_code"], []], "district_code").agg(
        F.count_if(inside("filed_date")).alias("filed"),
        F.count_if(inside("terminated_date")).alias("terminated"),
        F.count_if(~F.col("event_observed")).alias("pending"),
        F.grouping_id().alias("_g"),
    )
    counts = counts.withColumn("district_code", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("district_code")))
    names = districts.select("district_code").unionByName(districts.sparkSession.createDataFrame([("TOTAL",)], "district_code string"))
    return names.join(counts.drop("_g"), "district_code", "left").na.fill(0, ["filed", "terminated", "pending"])


def tie_out(independent: DataFrame, own: DataFrame) -> DataFrame:
    """Each district's three totals against the independent ones, with verdicts; a zero total never passes."""
    measures = ["filed", "terminated", "pending"]
    a = independent.unpivot("district_code", measures, "measure", "ao_value")
    b = own.unpivot("district_code", measures, "measure", "fjc_value")
    rows = a.join(b, ["district_code", "measure"])
    total = F.col("district_code") == "TOTAL"
    rows = rows.withColumn("difference", F.col("fjc_value") - F.col("ao_value")).withColumns(
        {
            "relative_difference": ratio(F.abs("difference"), F.col("ao_value")),
            "tolerance": F.when(total, F.lit(TOTAL_TOLERANCE)).otherwise(F.lit(DISTRICT_TOLERANCE)),
            "required_for_gate": total,
        }
    )
    rows = rows.withColumn("passed", F.col("relative_difference") <= F.col("tolerance"))
    reason = (
        F.when(F.col("difference") == 0, "exact")
        .when(total, "publication_version_lag")
        .when(F.col("passed"), "within_predeclared_district_tolerance")
        .otherwise("district_definition_or_mdl_review_required")
    )
    disposition = (
        F.when(F.col("passed"), "accepted")
        .when(total, "blocks_reconciliation")
        .otherwise("retained_unresolved_district_diagnostic")
    )
    return rows.withColumns({"reason_code": reason, "disposition": disposition})


def scope_bridge(facts: DataFrame, population: DataFrame, start: str, end: str) -> DataFrame:
    """The complete snapshot's totals against the product's, by measure."""
    inside = lambda c: F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    product = facts.agg(
        F.count_if(inside("filed_date")).alias("filed"),
        F.count_if(inside("terminated_date")).alias("terminated"),
        F.count_if(~F.col("event_observed")).alias("pending"),
    ).unpivot([], ["filed", "terminated", "pending"], "measure", "product_value")
    whole = population.where("district_code = 'TOTAL'").unpivot(
        [], ["filed", "terminated", "pending"], "measure", "complete_snapshot_value"
    )
    why = (
        F.when(F.col("measure") == "pending", "pre_2010_product_scope_exclusion")
        .when(F.col("measure") == "terminated", "structural_quarantine_and_product_scope")
        .otherwise("no_scope_difference")
    )
    return whole.join(product, "measure").select(
        "measure",
        "complete_snapshot_value",
        "product_value",
        (F.col("complete_snapshot_value") - F.col("product_value")).alias("excluded_or_quarantined_records"),
        why.alias("explanation"),
    )


def review_sample(candidates: DataFrame, size: int) -> DataFrame:
    """A blinded sample: the first of each court, five-year band and evidence band, then by a seeded order.

    The limit is the feature. Outcome columns are left out.
    """
    rows = candidates.where("candidate_status = 'review_eligible'").withColumns(
        {
            "evidence_band": F.when(F.col("fjc_terminated_date").isNull(), "pending")
            .when(F.col("recap_terminated_date").isNull(), "missing_recap_termination")
            .otherwise("terminated_agreement"),
            "filing_year_band": five_year_band(F.col("filed_date")),
            "review_order": F.xxhash64("court_id", "filed_date", "case_identifier", "recap_docket_id", F.lit(17)),
        }
    )
    ties = ["review_order", "case_identifier", "recap_docket_id"]
    # The first of each stratum comes from partial minima: a row for each stratum, however large it is.
    firsts = [
        rows.groupBy(stratum).agg(F.min(F.struct(*ties)).alias("low")).select("low.*")
        for stratum in ("court_id", "filing_year_band", "evidence_band")
    ]
    first = firsts[0].unionByName(firsts[1]).unionByName(firsts[2]).distinct().withColumn("_later", F.lit(False))
    rows = rows.join(first, ties, "left").withColumn("_later", F.coalesce("_later", F.lit(True)))
    rows = rows.orderBy("_later", *ties).limit(size)
    item = F.row_number().over(W.orderBy("_later", *ties)).alias("review_item")
    return rows.select(
        item, "case_identifier", "recap_docket_id", "district_code", "court_id", "office_code", "docket_number_core", "filed_date"
    )


def binomial_lower_bound(successes: int, trials: int, alpha: float = 0.05) -> float:
    """The exact (Clopper-Pearson) lower bound: the p at which this many successes or more have chance alpha / 2."""
    if successes == 0:
        return 0.0
    logs = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in range(successes, trials + 1)]

    def tail(p: float) -> float:
        return sum(
            math.exp(c + k * math.log(p) + ((trials - k) * math.log1p(-p) if k < trials else 0.0))
            for k, c in zip(range(successes, trials + 1), logs, strict=True)
        )

    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if tail(middle) < alpha / 2 else (low, middle)
    return low


def review_precision(reviewed: DataFrame, required: float = 0.995) -> dict:
    """True and false labels and whether the exact lower bound reaches what is required."""
    row = reviewed.agg(
        F.count_if(F.col("review_label") == "true_match").alias("true"),
        F.count_if(F.col("review_label") == "false_match").alias("false"),
        F.count("*").alias("n"),
    ).first()
    if row["true"] + row["false"] != row["n"]:
        raise ValueError("a review label is missing or unknown")
    bound = binomial_lower_bound(row["true"], row["n"]) if row["n"] else 0.0
    return {"true_matches": row["true"], "false_matches": row["false"], "lower_bound": bound, "passed": bound >= required}
