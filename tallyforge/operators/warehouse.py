"""Record semantics, identity quality, codebook mapping and the facts built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.contracts import FACT, conform
from tallyforge.functions.codebook import codebook
from tallyforge.functions.semantics import UNSUPPORTED, days_between, joined_key, procedural_cohort


def record_semantics(records: DataFrame) -> DataFrame:
    """Natural key, right-censored end and duration of every record.

    An observed event ends at its termination, any other record is censored at
    the snapshot.
    """
    end = F.when(F.col("event_observed"), F.col("terminated_source")).otherwise(F.col("source_snapshot_cutoff"))
    return records.select(
        "*",
        joined_key(*map(F.col, ("circuit_code", "district_code", "office_code", "docket_number"))).alias(
            "natural_case_identifier"
        ),
        F.when(F.col("event_observed"), F.col("terminated_source")).alias("terminated_date"),
        F.when(~F.col("event_observed"), F.col("source_snapshot_cutoff")).alias("censoring_date"),
        end.alias("analysis_end_date"),
        days_between(F.col("filed_date"), end).alias("duration_days"),
    )


def identity_quality(records: DataFrame) -> DataFrame:
    """How many records share a natural key.

    Keys are counted by partial sums and only those with more than one record
    are joined back, so a key that very many records share (as when all its
    parts are missing) is neither sorted nor gathered.
    """
    shared = records.groupBy("natural_case_identifier").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = shared.withColumnRenamed("natural_case_identifier", "_key")
    joined = records.join(shared, records["natural_case_identifier"] == shared["_key"], "left")
    n = F.coalesce("_n", F.lit(1).cast("long"))
    return joined.withColumn("source_record_count", n).drop("_n", "_key").withColumn(
        "identity_quality_status", F.when(F.col("source_record_count") == 1, "canonical").otherwise("collision")
    )


def map_codes(records: DataFrame) -> DataFrame:
    """Codebook columns by a left join with its 93 rows."""
    book = F.broadcast(codebook(records.sparkSession))
    family = F.coalesce("family", F.lit(UNSUPPORTED))
    return records.join(book, records["nature_of_suit_raw"] == book["raw_code"], "left").select(
        records["*"],
        F.col("canonical_code").alias("nature_of_suit_code"),
        F.col("family").alias("nature_of_suit_family"),
        F.when(F.col("raw_code").isNull(), UNSUPPORTED).otherwise("supported").alias("nature_of_suit_mapping_status"),
        procedural_cohort(F.col("origin_code"), family).alias("intake_procedural_cohort"),
    )


def statistical_records(records: DataFrame) -> DataFrame:
    """The fact table: one row for each source record."""
    return conform(map_codes(identity_quality(record_semantics(records))), FACT)


def cases(facts: DataFrame) -> DataFrame:
    """Records whose natural key is theirs alone."""
    return facts.where("source_record_count = 1").withColumnRenamed("natural_case_identifier", "case_identifier")


def identity_exceptions(facts: DataFrame) -> DataFrame:
    """Records that share a natural key; they are never merged."""
    return facts.where("source_record_count > 1")


def append_new(existing: DataFrame, incoming: DataFrame, digest: str = "source_digest") -> DataFrame:
    """Incremental load: incoming rows of snapshots that are not loaded yet, after the existing rows."""
    new = incoming.join(existing.select(digest).distinct(), digest, "left_anti")
    return existing.unionByName(new)


def merge_new(existing: DataFrame, incoming: DataFrame, key: str = "source_record_identifier", digest: str = "source_digest") -> DataFrame:
    """Incremental load that replaces: rows of new snapshots take the place of existing rows with their key.

    A record's identity status depends on all records with its natural key, so
    it must be made again over the result.
    """
    new = incoming.join(existing.select(digest).distinct(), digest, "left_anti")
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def with_matches(records: DataFrame, promoted: DataFrame) -> DataFrame:
    """``matched``: whether the record was promoted. Repeated promotions do not multiply records."""
    keys = promoted.select(F.col("source_record_identifier").alias("_match")).distinct()
    return (
        records.join(keys, records["source_record_identifier"] == keys["_match"], "left")
        .withColumn("matched", F.col("_match").isNotNull())
        .drop("_match")
    )
