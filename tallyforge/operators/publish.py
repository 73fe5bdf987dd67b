"""The public, identifier-minimised row mart: projection, opaque keys, validation and files."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.semantics import UNSUPPORTED, procedural_cohort
from tallyforge.operators.warehouse import with_matches

KEY_BYTES, MIN_SECRET_BYTES, ROW_GROUP_ROWS = 16, 32, 65_536

#: Values that a public text may not hold (fixed patterns).
PROHIBITED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "credential": r"(?i)(password|secret|api_key)\s*[=:]\s*\S{6,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_key": r"AKIA[A-Z0-9]{16}",
}


def release_key(identifier: Column, dataset_version: str, secret: bytes) -> Column:
    """A keyed digest of the identifier, 22 characters.

    The secret travels inside the function, so neither plan nor event log holds it.
    """
    if len(secret) < MIN_SECRET_BYTES:
        raise ValueError(f"the secret needs {MIN_SECRET_BYTES} bytes")

    @F.pandas_udf("string")
    def keyed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prefix = hmac.new(secret, f"v1\0{dataset_version}\0".encode(), hashlib.sha256)
        for part in parts:
            out = []
            for value in part:
                if value is None:
                    out.append(None)
                    continue
                own = prefix.copy()
                own.update(value.encode())
                out.append(base64.urlsafe_b64encode(own.digest()[:KEY_BYTES]).decode().rstrip("="))
            yield pd.Series(out, dtype=object)

    return keyed(identifier)


def public_rows(facts: DataFrame, promoted: DataFrame, key: Column, dataset_version: str) -> DataFrame:
    """The 19 public columns; dates are cut to months."""
    family = F.coalesce("nature_of_suit_family", F.lit(UNSUPPORTED))
    return with_matches(facts, promoted).select(
        key.alias("release_record_key"),
        "circuit_code",
        "district_code",
        F.trunc("filed_date", "month").alias("filed_month"),
        F.trunc("terminated_date", "month").alias("terminated_month"),
        (~F.col("event_observed")).alias("pending_status"),
        "event_observed",
        F.col("duration_days").cast("int").alias("duration_days"),
        "nature_of_suit_code",
        family.alias("nature_of_suit_family"),
        "nature_of_suit_mapping_status",
        "jurisdiction_code",
        "origin_code",
        procedural_cohort(F.col("origin_code"), family).alias("procedural_cohort"),
        "identity_quality_status",
        F.col("source_record_count").cast("int").alias("source_record_count"),
        F.col("matched").alias("recap_match_available"),
        "source_snapshot_cutoff",
        F.lit(dataset_version).alias("dataset_version"),
    )


#: Columns of public rows, in order (fixed values).
PUBLIC_COLUMNS = [
    "release_record_key", "circuit_code", "district_code", "filed_month", "terminated_month", "pending_status", "event_observed",
    "duration_days", "nature_of_suit_code", "nature_of_suit_family", "nature_of_suit_mapping_status", "jurisdiction_code", "origin_code",
    "procedural_cohort", "identity_quality_status", "source_record_count", "recap_match_available", "source_snapshot_cutoff", "dataset_version",
]


def public_violations(rows: DataFrame, dataset_version: str, cutoff: str, expected_collisions: int | None = None) -> DataFrame:
    """(rule, failures) of the row contract. Uniqueness takes one shuffle, all other rules one pass.

    A rule that a null leaves open has failed. A missing or an extra column is
    one failure of the rule ``schema``, and then no other rule is looked at.
    """
    wrong = sorted(set(rows.columns) ^ set(PUBLIC_COLUMNS))
    if wrong:
        return rows.sparkSession.range(1).select(F.lit("schema").alias("rule"), F.lit(len(wrong)).cast("long").alias("failures"))
    first_day = lambda c: F.dayofmonth(c) == 1
    c = F.col
    ended = c("terminated_month")
    status, identity = c("nature_of_suit_mapping_status"), c("identity_quality_status")
    good = {
        "schema": F.lit(True),
        "key_shape": c("release_record_key").rlike("^[A-Za-z0-9_-]{22}$"),
        "dataset_version": c("dataset_version") == dataset_version,
        "source_cutoff": c("source_snapshot_cutoff") == F.lit(cutoff).cast("date"),
        "filed_month": first_day("filed_month"),
        "pending_semantics": c("pending_status") != c("event_observed"),
        "termination_null_rule": c("pending_status") == ended.isNull(),
        "terminated_month": ended.isNull() | (first_day("terminated_month") & (ended >= c("filed_month"))),
        "duration": c("duration_days") >= 0,
        "mapping_status": status.isin("supported", "unsupported"),
        "code_null_rule": (status == "supported") == c("nature_of_suit_code").isNotNull(),
        "identity_status": identity.isin("canonical", "collision"),
        "identity_count": F.when(identity == "canonical", c("source_record_count") == 1).otherwise(c("source_record_count") >= 2),
    }
    measures = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in good.items()]
    collisions = F.count_if(identity == "collision")
    expected = collisions if expected_collisions is None else F.lit(expected_collisions).cast("long")
    measures.append(F.abs(collisions - expected).alias("collision_total"))
    measures.append(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("not_empty"))
    one = rows.agg(*measures).unpivot([], [*good, "collision_total", "not_empty"], "rule", "failures")
    again = rows.groupBy("release_record_key").count().where("count > 1").agg(F.count("*").alias("failures"))
    return one.unionByName(again.select(F.lit("key_unique").alias("rule"), "failures"))


#: Column names that must not be published (fixed values).
PROHIBITED_NAMES = r"(?i)(docket|case_identifier|natural_case|source_record_identifier|party|plaintiff|defendant|attorney|judge)"


def prohibited_columns(columns: list[str], pattern: str = PROHIBITED_NAMES) -> list[str]:
    """The columns whose very name gives an identity away."""
    return [name for name in columns if re.search(pattern, name)]


def physical_audit(rows: DataFrame) -> DataFrame:
    """One row: what the whole written mart holds."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.countDistinct("release_record_key").alias("keys"),
        F.count_if("pending_status").alias("pending_records"),
        F.count_if(F.col("identity_quality_status") == "collision").alias("collision_records"),
        F.min(F.year("filed_month")).cast("long").alias("first_year"),
        F.max(F.year("filed_month")).cast("long").alias("last_year"),
    )


def release_inventory(files: dict[str, bytes], ceiling: int = 262_144_000) -> dict:
    """Each file's size and digest and the release's own digest; too large a release is refused."""
    total = sum(map(len, files.values()))
    if total > ceiling:
        raise ValueError(f"the release has {total} bytes, more than {ceiling}")
    parts = [{"path": k, "bytes": len(v), "sha256": hashlib.sha256(v).hexdigest()} for k, v in sorted(files.items())]
    text = json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()
    return {"files": parts, "bytes": total, "sha256": hashlib.sha256(text).hexdigest()}


def export_provenance(columns: list[str], filters: dict[str, str], rows: int, dataset_version: str, digest: str) -> str:
    """The sidecar of an export as canonical JSON; it holds no time, so equal exports have equal sidecars."""
    body = {
        "columns": list(columns), "filters": filters, "rows": rows, "dataset_version": dataset_version, "content_digest": digest,
    }
    return json.dumps(body, sort_keys=True, separators=(",", ":"), allow_nan=False)


def compatible_manifest(manifest: dict, dataset_version: str, years: list[int]) -> list[str]:
    """What makes a manifest unfit for a reader: an empty list if nothing does."""
    problems = []
    if manifest.get("dataset_version") != dataset_version:
        problems.append("dataset_version")
    parts = manifest.get("partitions") or []
    if [p.get("filing_year") for p in parts] != sorted(years):
        problems.append("partitions")
    if sum(p.get("rows", 0) for p in parts) != manifest.get("total_rows"):
        problems.append("total_rows")
    if any(not re.fullmatch("[0-9a-f]{16}", str(p.get("digest", ""))) for p in parts):
        problems.append("digest")
    return problems


def prohibited_scan(df: DataFrame, columns: list[str], patterns: dict[str, str] = PROHIBITED) -> DataFrame:
    """(pattern, rows): rows whose text columns hold a prohibited value; one pass."""
    text = F.concat_ws("\0", *[F.col(c).cast("string") for c in columns])
    counts = df.select(text.alias("_t")).agg(*[F.count_if(F.col("_t").rlike(p)).alias(k) for k, p in patterns.items()])
    return counts.unpivot([], list(patterns), "pattern", "rows")


def write_public(rows: DataFrame, path: str) -> None:
    """By filing year, sorted for row-group pruning, in row groups of a fixed number of rows."""
    (
        rows.withColumn("filing_year", F.year("filed_month"))
        .repartition("filing_year", "district_code")
        .sortWithinPartitions("filing_year", "district_code", "nature_of_suit_family", "release_record_key")
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        .partitionBy("filing_year")
        .parquet(path)
    )


def content_digest(rows: DataFrame) -> tuple[int, int]:
    """(rows, order-free digest): equal for equal content, however it is split into files."""
    h = F.xxhash64(*rows.columns)
    out = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    return out["n"], hash((out["x"] or 0, out["s"] or 0))


def manifest(rows: DataFrame, dataset_version: str) -> dict:
    """Rows by filing year with their totals: a row for each year reaches the driver."""
    years = rows.groupBy(F.year("filed_month").alias("year")).agg(
        F.count("*").alias("rows"), F.count_if("pending_status").alias("pending"), F.bit_xor(F.xxhash64(*rows.columns)).alias("digest")
    )
    parts = [{"filing_year": r["year"], "rows": r["rows"], "pending": r["pending"], "digest": f"{r['digest'] & (2**64 - 1):016x}"} for r in years.orderBy("year").collect()]
    return {
        "dataset_version": dataset_version,
        "partitions": parts,
        "total_rows": sum(p["rows"] for p in parts),
        "pending_rows": sum(p["pending"] for p in parts),
    }
