"""Reading governed extracts: exact headers, triage into accepted, excluded and quarantined rows, accounting."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.semantics import office_code, parse_us_date, spreadsheet_safe

MAX_MEMBERS, MAX_EXPANDED_BYTES, MAX_RATIO = 64, 8 << 30, 200


class IngestError(ValueError):
    """A source that does not meet its contract."""


# Files


def verify_digest(path: str, size: int, sha256: str) -> None:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
        if f.tell() != size or digest.hexdigest() != sha256:
            raise IngestError("size or digest differs from the manifest")


def check_archive(path: str) -> list[zipfile.ZipInfo]:
    """The archive's members, within budgets for their number, expanded size and ratio."""
    members = zipfile.ZipFile(path).infolist()
    expanded, packed = sum(m.file_size for m in members), max(1, sum(m.compress_size for m in members))
    if len(members) > MAX_MEMBERS or expanded > MAX_EXPANDED_BYTES or expanded / packed > MAX_RATIO:
        raise IngestError("the archive exceeds its budgets")
    return members


def check_pdf(df: DataFrame) -> DataFrame:
    """(path, valid) of binary files: the envelope of a PDF."""
    tail = F.expr("substring(content, -1024, 1024)")
    return df.select("path", (F.expr("substring(content, 1, 5)") == F.lit(bytearray(b"%PDF-"))).alias("_h"), F.contains(tail, F.lit(bytearray(b"%%EOF"))).alias("_t")).select(
        "path", (F.col("_h") & F.col("_t")).alias("valid")
    )


def read_header(path: str, member: str | None = None) -> tuple[list[str], str]:
    """(column names, delimiter) of a table in a ZIP archive; tab if the first line has one, else comma."""
    members = [m.filename for m in check_archive(path) if re.search(r"\.(txt|tsv|csv)$", m.filename)]
    if not members:
        raise IngestError("the archive holds no table")
    with zipfile.ZipFile(path).open(member or members[0]) as f:
        line = io.TextIOWrapper(f, "utf-8", errors="replace").readline().rstrip("\r\n")
    delimiter = "\t" if "\t" in line else ","
    return line.split(delimiter), delimiter


def unpack(path: str, folder: str) -> str:
    """Expands the one .txt member of an archive next to where Spark reads it, block by block."""
    members = [m for m in check_archive(path) if m.filename.endswith(".txt")]
    if len(members) != 1:
        raise IngestError("the archive must hold one .txt member")
    target = Path(folder) / Path(members[0].filename).name
    with zipfile.ZipFile(path).open(members[0]) as source, open(target, "wb") as out:
        while block := source.read(1 << 20):
            out.write(block)
    return str(target)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line, earlier): every line with its 0-based number in its file, and the rows of files with earlier names, a header each not counted.

    Files are read in parallel. A line's place in its block is known where it is
    read; a running sum over the blocks' counts, a small table, gives where the
    block begins.
    """
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("_at"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
    )
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    files = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    sizes = blocks.groupBy("_file").agg(F.sum("_n").alias("_lines"))
    sizes = sizes.select("_file", F.coalesce(F.sum(F.col("_lines") - 1).over(files), F.lit(0)).alias("earlier"))
    blocks = blocks.drop("_n").join(sizes, "_file")
    placed = lines.join(F.broadcast(blocks), ["_file", "_block"])  # a row a block
    return placed.select("value", (F.col("_offset") + F.col("_at") - F.col("_first")).alias("line"), "earlier")


def read_tsv(spark: SparkSession, path: str, header: list[str], selected: list[str], parts: bool = False) -> DataFrame:
    """Selected columns of a tab-separated file as strings, with row numbers and structural rejects.

    Only a file's first line is its header, and it must be exactly as agreed; a
    later line like it is a row. Rows are numbered from 0 in ``source_row_number``,
    in each file or, where the files are parts of one table in the order of their
    names, through all parts.
    A row with another number of fields, or with bytes that are no UTF-8 in a
    selected field, gets a ``_structural`` reason. Unselected fields are not
    looked at.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first or first[0][0].split("\t") != header:
        raise IngestError("the header differs from the contract")
    lines = numbered_lines(spark, path)
    # These functions work on bytes, so a field keeps what the file holds, valid or not.
    raw = {c: F.substring_index(F.substring_index("value", "\t", header.index(c) + 1), "\t", -1) for c in selected}
    fields = F.octet_length("value") - F.octet_length(F.replace("value", F.lit("\t"), F.lit(""))) + 1
    bad = F.lit(False)
    for c in raw.values():
        bad = bad | ~F.is_valid_utf8(c)
    header_differs = (F.col("line") == 0) & (F.col("value") != "\t".join(header))
    reason = F.when(header_differs, "header").when(fields != len(header), "field_count").when(bad, "invalid_utf8")
    values = [F.nullif(F.try_validate_utf8(v), F.lit("")).alias(c) for c, v in raw.items()]
    rows = lines.where((F.col("line") > 0) | header_differs)
    number = F.col("line") - 1 + (F.col("earlier") if parts else F.lit(0))
    return rows.select(*values, number.alias("source_row_number"), reason.alias("_structural"))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Structural rejects that another reader left as JSON lines: a row number and a reason."""
    return spark.read.schema("source_row_number long, reason string").json(path)


def read_review(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A review table by its suffix: CSV with a header, or Parquet; its columns in the given types."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif path.endswith(".csv"):
        rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        raise IngestError("a review table is CSV or Parquet")
    want = T.StructType.fromDDL(schema)
    if missing := [f.name for f in want if f.name not in rows.columns]:
        raise IngestError(f"the review table lacks {missing}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def write_review(rows: DataFrame, path: str) -> None:
    """A review table as CSV, its texts safe to open in a spreadsheet."""
    safe = [spreadsheet_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*safe).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def existing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths, if every one exists; an error that names the missing ones otherwise."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not path(p).getFileSystem(conf).exists(path(p))]
    if missing:
        raise IngestError(f"required files are missing: {missing}")
    return paths


def read_years(spark: SparkSession, folder: str, years: list[int]) -> DataFrame:
    """The annual partitions that a product needs, all of them or an error."""
    paths = existing_files(spark, [f"{folder}/filing_year={y}" for y in years])
    return spark.read.option("basePath", folder).parquet(*paths)


def freshness(runs: DataFrame, now: str, warn_days: int = 150, error_days: int = 365) -> DataFrame:
    """(completed_at_utc, age_days, status) of the latest completed run; no run is an error."""
    out = runs.agg(F.max(F.to_timestamp("completed_at_utc")).alias("completed_at_utc"))
    age = F.datediff(F.lit(now).cast("date"), F.col("completed_at_utc").cast("date"))
    status = F.when(age <= warn_days, "pass").when(age <= error_days, "warn").otherwise("error")
    return out.select("completed_at_utc", age.cast("long").alias("age_days"), status.alias("status"))


# Staging

#: Raw fields and the names that staging gives them (fixed values); dates are parsed, all else is trimmed text.
STAGED = {
    "CIRCUIT": "circuit_code", "DISTRICT": "district_code", "OFFICE": "office_code", "DOCKET": "docket_number",
    "ORIGIN": "origin_code", "JURIS": "jurisdiction_code", "NOS": "nature_of_suit_raw", "TITL": "title_raw",
    "SECTION": "section_raw", "SUBSECT": "subsection_raw", "RESIDENC": "residence_raw", "JURY": "jury_demand_raw",
    "CLASSACT": "class_action_raw", "DEMANDED": "amount_demanded_raw", "COUNTY": "county_raw", "ARBIT": "arbitration_raw",
    "MDLDOCK": "mdl_docket_raw", "TRANSDAT": "transfer_date_raw", "TRANSOFF": "transfer_office_raw",
    "TRANSDOC": "transfer_docket_raw", "TRANSORG": "transfer_origin_raw", "TERMDATE": "termination_date_raw",
    "TRCLACT": "termination_class_action_raw", "PROCPROG": "procedural_progress_code", "DISP": "disposition_code",
    "NOJ": "judgment_nature_raw", "AMTREC": "amount_received_raw", "JUDGMENT": "judgment_raw",
    "DJOINED": "issue_joined_date_raw", "PRETRIAL": "pretrial_date_raw", "TRIBEGAN": "trial_begin_date_raw",
    "TRIALEND": "trial_end_date_raw", "TRMARB": "termination_arbitration_raw", "PROSE": "pro_se_raw", "IFP": "fee_status_raw",
    "STATUSCD": "status_code", "TAPEYEAR": "statistical_year",
}
STAGED_DATES = {
    "FILEDATE": "filed_date", "FDATEUSE": "filed_date_used_by_ao", "TERMDATE": "termination_date_source", "TDATEUSE": "termination_date_used_by_ao",
}


def stage_records(rows: DataFrame, digest: str, cutoff: str, version: int = 1) -> DataFrame:
    """Accepted raw rows as typed, named columns with their provenance and the identity ``digest:row``."""
    row = F.col("source_row_number").cast("long")
    return rows.select(
        F.concat(F.lit(f"{digest}:"), row.cast("string")).alias("source_record_identifier"),
        row.alias("source_row_number"),
        *[F.trim(raw).alias(name) for raw, name in STAGED.items() if raw in rows.columns],
        *[parse_us_date(F.trim(raw)).alias(name) for raw, name in STAGED_DATES.items() if raw in rows.columns],
        F.lit(cutoff).cast("date").alias("source_snapshot_cutoff"),
        F.lit(digest).alias("source_digest"),
        F.lit(version).cast("long").alias("raw_contract_version"),
        F.year(parse_us_date(F.trim("FILEDATE"))).cast("long").alias("filing_year"),
    )


def stage_districts(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.trim(c).alias(c) for c in ("district_code", "court_id", "ao_label")])


def stage_promoted(rows: DataFrame) -> DataFrame:
    names = ("case_identifier", "source_record_identifier", "recap_docket_id", "match_rule_id")
    return rows.select(*[F.col(c).cast("string") for c in names], F.col("review_completed_at_utc").cast("timestamp"))


def write_dockets(rows: DataFrame, path: str, digest: str, cutoff: str, version: int = 1) -> None:
    """Accepted dockets with their provenance, by filing year; a row without a year is refused."""
    good = rows.where("reject_reason IS NULL").drop("reject_reason").withColumns(
        {
            "source_snapshot_cutoff": F.lit(cutoff).cast("date"),
            "source_digest": F.lit(digest),
            "reconciliation_contract_version": F.lit(version).cast("int"),
            "filing_year": partition_year(F.col("filed_date")),
        }
    )
    good.write.option("compression", "zstd").partitionBy("filing_year").parquet(path)


def partition_year(day: Column) -> Column:
    """The year of a date as a partition value; anything but four digits stops the write."""
    year = F.year(day).cast("string")
    return F.when(year.rlike("^[0-9]{4}$"), year).otherwise(F.raise_error(F.lit("a partition year must have four digits")))


# Triage


def status_is_valid() -> Column:
    """Terminated, or pending with all sentinels; a null never counts as valid."""
    pending = (
        (F.col("STATUSCD") == "S")
        & (F.col("TERMDATE") == "01/01/1900")
        & F.col("TDATEUSE").isNull()
        & (F.col("TAPEYEAR") == "2099")
    )
    return F.coalesce((F.col("STATUSCD") == "L") | pending, F.lit(False))


def triage(rows: DataFrame, start: str, cutoff: str) -> DataFrame:
    """Each row's outcome (accepted, excluded, rejected) and reason; exclusion goes before rejection."""
    filed = F.col("filed_date_parsed")
    first, last = F.lit(start).cast("date"), F.lit(cutoff).cast("date")
    rows = rows.withColumn("filed_date_parsed", parse_us_date(F.col("FILEDATE")))
    outside = F.coalesce(filed < first, F.lit(False))
    # A row that could not be read as agreed is rejected for that, whatever it holds.
    structural = F.col("_structural") if "_structural" in rows.columns else F.lit(None).cast("string")
    outside = outside & structural.isNull()
    reason = (
        F.when(structural.isNotNull(), structural)
        .when(outside, "before_product_start")
        .when(filed.isNull(), "invalid_filed_date")
        .when(filed > last, "filed_after_snapshot")
        .when(~status_is_valid(), "invalid_status_sentinel")
    )
    outcome = F.when(outside, "excluded").when(reason.isNull(), "accepted").otherwise("rejected")
    return rows.withColumns({"reason": reason, "outcome": outcome})


def accounting(triaged: DataFrame) -> dict[str, int]:
    """Rows by outcome; they must add up to all rows."""
    row = triaged.agg(
        F.count("*").alias("input"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "excluded", "rejected")]
    ).first()
    if row["accepted"] + row["excluded"] + row["rejected"] != row["input"]:
        raise IngestError("rows are not accounted for")
    return row.asDict()


def normalise_dockets(rows: DataFrame, courts: list[str], start: str, end: str, keep: list[str] | None = None) -> DataFrame:
    """Docket rows with the first rule that they break, or with their normalised values; columns to keep come along."""
    filed = F.try_to_date(F.col("date_filed"), "yyyy-MM-dd")
    inside = F.coalesce(filed.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    core = F.trim("docket_number_core")
    office = office_code(F.col("federal_dn_office_code"))
    reason = (
        F.when(~F.coalesce(F.col("court_id").isin(*courts), F.lit(False)), "court_not_selected")
        .when(F.lower(F.trim("blocked")).isin("1", "t", "true"), "blocked")
        .when(~F.coalesce(F.lower(F.trim("federal_dn_case_type")) == "cv", F.lit(False)), "not_civil")
        .when(~inside, "filed_outside_population")
        .when(~F.coalesce(core.rlike("^[0-9]{7}$"), F.lit(False)), "invalid_docket_core")
        .when(office.isNull(), "invalid_office")
    )
    return rows.select(
        F.trim("id").alias("recap_docket_id"),
        "court_id",
        office.alias("office_code"),
        core.alias("docket_number_core"),
        filed.alias("filed_date"),
        F.try_to_date(F.col("date_terminated"), "yyyy-MM-dd").alias("terminated_date"),
        reason.alias("reject_reason"),
        *(keep or []),
    )


def load_snapshot(rows: DataFrame, folder: str, start: str, cutoff: str, digest: str) -> dict:
    """Triages a snapshot into ``folder`` once: staged, checked, then renamed; a replay does nothing.

    Accepted rows go to Parquet by filing year, quarantined rows keep a reason
    and their ``source_row_number``, if they have one, and no payload. A failure leaves a record and no staged files.
    """
    spark, final = rows.sparkSession, f"{folder}/source_digest={digest}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(final).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = path(f"{final}/run.json")
    if fs.exists(done):
        text = spark.read.text(f"{final}/run.json", wholetext=True).first()[0]
        return json.loads(text) | {"replayed": True}
    staging = f"{final}.staging"
    fs.delete(path(staging), True)
    try:
        out = triage(rows, start, cutoff)
        out.write.parquet(f"{staging}/triaged")
        back = spark.read.schema(out.schema).parquet(f"{staging}/triaged")
        counts = accounting(back)
        good = back.where("outcome = 'accepted'").drop("outcome", "reason", "_structural")
        good = good.withColumn("filing_year", partition_year(F.col("filed_date_parsed")))
        good.write.option("compression", "zstd").partitionBy("filing_year").parquet(f"{staging}/accepted")
        reference = [c for c in ("source_row_number",) if c in back.columns]
        back.where("outcome = 'rejected'").select(*reference, "reason").write.parquet(f"{staging}/quarantine")
        fs.delete(path(f"{staging}/triaged"), True)
        stream = fs.create(path(f"{staging}/run.json"))
        stream.write(bytearray(json.dumps(counts, sort_keys=True).encode()))
        stream.close()
        if not fs.rename(path(staging), path(final)):
            raise IngestError("the staged snapshot could not be renamed")
        return counts | {"replayed": False}
    except Exception as error:
        fs.delete(path(staging), True)
        fs.mkdirs(path(folder))
        stream = fs.create(path(f"{folder}/failure-{digest}.json"))
        stream.write(bytearray(json.dumps({"error": type(error).__name__}).encode()))
        stream.close()
        raise
