"""Queries over written stores and compressed extracts, which Spark writes from the given tables and reads again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.operators import explorer, storage, upkeep
from tallyforge.plans import fixtures as fx
from tallyforge.plans import registry as core
from tallyforge.plans.registry import query
from tallyforge.sources import archives, drift, ingest
from tallyforge.sources.shared import arrow_files, new_path, write_parts, written

# Upkeep


@query(
    "incremental_facts",
    """, latest AS (SELECT * REPLACE (CASE WHEN o_orderkey % 20 = 0 THEN 'shared' ELSE docket_number END AS docket_number,
    CASE WHEN o_orderkey % 100 = 1 THEN filed_date - 365 ELSE filed_date END AS filed_date) FROM raw),
keyed AS (SELECT source_record_identifier, filed_date, concat_ws('|', circuit_code, district_code, office_code, docket_number) AS natural_case_identifier FROM latest)
SELECT source_record_identifier, filed_date, natural_case_identifier, count(*) OVER (PARTITION BY natural_case_identifier) AS source_record_count FROM keyed""",
)
def incremental_facts(spark, d):
    """Three snapshots and one that was loaded before: half of the records, the rest with revised keys and dates of some, and revisions again."""
    rows, k = written(fx.records(spark, d), "records"), F.col("o_orderkey")
    revised = rows.withColumn("docket_number", F.when(k % 20 == 0, "shared").otherwise(F.col("docket_number"))).withColumn(
        "filed_date", F.when(k % 100 == 1, F.date_sub("filed_date", 365)).otherwise(F.col("filed_date"))
    )
    store = upkeep.FactStore(spark, new_path(spark, "facts"))
    store.load(rows.where(k % 4 < 2), "a")
    store.load(revised.where((k % 4 == 2) | (k % 20 == 0)), "b")
    store.load(rows.where(k % 4 == 0), "a")
    store.load(revised.where((k % 4 == 3) | (k % 100 == 1)), "c")
    return store.facts().select("source_record_identifier", "filed_date", "natural_case_identifier", "source_record_count")


# Compressed extracts


@query(
    "docket_extract",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT n::BIGINT AS source_row_number, CASE WHEN o_orderkey % 40 = 0 THEN 'field_count' WHEN o_orderkey % 9 = 0 THEN 'not_civil' WHEN o_orderdate::DATE NOT BETWEEN DATE '1994-01-01' AND DATE '2000-12-31' THEN 'filed_outside_population'
    WHEN o_orderkey % 11 = 0 THEN 'invalid_docket_core' END AS reason,
  CASE WHEN o_orderkey % 40 <> 0 THEN o_orderkey::VARCHAR END AS recap_docket_id, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate::DATE END AS filed_date,
  CASE WHEN o_orderkey % 40 <> 0 THEN length(o_orderpriority) + 14 END::BIGINT AS note_length FROM r""",
    base=False,
)
def docket_extract(spark, d):
    """Dockets as bz2-compressed CSV in ordered parts, with line breaks and quotes in a field, and some rows with a field too many."""
    k = F.col("o_orderkey")
    quoted = F.concat(F.lit('"a ""quoted""\n'), F.col("o_orderpriority"), F.lit(',\nb"'))
    fields = [
        k.cast("string"), F.lit("court01"), F.lit(""), F.when(k % 9 == 0, "cr").otherwise("cv"), F.lit("1"),
        F.when(k % 11 == 0, "x").otherwise(F.lpad((k % 10_000_000).cast("string"), 7, "0")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(""), quoted,
    ]
    head = "id,court_id,blocked,federal_dn_case_type,federal_dn_office_code,docket_number_core,date_filed,date_terminated,note"
    line = F.concat_ws(",", *fields, F.when(k % 40 == 0, "more"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), line.alias("value"))
    path = new_path(spark, "dockets")
    write_parts(rows, "k", head, path, "bzip2")
    read = archives.read_csv(spark, path, head.split(",")[:-1], parts=True)
    good = read.where("_structural IS NULL")
    out = ingest.normalise_dockets(good, ["court01"], "1994-01-01", "2000-12-31", keep=["source_row_number", "note"])
    out = out.select("source_row_number", F.col("reject_reason").alias("reason"), "recap_docket_id", "filed_date", F.length("note").cast("long").alias("note_length"))
    return out.unionByName(read.where("_structural IS NOT NULL").select("source_row_number", F.col("_structural").alias("reason")), allowMissingColumns=True)


def _zip_years(path: str, header: str):
    """Writes each year's rows, which come together and in order, as one archive with one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = arrow_files(path)
        year, lines = None, io.StringIO()

        def close() -> pa.RecordBatch:
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{year}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"extract-{year}.txt", lines.getvalue())
            lines.seek(0)
            lines.truncate()
            return pa.RecordBatch.from_arrays([pa.array([year], pa.int32())], names=["year"])

        for batch in batches:
            for y, value in zip(batch.column("year").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if y != year:
                    if year is not None:
                        yield close()
                    year = y
                    lines.write(header + "\n")
                lines.write(value + "\n")
        if year is not None:
            yield close()

    return run


@query(
    "archive_rows",
    """WITH r AS (SELECT *, year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT y || '.zip' AS archive, 'extract-' || y || '.txt' AS member, n::BIGINT AS source_row_number, CASE WHEN o_orderkey % 31 = 0 THEN 'field_count' END AS reason,
  o_orderkey::VARCHAR AS orderkey FROM r""",
    base=False,
)
def archive_rows(spark, d):
    """A ZIP archive for each year, written by tasks; all archives read in parallel, a task a member."""
    k = F.col("o_orderkey")
    line = F.concat_ws("\t", k.cast("string"), F.col("o_orderstatus"), F.when(k % 31 == 0, "more"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").alias("year"), k.alias("k"), line.alias("value"))
    path = new_path(spark, "archives")
    rows.repartition("year").sortWithinPartitions("year", "k").mapInArrow(_zip_years(path, "ORDERKEY\tSTATUS"), "year int").write.format("noop").mode("overwrite").save()
    read = archives.tsv_fields(archives.zip_lines(spark, path), ["ORDERKEY", "STATUS"], ["ORDERKEY"])
    return read.select("archive", "member", "source_row_number", F.col("_structural").alias("reason"), F.col("ORDERKEY").alias("orderkey"))


@query(
    "schema_drift",
    """WITH kinds(name, agreed, found) AS (
  SELECT 'key', 'int', CASE WHEN max(o_orderkey) > 2147483647 THEN 'bigint' ELSE 'int' END FROM orders
  UNION ALL SELECT 'price', 'int', CASE WHEN count(*) FILTER (o_totalprice <> floor(o_totalprice)) > 0 THEN 'double' ELSE 'int' END FROM orders
  UNION ALL SELECT 'filed', 'date', CASE WHEN count(*) FILTER (o_orderkey % 1000 = 7) > 0 THEN 'string' ELSE 'date' END FROM orders
  UNION ALL SELECT 'status', NULL, 'string' UNION ALL SELECT 'clerk', 'string', NULL)
SELECT name AS "column", CASE WHEN agreed IS NULL THEN 'added' WHEN found IS NULL THEN 'lost' ELSE 'widened' END AS change, agreed, found
FROM kinds WHERE agreed IS DISTINCT FROM found""",
    base=False,
)
def schema_drift(spark, d):
    """A CSV extract of the orders whose types are inferred from every row, against what was agreed."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    filed = F.when(F.col("o_orderkey") % 1000 == 7, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = new_path(spark, "drift")
    o.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), filed.alias("filed"), F.col("o_orderstatus").alias("status")).write.option("header", True).csv(path)
    return drift.drift(spark, drift.inferred(spark, path, "csv"), "key int, price int, filed date, clerk string")


# Written marts


@query(
    "mart_footers",
    """SELECT year(filed_month)::INTEGER AS filing_year, count(*)::BIGINT AS rows, min(district_code) AS first_district, max(district_code) AS last_district,
  (count(*) FILTER (terminated_month IS NULL))::BIGINT AS open_records FROM public GROUP BY 1""",
)
def mart_footers(spark, d):
    """From the footers of the served mart's files alone: rows, ends of the district codes and nulls by filing year."""
    core._mart(spark, d)
    foot = storage.footers(spark, fx.mart_path(spark, d)).withColumn("filing_year", F.regexp_extract("file", r"filing_year=(\d+)", 1).cast("int"))
    own = lambda c, x: F.when(F.col("column") == c, F.col(x))
    return foot.groupBy("filing_year").agg(
        F.sum(own("district_code", "row_group_rows")).alias("rows"), F.min(own("district_code", "least")).alias("first_district"),
        F.max(own("district_code", "greatest")).alias("last_district"), F.sum(own("terminated_month", "nulls")).alias("open_records"),
    )


@query(
    "fixed_layout",
    """, n AS (SELECT count(*) AS n FROM public)
SELECT i::BIGINT AS file_number, least(1000, n - 1000 * i)::BIGINT AS rows, true AS same FROM n, range((n + 999) // 1000) AS r(i)""",
)
def fixed_layout(spark, d):
    """The public rows written twice, as the mart's files deal them and dealt by key: each file's rows, and whether both have the same bytes."""
    rows = core._mart(spark, d)
    one = storage.write_fixed(rows, new_path(spark, "fixed"), ["filed_month", "district_code"], 1000, 400)
    two = storage.write_fixed(rows.repartition("release_record_key"), new_path(spark, "fixed"), ["filed_month", "district_code"], 1000, 400)
    two = two.select("file_number", F.col("sha256").alias("_sha"))
    return one.join(two, "file_number").select("file_number", "rows", (F.col("sha256") == F.col("_sha")).alias("same"))


@query(
    "verified_copy",
    "SELECT nature_of_suit_family, count(*)::BIGINT AS records, sum(duration_days)::BIGINT AS days FROM public GROUP BY 1",
)
def verified_copy(spark, d):
    """Counts from a copy of the public rows that was read back and held against its digest of types and values."""
    path = new_path(spark, "copy")
    storage.copy_verified(core._mart(spark, d), path)
    return spark.read.parquet(path).groupBy("nature_of_suit_family").agg(F.count("*").alias("records"), F.sum("duration_days").alias("days"))


_DEEP = explorer.PageSpec(("release_record_key", "district_code", "terminated_month", "duration_days"), sort="terminated_month", descending=True, limit=200, offset=9_000)


@query(
    "deep_page",
    """SELECT release_record_key, district_code, terminated_month, duration_days FROM public
ORDER BY terminated_month DESC NULLS LAST, release_record_key LIMIT 200 OFFSET 9000""",
)
def deep_page(spark, d):
    """A page far down, found by counts of ranges; ranges of over a thousand rows are looked at further."""
    return explorer.deep_page(core._mart(spark, d), _DEEP, sorted_rows=1000)
