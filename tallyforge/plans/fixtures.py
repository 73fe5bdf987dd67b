"""The test tables as administrative records: one record for each order. Each relation has its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.codebook import FAMILIES
from tallyforge.operators import publish, warehouse
from tallyforge.sources.shared import files_under, new_path

CUTOFF = "2001-12-31"
WINDOW = ("2000-08-01", "2001-07-31")
#: Thresholds that fit the smaller tables; the operators' defaults are the reference thresholds.
SUPPORT, ROUTE_SUPPORT = 120, 15


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chosen(column, pairs: dict, other: str):
    out = None
    for k, v in pairs.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(other)


ORIGINS = {"1": "1", "2": "2", "3": "6", "4": "13"}
CODES = {"AUTOMOBILE": "350", "BUILDING": "210", "FURNITURE": "864", "HOUSEHOLD": "440"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last_ship"))
    rows = (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    filed = F.col("o_orderdate").cast("date")
    return rows.select(
        F.concat(F.lit("synthetic:"), F.col("o_orderkey").cast("string")).alias("source_record_identifier"),
        "o_orderkey",
        F.col("n_regionkey").cast("string").alias("circuit_code"),
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("district_code"),
        (F.col("c_custkey") % 10).cast("string").alias("office_code"),
        F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.date_format(filed, "yyyyMM")).alias("docket_number"),
        _chosen(F.left("o_orderpriority", F.lit(1)), ORIGINS, "4").alias("origin_code"),
        (F.col("c_custkey") % 4 + 1).cast("string").alias("jurisdiction_code"),
        _chosen(F.col("c_mktsegment"), CODES, "999").alias("nature_of_suit_raw"),
        filed.alias("filed_date"),
        ((F.col("o_orderstatus") != "O") & F.coalesce(F.col("last_ship") >= filed, F.lit(False))).alias("event_observed"),
        F.col("last_ship").alias("terminated_source"),
        F.lit(CUTOFF).cast("date").alias("source_snapshot_cutoff"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.statistical_records(records(spark, sf_dir))


def order_key():
    return F.substring_index("source_record_identifier", ":", -1).cast("long")


def promoted(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.where((F.col("source_record_count") == 1) & (order_key() % 5 < 2)).select("source_record_identifier")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return _table(spark, sf_dir, "nation").select(code.alias("district_code"), F.concat(F.lit("court"), code).alias("court_id"))


def dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).where(F.col("o_orderkey") % 3 != 0)
    again = rows.where(F.col("o_orderkey") % 97 == 0).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    rows = rows.unionByName(again)
    key = F.col("o_orderkey")
    ended = F.when(F.col("event_observed"), F.col("terminated_source"))
    return rows.select(
        key.cast("string").alias("recap_docket_id"),
        F.concat(F.lit("court"), F.col("district_code")).alias("court_id"),
        "office_code",
        "docket_number",
        "filed_date",
        F.when(key % 50 == 1, F.date_add(ended, 1)).when(key % 7 == 0, F.lit(None)).otherwise(ended).alias("terminated_date"),
    )


def cases(fact_rows: DataFrame) -> DataFrame:
    """Collision-free records with the family that routing uses."""
    return fact_rows.where("source_record_count = 1").withColumn(
        "nature_family", F.coalesce("nature_of_suit_family", F.lit("unsupported"))
    )


_marts: dict[tuple, str] = {}


def _mart_key(spark: SparkSession, sf_dir: str) -> tuple:
    files = [f for t in ("lineitem", "orders", "customer", "nation") for f in files_under(spark, f"{sf_dir}/{t}.parquet")]
    return (spark.sparkContext.applicationId, tuple(files))


def mart_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the public mart of a source lies, once it was written."""
    return _marts[_mart_key(spark, sf_dir)]


def written_mart(spark: SparkSession, sf_dir: str, made: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The public mart of a source, written by filing year and sorted by district at its first use in a session.

    It is written again where the source's files or their sizes have changed.
    """
    key = _mart_key(spark, sf_dir)
    if key not in _marts:
        path = new_path(spark, "mart")
        publish.write_public(made(spark, sf_dir), path)
        _marts[key] = path
    return spark.read.parquet(_marts[key]).select(*publish.PUBLIC_COLUMNS)


_BOOK = ", ".join(f"('{c}', '{f}')" for f, codes in FAMILIES.items() for c in codes)

#: The same relations in SQL, to be put before a query.
BASE_SQL = f"""
WITH RECURSIVE ship AS (SELECT l_orderkey, max(l_shipdate)::DATE AS last_ship FROM lineitem GROUP BY 1),
raw AS (
  SELECT 'synthetic:' || o_orderkey AS source_record_identifier, o_orderkey, n_regionkey::VARCHAR AS circuit_code,
    lpad(n_nationkey::VARCHAR, 2, '0') AS district_code, (c_custkey % 10)::VARCHAR AS office_code,
    c_custkey || '-' || strftime(o_orderdate, '%Y%m') AS docket_number,
    CASE left(o_orderpriority, 1) WHEN '1' THEN '1' WHEN '2' THEN '2' WHEN '3' THEN '6' WHEN '4' THEN '13' ELSE '4' END AS origin_code,
    (c_custkey % 4 + 1)::VARCHAR AS jurisdiction_code,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '350' WHEN 'BUILDING' THEN '210' WHEN 'FURNITURE' THEN '864'
      WHEN 'HOUSEHOLD' THEN '440' ELSE '999' END AS nature_of_suit_raw,
    o_orderdate::DATE AS filed_date,
    o_orderstatus <> 'O' AND coalesce(last_ship >= o_orderdate::DATE, false) AS event_observed,
    last_ship AS terminated_source, DATE '{CUTOFF}' AS source_snapshot_cutoff
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN ship ON o_orderkey = l_orderkey),
book(raw_code, family) AS (VALUES {_BOOK}),
semantic AS (
  SELECT *, circuit_code || '|' || district_code || '|' || office_code || '|' || docket_number AS natural_case_identifier,
    CASE WHEN event_observed THEN terminated_source END AS terminated_date,
    CASE WHEN NOT event_observed THEN source_snapshot_cutoff END AS censoring_date,
    CASE WHEN event_observed THEN terminated_source ELSE source_snapshot_cutoff END AS analysis_end_date
  FROM raw),
facts AS (
  SELECT s.*, date_diff('day', filed_date, analysis_end_date)::BIGINT AS duration_days, k.n AS source_record_count,
    CASE WHEN k.n = 1 THEN 'canonical' ELSE 'collision' END AS identity_quality_status,
    raw_code AS nature_of_suit_code, family AS nature_of_suit_family, coalesce(family, 'unsupported') AS nature_family,
    CASE WHEN raw_code IS NULL THEN 'unsupported' ELSE 'supported' END AS nature_of_suit_mapping_status,
    CASE WHEN origin_code IN ('6', '13') THEN 'multidistrict_litigation' WHEN family = 'social_security' THEN 'social_security_review'
      WHEN origin_code = '1' THEN 'ordinary_original' ELSE 'other_procedural_origin' END AS intake_procedural_cohort
  FROM semantic s JOIN (SELECT natural_case_identifier, count(*) AS n FROM semantic GROUP BY 1) k USING (natural_case_identifier)
  LEFT JOIN book ON nature_of_suit_raw = raw_code),
promoted AS (SELECT source_record_identifier FROM facts WHERE source_record_count = 1 AND o_orderkey % 5 < 2),
joined AS (SELECT f.*, p.source_record_identifier IS NOT NULL AS matched FROM facts f LEFT JOIN promoted p USING (source_record_identifier)),
cases AS (SELECT natural_case_identifier AS case_identifier, * FROM joined WHERE source_record_count = 1),
docket_rows AS (
  SELECT * FROM raw WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey) FROM raw WHERE o_orderkey % 3 <> 0 AND o_orderkey % 97 = 0),
dockets AS (
  SELECT o_orderkey::VARCHAR AS recap_docket_id, 'court' || district_code AS court_id, office_code, docket_number, filed_date,
    CASE WHEN o_orderkey % 50 = 1 THEN (CASE WHEN event_observed THEN terminated_source END) + 1
      WHEN o_orderkey % 7 = 0 THEN NULL WHEN event_observed THEN terminated_source END AS recap_terminated_date
  FROM docket_rows),
pairs AS (
  SELECT case_identifier, source_record_identifier, recap_docket_id, district_code, court_id, c.office_code,
    c.docket_number AS docket_number_core, c.filed_date, terminated_date AS fjc_terminated_date, recap_terminated_date
  FROM cases c JOIN dockets d ON 'court' || c.district_code = d.court_id AND c.office_code = d.office_code
    AND c.docket_number = d.docket_number AND c.filed_date = d.filed_date),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY case_identifier) AS recap_candidates_for_fjc,
    count(*) OVER (PARTITION BY recap_docket_id) AS fjc_candidates_for_recap FROM pairs),
candidates AS (
  SELECT *, CASE WHEN recap_candidates_for_fjc > 1 OR fjc_candidates_for_recap > 1 THEN 'collision'
    WHEN fjc_terminated_date <> recap_terminated_date THEN 'evidence_conflict' ELSE 'review_eligible' END AS candidate_status
  FROM counted),
portfolio AS (
  SELECT district_code, nature_family, count(*)::BIGINT AS total_records,
    count(*) FILTER (identity_quality_status = 'canonical')::BIGINT AS collision_free_records,
    count(*) FILTER (NOT event_observed)::BIGINT AS pending_records, count(*) FILTER (event_observed)::BIGINT AS terminated_records,
    count(*) FILTER (matched)::BIGINT AS matched_records,
    count(*) FILTER (nature_of_suit_mapping_status = 'supported')::BIGINT AS supported_nature_records,
    max(source_snapshot_cutoff) AS as_of_date FROM joined GROUP BY ALL),
filing AS (
  SELECT year(filed_date)::BIGINT AS filing_year, district_code, nature_family, count(*)::BIGINT AS cohort_records,
    count(*) FILTER (event_observed)::BIGINT AS observed_terminations, count(*) FILTER (NOT event_observed)::BIGINT AS pending_records,
    count(*) FILTER (matched)::BIGINT AS matched_records, sum(duration_days)::BIGINT AS followup_days,
    max(source_snapshot_cutoff) AS as_of_date FROM joined GROUP BY ALL),
banded AS (
  SELECT *, CASE WHEN duration_days < 365 THEN 'under_1_year' WHEN duration_days < 730 THEN '1_to_2_years'
    WHEN duration_days < 1825 THEN '2_to_5_years' ELSE '5_years_or_more' END AS age_band FROM joined),
inventory AS (
  SELECT district_code, nature_family, age_band, count(*)::BIGINT AS pending_records,
    count(*) FILTER (matched)::BIGINT AS matched_pending_records, avg(duration_days) AS average_age_days,
    sum(duration_days)::BIGINT AS age_days, max(source_snapshot_cutoff) AS as_of_date
  FROM banded WHERE NOT event_observed GROUP BY ALL),
durations AS (
  SELECT district_code, nature_family, jurisdiction_code, origin_code, intake_procedural_cohort, count(*)::BIGINT AS support_count,
    count(*) FILTER (event_observed)::BIGINT AS observed_terminations, count(*) FILTER (NOT event_observed)::BIGINT AS censored_records,
    avg(duration_days) AS average_followup_days, avg(duration_days) FILTER (event_observed) AS average_observed_duration_days,
    max(source_snapshot_cutoff) AS as_of_date FROM joined GROUP BY ALL),
public AS (
  SELECT left(sha256(source_record_identifier), 22) AS release_record_key, circuit_code, district_code,
    date_trunc('month', filed_date)::DATE AS filed_month, date_trunc('month', terminated_date)::DATE AS terminated_month,
    NOT event_observed AS pending_status, event_observed, duration_days::INTEGER AS duration_days, nature_of_suit_code,
    nature_family AS nature_of_suit_family, nature_of_suit_mapping_status, jurisdiction_code, origin_code,
    intake_procedural_cohort AS procedural_cohort, identity_quality_status, source_record_count::INTEGER AS source_record_count,
    matched AS recap_match_available, source_snapshot_cutoff, 'v1' AS dataset_version FROM joined)
"""
