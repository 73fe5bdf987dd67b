"""Queries over staging, checks, calibration and the served mart, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators import calibration, cube, matching, metrics, planning, profiles, publish, survival, warehouse
from tallyforge.plans import fixtures as fx
from tallyforge.plans import registry as core
from tallyforge.plans.registry import TIMES, query, rounded
from tallyforge.sources import ingest
from tallyforge.sources.shared import new_path, write_parts

# Staging

HEADER = ["CIRCUIT", "DISTRICT", "OFFICE", "DOCKET", "ORIGIN", "FILEDATE", "JURIS", "NOS", "TERMDATE", "TDATEUSE", "STATUSCD", "TAPEYEAR"]
_FIELDS = """SELECT o_orderkey, 'c' || (o_custkey % 5) AS circuit, ' ' || lpad((o_custkey % 25)::VARCHAR, 2, '0') || ' ' AS district, (o_custkey % 10)::VARCHAR AS office,
  lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') AS docket, (o_orderkey % 6)::VARCHAR AS origin,
  CASE WHEN o_orderkey % 50 = 0 THEN 'none' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS filedate, (o_custkey % 4 + 1)::VARCHAR AS juris, '350' AS nos,
  CASE WHEN o_orderstatus = 'F' THEN '03/04/1999' ELSE '01/01/1900' END AS termdate, CASE WHEN o_orderstatus = 'F' THEN '04/05/1999' ELSE '' END AS tdateuse,
  CASE WHEN o_orderkey % 61 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'L' ELSE 'S' END AS status, '2099' AS tape FROM orders"""


def _tsv(spark, d):
    """The orders as a tab-separated extract in parts in the order of their keys, each with the header, some rows with a field too many."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ended = F.col("o_orderstatus") == "F"
    fields = [
        F.concat(F.lit("c"), (c % 5).cast("string")), F.concat(F.lit(" "), F.lpad((c % 25).cast("string"), 2, "0"), F.lit(" ")), (c % 10).cast("string"),
        F.lpad((k % 10_000_000).cast("string"), 7, "0"), (k % 6).cast("string"),
        F.when(k % 50 == 0, "none").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")), (c % 4 + 1).cast("string"), F.lit("350"),
        F.when(ended, "03/04/1999").otherwise("01/01/1900"), F.when(ended, "04/05/1999").otherwise(""),
        F.when(k % 61 == 0, "").when(ended, "L").otherwise("S"), F.lit("2099"),
    ]
    line = F.concat_ws("\t", *fields)
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), F.when(k % 97 == 0, F.concat(line, F.lit("\tmore"))).otherwise(line).alias("value"))
    path = new_path(spark, "extract")
    write_parts(rows, "k", "\t".join(HEADER), path)
    return path


def _extract(spark, d):
    return ingest.read_tsv(spark, _tsv(spark, d), HEADER, HEADER, parts=True)


_STAGED = f"""WITH f AS ({_FIELDS}), numbered AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM f),
parsed AS (SELECT *, try_strptime(filedate, '%m/%d/%Y')::DATE AS filed FROM numbered),
judged AS (
  SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'field_count' WHEN filed < DATE '1996-01-01' THEN 'before_product_start' WHEN filed IS NULL THEN 'invalid_filed_date'
    WHEN filed > DATE '2000-12-31' THEN 'filed_after_snapshot'
    WHEN NOT (status = 'L' OR (status = 'S' AND termdate = '01/01/1900' AND tdateuse = '')) THEN 'invalid_status_sentinel' END AS reason FROM parsed)"""


@query(
    "staged_records",
    _STAGED
    + """ SELECT 'd1:' || r AS source_record_identifier, r::BIGINT AS source_row_number, circuit AS circuit_code, trim(district) AS district_code, office AS office_code,
  docket AS docket_number, origin AS origin_code, juris AS jurisdiction_code, nos AS nature_of_suit_raw, termdate AS termination_date_raw, status AS status_code,
  tape AS statistical_year, filed AS filed_date, try_strptime(termdate, '%m/%d/%Y')::DATE AS termination_date_source,
  try_strptime(tdateuse, '%m/%d/%Y')::DATE AS termination_date_used_by_ao, DATE '2000-12-31' AS source_snapshot_cutoff, 'd1' AS source_digest,
  1::BIGINT AS raw_contract_version, year(filed)::BIGINT AS filing_year FROM judged WHERE reason IS NULL""",
    base=False,
)
def staged_records(spark, d):
    """A written extract, read, judged and staged: typed columns with provenance and the identity digest:row."""
    rows = ingest.triage(_extract(spark, d), "1996-01-01", "2000-12-31")
    return ingest.stage_records(rows.where("outcome = 'accepted'"), "d1", "2000-12-31")


@query(
    "quarantine",
    _STAGED + " SELECT r::BIGINT AS source_row_number, reason FROM judged WHERE reason IS NOT NULL AND reason <> 'before_product_start'",
    base=False,
)
def quarantine(spark, d):
    rows = ingest.triage(_extract(spark, d), "1996-01-01", "2000-12-31")
    return rows.where("outcome = 'rejected'").select("source_row_number", "reason")


@query(
    "merged_records",
    """SELECT source_record_identifier, source_digest, amount FROM (
  SELECT o_orderkey::VARCHAR AS source_record_identifier, 'b' AS source_digest, o_totalprice + 1 AS amount FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey::VARCHAR, 'a', o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)""",
    base=False,
)
def merged_records(spark, d):
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    made = lambda digest, amount: o.select(k.cast("string").alias("source_record_identifier"), F.lit(digest).alias("source_digest"), amount.alias("amount"), k.alias("k"))
    old, new = made("a", F.col("o_totalprice")), made("b", F.col("o_totalprice") + 1)
    incoming = new.where("k % 3 = 0").unionByName(old.where("k % 5 = 0"))
    return warehouse.merge_new(old.where("k % 2 = 0").drop("k"), incoming.drop("k"))


# Checks


@query(
    "source_assertions",
    core._POPULATION
    + """, ao_long AS (UNPIVOT ao ON pending INTO NAME measure VALUE v),
cases_n AS (SELECT count(*) AS n FROM facts WHERE source_record_count = 1), exceptions_n AS (SELECT count(*) AS n FROM facts WHERE source_record_count > 1)
SELECT 'staging_source_reconciliation' AS assertion, (SELECT count(*) FROM orders WHERE o_orderkey % 40 = 0)::BIGINT AS failures
UNION ALL SELECT 'case_exception_partition', (SELECT count(*) FROM facts WHERE source_record_count > 1 AND district_code = '03')::BIGINT
UNION ALL SELECT 'district_count', abs((SELECT count(*) FROM nation) - 94)::BIGINT
UNION ALL SELECT 'required_tie_out_passes', (SELECT count(*) FROM (
  SELECT o.filed AS x, a.filed AS y FROM own o JOIN ao a USING (district_code) WHERE district_code = 'TOTAL'
  UNION ALL SELECT o.terminated, a.terminated FROM own o JOIN ao a USING (district_code) WHERE district_code = 'TOTAL'
  UNION ALL SELECT o.pending, a.pending FROM own o JOIN ao a USING (district_code) WHERE district_code = 'TOTAL')
  WHERE NOT coalesce(abs(x - y)::DOUBLE / nullif(y, 0) <= 0.005, false))::BIGINT
UNION ALL SELECT 'scope_bridge', (SELECT count(*) FROM (
  SELECT (SELECT filed FROM own WHERE district_code = 'TOTAL') - (SELECT count(*) FROM facts WHERE filed_date >= DATE '1996-01-01' AND filed_date BETWEEN DATE '{a}' AND DATE '{b}') AS x, 0 AS e
  UNION ALL SELECT (SELECT terminated FROM own WHERE district_code = 'TOTAL') - (SELECT count(*) FROM facts WHERE filed_date >= DATE '1996-01-01' AND terminated_date BETWEEN DATE '{a}' AND DATE '{b}'), 61
  UNION ALL SELECT (SELECT pending FROM own WHERE district_code = 'TOTAL') - (SELECT count(*) FROM facts WHERE filed_date >= DATE '1996-01-01' AND NOT event_observed), 4896)
  WHERE x <> e)::BIGINT""".replace("{a}", fx.WINDOW[0]).replace("{b}", fx.WINDOW[1]),
)
def source_assertions(spark, d):
    """With rows left out of staging and of the exceptions on purpose, and the test tables' own districts."""
    facts = fx.facts(spark, d)
    source = spark.read.parquet(f"{d}/orders.parquet")
    own = core._population(spark, d)
    bridge = matching.scope_bridge(facts.where("filed_date >= DATE '1996-01-01'"), own, *fx.WINDOW)
    exceptions = warehouse.identity_exceptions(facts).where("district_code <> '03'")
    return profiles.source_assertions(
        source, source.where("o_orderkey % 40 <> 0"), facts, warehouse.cases(facts), exceptions, fx.districts(spark, d),
        matching.tie_out(core._independent(own), own), bridge,
    ).withColumn("failures", F.col("failures").cast("long"))


@query(
    "orphans",
    "SELECT count(*)::BIGINT AS failures FROM facts WHERE nature_of_suit_raw NOT IN (SELECT raw_code FROM book WHERE raw_code <> '210')",
)
def orphans(spark, d):
    from tallyforge.functions.codebook import codebook

    return profiles.orphans(fx.facts(spark, d), "nature_of_suit_raw", codebook(spark).where("raw_code <> '210'"), "raw_code")


@query(
    "freshness",
    """SELECT max(o_orderdate)::TIMESTAMP AS completed_at_utc, date_diff('day', max(o_orderdate)::DATE, DATE '1999-01-15')::BIGINT AS age_days,
  CASE WHEN date_diff('day', max(o_orderdate)::DATE, DATE '1999-01-15') <= 150 THEN 'pass' WHEN date_diff('day', max(o_orderdate)::DATE, DATE '1999-01-15') <= 365 THEN 'warn'
  ELSE 'error' END AS status FROM orders""",
    base=False,
)
def freshness(spark, d):
    runs = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("completed_at_utc"))
    return ingest.freshness(runs, "1999-01-15").withColumn("completed_at_utc", F.col("completed_at_utc").cast("timestamp_ntz"))


@query(
    "physical_audit",
    """SELECT count(*)::BIGINT AS rows, count(DISTINCT release_record_key)::BIGINT AS keys, count(*) FILTER (pending_status)::BIGINT AS pending_records,
  count(*) FILTER (identity_quality_status = 'collision')::BIGINT AS collision_records, min(year(filed_month))::BIGINT AS first_year, max(year(filed_month))::BIGINT AS last_year FROM public""",
)
def physical_audit(spark, d):
    return publish.physical_audit(core._mart(spark, d))


# Cube and metrics


@query("cube_from_public", core.ORACLE["cube_filing"].removeprefix(fx.BASE_SQL))
def cube_from_public(spark, d):
    """The filing cube made again from public rows; it must equal the one made from facts."""
    return cube.cube_filing(cube.marts_from_public(core._mart(spark, d))[1], fx.SUPPORT)


_AGES = core.ORACLE["cube_pending_age"].removeprefix(fx.BASE_SQL)


@query(
    "published_pending_age",
    f""", ages AS ({_AGES})
SELECT district_code, nature_family, sum(pending_records)::BIGINT AS pending_records, sum(matched_pending_records)::BIGINT AS matched_pending_records,
  round(sum(average_age_days * pending_records) / greatest(1, sum(pending_records)), 4) AS weighted_age_days,
  max(pending_records) FILTER (age_band = '5_years_or_more')::BIGINT AS oldest_band_records FROM ages GROUP BY ALL""",
)
def published_pending_age(spark, d):
    return rounded(cube.published_pending_age(core.cube_pending_age(spark, d)), 4)


@query(
    "cell_order",
    f""", ages AS ({_AGES})
SELECT district_code, nature_family, age_band, row_number() OVER (ORDER BY district_code NULLS FIRST, nature_family NULLS FIRST,
  CASE age_band WHEN 'under_1_year' THEN 1 WHEN '1_to_2_years' THEN 2 WHEN '2_to_5_years' THEN 3 WHEN '5_years_or_more' THEN 4 END NULLS FIRST)::BIGINT AS place FROM ages""",
)
def cell_order(spark, d):
    """Each published cell's place in publication order; the cube has few cells, so one task may number them."""
    cells = core.cube_pending_age(spark, d)
    place = F.row_number().over(W.orderBy(*cube.publication_order(cells))).cast("long")
    return cells.select("district_code", "nature_family", "age_band", place.alias("place"))


@query(
    "family_totals",
    f""", cells AS (SELECT nature_family, sum(total_records)::BIGINT AS total_records FROM portfolio GROUP BY 1 HAVING sum(total_records) >= {fx.SUPPORT})
SELECT nature_family, total_records, total_records::DOUBLE / (SELECT sum(total_records) FROM cells)::DOUBLE AS share FROM cells""",
)
def family_totals(spark, d):
    return cube.family_totals(core.cube_portfolio(spark, d))


@query(
    "district_benchmark",
    """SELECT nature_of_suit_family, count(*)::BIGINT AS statistical_records, count(*) FILTER (pending_status)::BIGINT AS pending_records,
  round(avg(duration_days), 9) AS mean_duration_days FROM public WHERE district_code = '07' GROUP BY GROUPING SETS ((nature_of_suit_family), ())""",
)
def district_benchmark(spark, d):
    return rounded(profiles.district_benchmark(core._mart(spark, d), "07"))


_GROUPINGS = [[], ["district_code"], ["nature_of_suit_family"], ["district_code", "nature_of_suit_family"]]


def _reconciled(grouping: list[str]) -> str:
    of = "district_code" if "district_code" in grouping else "NULL"
    groups = f"SELECT {of} AS d FROM public {('GROUP BY ' + ', '.join(grouping)) if grouping else ''} HAVING count(*) >= {fx.SUPPORT}"
    worst = "CASE WHEN count(*) FILTER (d = '05') > 0 THEN 7.0 ELSE 0.0 END" if grouping == ["district_code"] else "0.0"
    return f"""SELECT '{",".join(grouping)}' AS grouping, count(*)::BIGINT AS slices, (count(*) FILTER (d = '04'))::BIGINT AS missing_slices,
  (count(*) FILTER (d IN ('03', '04')))::BIGINT AS extra_slices, ((count(*) - count(*) FILTER (d IN ('03', '04'))) * 4)::BIGINT AS comparisons,
  ({worst})::DOUBLE AS max_abs_difference FROM ({groups})"""


@query("semantic_reconciliation", " UNION ALL ".join(map(_reconciled, _GROUPINGS)).join([" ", ""]))
def semantic_reconciliation(spark, d):
    """Answers of the registry against the portfolio cube, slice by slice, with faults planted in the cube.

    District 03 is left out of it, 04 has another name, and a total of 05 is wrong by 7.
    """
    own, family = F.col("district_code"), F.col("nature_of_suit_family")
    cells = core.cube_portfolio(spark, d).withColumnRenamed("nature_family", "nature_of_suit_family").where(own.isNull() | (own != "03"))
    cells = cells.withColumn("total_records", F.col("total_records") + F.when((own == "05") & family.isNull(), 7).otherwise(0))
    cells = cells.withColumn("district_code", F.when(own == "04", "x4").otherwise(own))
    names = ["total_records", "pending_records", "matched_records", "pending_share"]
    return metrics.reconcile(metrics.standard_registry(fx.SUPPORT), core._mart(spark, d), "portfolio", _GROUPINGS, names, cells)


@query("nearest_rank", "SELECT quantile_disc(duration_days, 0.95)::BIGINT AS p FROM facts")
def nearest_rank(spark, d):
    return planning.nearest_rank(fx.facts(spark, d), "duration_days").withColumn("p", F.col("p").cast("long"))


# Calibration

_SCORED, _Y = core._SCORED, core._Y


@query(
    "overall_calibration",
    _SCORED + " SELECT count(*) FILTER (route <> 'abstain')::BIGINT AS supported_cases, count(*) FILTER (route = 'abstain')::BIGINT AS abstained_cases, "
    + ", ".join(f"round(abs(avg({_Y[t]} - p_{t}) FILTER (route <> 'abstain')), 9) AS abs_error_{t}" for t in TIMES) + " FROM scored",
)
def overall_calibration(spark, d):
    return rounded(calibration.overall_calibration(core._scored(spark, d), TIMES))


@query(
    "worst_slices",
    core.ORACLE["slice_calibration"].removeprefix(fx.BASE_SQL) + " ORDER BY max_abs_error DESC, dimension, value LIMIT 20",
)
def worst_slices(spark, d):
    return calibration.worst_slices(core.slice_calibration(spark, d))


@query(
    "logit_affine",
    _SCORED + """ SELECT source_record_identifier, round(1 / (1 + exp(-(0.25 + exp(-0.5::DOUBLE) * ln(q / (1 - q))))), 9) AS p
FROM (SELECT source_record_identifier, greatest(least(p_365, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS q FROM scored WHERE p_365 IS NOT NULL)""",
)
def logit_affine(spark, d):
    rows = core._scored(spark, d).where("p_365 IS NOT NULL")
    return rounded(rows.select("source_record_identifier", calibration.logit_affine(F.col("p_365"), 0.25, -0.5).alias("p")))


@query(
    "aft_probability",
    """, z AS (SELECT source_record_identifier, (ln(365.0::DOUBLE) - (0.1 + 0.9 * ln(greatest(duration_days, 1)::DOUBLE))) / 1.3 AS z FROM facts),
e AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z),
tail AS (SELECT *, ((((1.061405429::DOUBLE * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x) / 2 AS q FROM e)
SELECT source_record_identifier, round(CASE WHEN z < 0 THEN q ELSE 1 - q END, 9) AS p FROM tail""",
)
def aft_probability(spark, d):
    """Of a location that stands in for a model's: the logarithm of the case's own duration."""
    location = F.log(F.greatest(F.col("duration_days"), F.lit(1)).cast("double"))
    return rounded(fx.facts(spark, d).select("source_record_identifier", calibration.aft_probability(location, 365, 0.1, 0.9, 1.3).alias("p")))


_CODED = ", ".join(f"'{k}'" for k in ("district_code", "origin_code"))


@query(
    "category_encoding",
    """, t AS (SELECT * FROM cases WHERE filed_date < DATE '1996-01-01' AND district_code < '20'),
d AS (SELECT district_code AS v, row_number() OVER (ORDER BY district_code) - 1 AS k FROM (SELECT DISTINCT district_code FROM t)),
o AS (SELECT origin_code AS v, row_number() OVER (ORDER BY origin_code) - 1 AS k FROM (SELECT DISTINCT origin_code FROM t))
SELECT district_code, origin_code, d.k::BIGINT AS district_code_code, o.k::BIGINT AS origin_code_code, count(*)::BIGINT AS cases
FROM cases c LEFT JOIN d ON c.district_code = d.v LEFT JOIN o ON c.origin_code = o.v GROUP BY ALL""",
)
def category_encoding(spark, d):
    rows = fx.cases(fx.facts(spark, d))
    columns = ["district_code", "origin_code"]
    codes = calibration.category_codes(rows.where("filed_date < DATE '1996-01-01' AND district_code < '20'"), columns)
    out = calibration.encode_categories(rows.select(*columns), codes, columns)
    return out.groupBy(*columns, *[f"{c}_code" for c in columns]).agg(F.count("*").alias("cases"))


@query(
    "monthly_maximum",
    core.ORACLE["monthly_calibration"].removeprefix(fx.BASE_SQL).replace(" SELECT filed_month", ", months AS (SELECT filed_month")
    + ") SELECT count(*)::BIGINT AS months, coalesce(max(abs_error), 'inf'::DOUBLE) AS max_abs_error FROM months",
)
def monthly_maximum(spark, d):
    return calibration.monthly_maximum(core.monthly_calibration(spark, d))


@query(
    "route_summary",
    core.ORACLE["support_routes"].removeprefix(fx.BASE_SQL).replace("SELECT district_code, nature_family, jurisdiction_code, origin_code, n, CASE", ", routes AS (SELECT district_code, nature_family, jurisdiction_code, origin_code, CASE")
    + """) SELECT route, count(*)::BIGINT AS cases, count(*) FILTER (event_observed AND duration_days <= 365)::BIGINT AS resolved,
  count(*) FILTER (event_observed AND duration_days <= 365)::DOUBLE / count(*) AS rate FROM cases JOIN routes USING (district_code, nature_family, jurisdiction_code, origin_code) GROUP BY 1""",
)
def route_summary(spark, d):
    return survival.route_summary(fx.cases(fx.facts(spark, d)), fx.ROUTE_SUPPORT)
