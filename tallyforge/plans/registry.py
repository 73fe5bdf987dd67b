"""All queries of the library and their SQL twins.

A query takes (spark, sf_dir). Double results are rounded on both sides where a
sum's order could show in the last digits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.codebook import CODES, codebook
from tallyforge.operators import calibration, cube, explorer, marts, matching, metrics, planning, profiles, publish, survival, warehouse
from tallyforge.plans import fixtures as fx
from tallyforge.sources import ingest
from tallyforge.sources.shared import written

QUERIES: dict = {}
ORACLE: dict = {}
TIMES = [180, 365, 730, 1095]


def query(name: str, sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = fx.BASE_SQL + sql if base else sql
        return f

    return add


def rounded(df, digits: int = 9):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Warehouse


@query(
    "record_semantics",
    """SELECT source_record_identifier, natural_case_identifier, event_observed, terminated_date, censoring_date,
    analysis_end_date, date_diff('day', filed_date, analysis_end_date)::BIGINT AS duration_days FROM semantic""",
)
def record_semantics(spark, d):
    return warehouse.record_semantics(fx.records(spark, d)).select(
        "source_record_identifier", "natural_case_identifier", "event_observed", "terminated_date", "censoring_date", "analysis_end_date", "duration_days"
    )


@query(
    "identity_quality",
    """SELECT identity_quality_status, source_record_count, count(*)::BIGINT AS records,
    count(DISTINCT natural_case_identifier)::BIGINT AS keys FROM facts GROUP BY ALL""",
)
def identity_quality(spark, d):
    rows = warehouse.identity_quality(warehouse.record_semantics(fx.records(spark, d)))
    return rows.groupBy("identity_quality_status", "source_record_count").agg(
        F.count("*").alias("records"), F.countDistinct("natural_case_identifier").alias("keys")
    )


_FACT = """source_record_identifier, natural_case_identifier, circuit_code, district_code, office_code, docket_number, filed_date,
    terminated_date, censoring_date, analysis_end_date, duration_days, event_observed, nature_of_suit_raw, nature_of_suit_code,
    nature_of_suit_family, nature_of_suit_mapping_status, jurisdiction_code, origin_code, intake_procedural_cohort,
    identity_quality_status, source_record_count, source_snapshot_cutoff"""


@query("statistical_records", f"SELECT {_FACT} FROM facts")
def statistical_records(spark, d):
    return fx.facts(spark, d)


@query("cases", f"SELECT {_FACT.replace('natural_case_identifier', 'natural_case_identifier AS case_identifier')} FROM facts WHERE source_record_count = 1")
def cases(spark, d):
    return warehouse.cases(fx.facts(spark, d))


@query("exceptions", f"SELECT {_FACT} FROM facts WHERE source_record_count > 1")
def exceptions(spark, d):
    return warehouse.identity_exceptions(fx.facts(spark, d))


_BOOK_ROWS = ", ".join("('{}', '{}', '{}')".format(c, label.replace("'", "''"), f) for c, label, f in CODES)


@query(
    "dim_nature_of_suit",
    f"""SELECT raw_code, raw_code AS canonical_code, label, family, DATE '2023-10-25' AS codebook_as_of_date, '1' AS rule_version
FROM (VALUES {_BOOK_ROWS}) AS t(raw_code, label, family)""",
    base=False,
)
def dim_nature_of_suit(spark, d):
    return codebook(spark)


@query(
    "incremental_append",
    "SELECT source_digest, count(*)::BIGINT AS records FROM (SELECT year(filed_date)::VARCHAR AS source_digest FROM raw) WHERE source_digest <= '2000' GROUP BY 1",
)
def incremental_append(spark, d):
    """Snapshots by filing year: those up to 1998 are loaded, those from 1997 to 2000 arrive."""
    rows = fx.records(spark, d).select(F.year("filed_date").cast("string").alias("source_digest"), "o_orderkey")
    out = warehouse.append_new(rows.where("source_digest <= '1998'"), rows.where("source_digest BETWEEN '1997' AND '2000'"))
    return out.groupBy("source_digest").agg(F.count("*").alias("records"))


# Marts


def _facts_and_matches(spark, d):
    """Facts, written once, and the promoted ones among them: neither is made again for each use."""
    facts = written(fx.facts(spark, d), "facts")
    return facts, fx.promoted(facts)


@query(
    "portfolio_summary",
    """SELECT *, matched_records::DOUBLE / total_records AS match_coverage, pending_records::DOUBLE / total_records AS pending_share
    FROM portfolio""",
)
def portfolio_summary(spark, d):
    return marts.portfolio_summary(*_facts_and_matches(spark, d))


@query("filing_cohorts", "SELECT * FROM filing")
def filing_cohorts(spark, d):
    return marts.filing_cohorts(*_facts_and_matches(spark, d))


@query("pending_inventory", "SELECT * EXCLUDE (age_days) REPLACE (round(average_age_days, 9) AS average_age_days) FROM inventory")
def pending_inventory(spark, d):
    return rounded(marts.pending_inventory(*_facts_and_matches(spark, d)))


@query(
    "duration_summary",
    """SELECT * REPLACE (round(average_followup_days, 9) AS average_followup_days,
    round(average_observed_duration_days, 9) AS average_observed_duration_days) FROM durations""",
)
def duration_summary(spark, d):
    return rounded(marts.duration_summary(fx.facts(spark, d)))


@query(
    "data_coverage",
    """, dims AS (
  SELECT 'overall' AS dimension_type, 'all' AS dimension_value, * FROM joined
  UNION ALL SELECT 'district', district_code, * FROM joined UNION ALL SELECT 'filing_year', year(filed_date)::VARCHAR, * FROM joined
  UNION ALL SELECT 'nature_family', nature_family, * FROM joined UNION ALL SELECT 'procedural_cohort', intake_procedural_cohort, * FROM joined)
SELECT dimension_type, dimension_value, count(*)::BIGINT AS total_records,
  count(*) FILTER (identity_quality_status = 'canonical')::BIGINT AS collision_free_records,
  count(*) FILTER (nature_of_suit_mapping_status = 'supported')::BIGINT AS supported_nature_records,
  count(*) FILTER (matched)::BIGINT AS matched_records, count(*) FILTER (matched)::DOUBLE / count(*) AS match_coverage
FROM dims GROUP BY ALL""",
)
def data_coverage(spark, d):
    return marts.data_coverage(*_facts_and_matches(spark, d))


@query(
    "comparable_cases",
    """SELECT case_identifier, source_record_identifier, district_code, filed_date, terminated_date, analysis_end_date, duration_days,
  event_observed, nature_family, jurisdiction_code, origin_code, intake_procedural_cohort, matched AS has_recap_match,
  count(*) OVER (PARTITION BY district_code, nature_family, jurisdiction_code, origin_code)::BIGINT AS comparable_group_support_count,
  source_snapshot_cutoff AS as_of_date FROM cases""",
)
def comparable_cases(spark, d):
    facts, promoted = _facts_and_matches(spark, d)
    return marts.comparable_cases(warehouse.cases(facts), promoted)


@query(
    "totals_summary",
    """SELECT sum(total_records)::BIGINT AS total_records, sum(collision_free_records)::BIGINT AS collision_free_records,
  sum(pending_records)::BIGINT AS pending_records, sum(matched_records)::BIGINT AS matched_records,
  sum(supported_nature_records)::BIGINT AS supported_nature_records, sum(pending_records)::DOUBLE / sum(total_records)::DOUBLE AS pending_share,
  sum(matched_records)::DOUBLE / sum(total_records)::DOUBLE AS match_coverage FROM portfolio""",
)
def totals_summary(spark, d):
    return planning.totals_summary(marts.portfolio_summary(*_facts_and_matches(spark, d)))


# Cube

_SETS = "GROUPING SETS ((district_code, nature_family), (district_code), (nature_family), ())"
_CUBE_DURATION = f"""SELECT district_code, nature_family, sum(support_count)::BIGINT AS duration_support_count,
  sum(observed_terminations)::BIGINT AS observed_terminations, sum(censored_records)::BIGINT AS censored_records,
  round(sum(average_observed_duration_days * observed_terminations) / nullif(sum(observed_terminations), 0), 6) AS average_observed_duration_days
FROM durations GROUP BY {_SETS} HAVING sum(support_count) >= {fx.SUPPORT}"""


@query(
    "cube_portfolio",
    f""", cells AS (
  SELECT district_code, nature_family, sum(total_records)::BIGINT AS total_records, sum(collision_free_records)::BIGINT AS collision_free_records,
    sum(pending_records)::BIGINT AS pending_records, sum(terminated_records)::BIGINT AS terminated_records,
    sum(matched_records)::BIGINT AS matched_records, sum(supported_nature_records)::BIGINT AS supported_nature_records
  FROM portfolio GROUP BY {_SETS} HAVING sum(total_records) >= {fx.SUPPORT}),
other AS ({_CUBE_DURATION})
SELECT c.*, duration_support_count, observed_terminations, censored_records, average_observed_duration_days,
  pending_records::DOUBLE / total_records AS pending_share, matched_records::DOUBLE / total_records AS match_coverage
FROM cells c LEFT JOIN other o ON c.district_code IS NOT DISTINCT FROM o.district_code AND c.nature_family IS NOT DISTINCT FROM o.nature_family""",
)
def cube_portfolio(spark, d):
    facts, promoted = _facts_and_matches(spark, d)
    out = cube.cube_portfolio(marts.portfolio_summary(facts, promoted), marts.duration_summary(facts), fx.SUPPORT)
    return out.withColumn("average_observed_duration_days", F.round("average_observed_duration_days", 6))


@query("cube_duration", _CUBE_DURATION)
def cube_duration(spark, d):
    return rounded(cube.cube_duration(marts.duration_summary(fx.facts(spark, d)), fx.SUPPORT).drop("grouping"), 6)


_CUBE_FILING = f"""SELECT filing_year, district_code, nature_family, sum(cohort_records)::BIGINT AS cohort_records,
  sum(observed_terminations)::BIGINT AS observed_terminations, sum(pending_records)::BIGINT AS pending_records,
  sum(matched_records)::BIGINT AS matched_records, sum(followup_days)::BIGINT AS followup_days
FROM filing GROUP BY GROUPING SETS ((filing_year, district_code, nature_family), (filing_year, district_code), (filing_year, nature_family), (filing_year))
HAVING sum(cohort_records) >= {fx.SUPPORT}"""


@query("cube_filing", _CUBE_FILING)
def cube_filing(spark, d):
    return cube.cube_filing(marts.filing_cohorts(*_facts_and_matches(spark, d)), fx.SUPPORT)


@query(
    "cube_pending_age",
    f"""SELECT age_band, district_code, nature_family, sum(pending_records)::BIGINT AS pending_records,
  sum(matched_pending_records)::BIGINT AS matched_pending_records,
  round(sum(average_age_days * pending_records) / nullif(sum(pending_records), 0), 6) AS average_age_days
FROM inventory GROUP BY GROUPING SETS ((age_band, district_code, nature_family), (age_band, district_code), (age_band, nature_family), (age_band))
HAVING sum(pending_records) >= {fx.SUPPORT}""",
)
def cube_pending_age(spark, d):
    return rounded(cube.cube_pending_age(marts.pending_inventory(*_facts_and_matches(spark, d)), fx.SUPPORT), 6)


@query(
    "cell_accounting",
    f"""SELECT 'portfolio_summary' AS mart, count(*)::BIGINT AS available, count(*) FILTER (total_records >= {fx.SUPPORT})::BIGINT AS published FROM portfolio
UNION ALL SELECT 'filing_cohorts', count(*)::BIGINT, count(*) FILTER (cohort_records >= {fx.SUPPORT})::BIGINT FROM filing
UNION ALL SELECT 'pending_inventory', count(*)::BIGINT, count(*) FILTER (pending_records >= {fx.SUPPORT})::BIGINT FROM inventory""",
)
def cell_accounting(spark, d):
    facts, promoted = _facts_and_matches(spark, d)
    return cube.cell_accounting(
        marts.portfolio_summary(facts, promoted), marts.filing_cohorts(facts, promoted), marts.pending_inventory(facts, promoted), fx.SUPPORT
    )


@query(
    "dimension_lists",
    """SELECT DISTINCT 'district_code' AS dimension, district_code AS value FROM portfolio
UNION ALL SELECT DISTINCT 'nature_family', nature_family FROM portfolio UNION ALL SELECT DISTINCT 'filing_year', filing_year::VARCHAR FROM filing""",
)
def dimension_lists(spark, d):
    facts, promoted = _facts_and_matches(spark, d)
    return cube.dimension_lists(marts.portfolio_summary(facts, promoted), marts.filing_cohorts(facts, promoted))


@query(
    "yoy_change",
    f""", published AS ({_CUBE_FILING}),
complete AS (
  SELECT *, row_number() OVER (PARTITION BY district_code, nature_family ORDER BY filing_year DESC) AS k FROM published WHERE filing_year < 1998)
SELECT a.district_code, a.nature_family, a.filing_year AS current_year, b.filing_year AS previous_year, a.cohort_records AS current_records,
  b.cohort_records AS previous_records, (a.cohort_records - b.cohort_records)::DOUBLE / b.cohort_records AS relative_change
FROM complete a JOIN complete b ON a.district_code IS NOT DISTINCT FROM b.district_code AND a.nature_family IS NOT DISTINCT FROM b.nature_family
WHERE a.k = 1 AND b.k = 2 AND b.cohort_records <> 0""",
)
def yoy_change(spark, d):
    """As of a snapshot of 1998, whose own filings are unfinished."""
    return cube.yoy_change(cube_filing(spark, d), 1998)


_RANK = """, margin AS (SELECT {c}, sum(pending_records)::BIGINT AS pending_records, sum(total_records) AS n FROM portfolio GROUP BY 1)
SELECT {c}, pending_records, row_number() OVER (ORDER BY pending_records DESC, {c})::BIGINT AS rank FROM margin WHERE n >= 120"""


@query("district_ranking", _RANK.format(c="district_code"))
def district_ranking(spark, d):
    return cube.ranking(cube_portfolio(spark, d), "district_code", "nature_family")


@query("family_ranking", _RANK.format(c="nature_family"))
def family_ranking(spark, d):
    return cube.ranking(cube_portfolio(spark, d), "nature_family", "district_code")


# Matching


def _candidates(spark, d):
    return matching.match_candidates(warehouse.cases(fx.facts(spark, d)), fx.districts(spark, d), fx.dockets(spark, d))


@query("match_candidates", "SELECT * FROM candidates")
def match_candidates(spark, d):
    return _candidates(spark, d)


@query(
    "promotion_audit",
    """SELECT count(*) FILTER (candidate_status = 'review_eligible')::BIGINT AS promoted,
  count(DISTINCT case_identifier) FILTER (candidate_status = 'review_eligible')::BIGINT AS distinct_cases,
  count(DISTINCT recap_docket_id) FILTER (candidate_status = 'review_eligible')::BIGINT AS distinct_dockets,
  count(*) FILTER (candidate_status = 'collision')::BIGINT AS collisions,
  count(*) FILTER (candidate_status = 'evidence_conflict')::BIGINT AS conflicts FROM candidates""",
)
def promotion_audit(spark, d):
    return matching.promotion_audit(_candidates(spark, d))


@query(
    "match_coverage",
    """, hit AS (SELECT f.*, source_record_identifier IN (SELECT source_record_identifier FROM candidates WHERE candidate_status = 'review_eligible') AS ok FROM facts f),
dims AS (
  SELECT 'overall' AS dimension_type, 'all' AS dimension_value, ok FROM hit UNION ALL SELECT 'district', district_code, ok FROM hit
  UNION ALL SELECT 'filing_year', year(filed_date)::VARCHAR, ok FROM hit UNION ALL SELECT 'nature_family', nature_family, ok FROM hit
  UNION ALL SELECT 'collision_free', 'true', ok FROM hit WHERE source_record_count = 1)
SELECT dimension_type, dimension_value, count(*)::BIGINT AS records, count(*) FILTER (ok)::BIGINT AS matched_records,
  count(*) FILTER (ok)::DOUBLE / count(*) AS coverage FROM dims GROUP BY ALL""",
)
def match_coverage(spark, d):
    return matching.match_coverage(fx.facts(spark, d), _candidates(spark, d))


@query("review_sample")
def review_sample(spark, d):
    return matching.review_sample(_candidates(spark, d), 800)


_POPULATION = f""", counted_own AS (
  SELECT district_code, count(*) FILTER (filed_date BETWEEN DATE '{fx.WINDOW[0]}' AND DATE '{fx.WINDOW[1]}')::BIGINT AS filed,
    count(*) FILTER (terminated_date BETWEEN DATE '{fx.WINDOW[0]}' AND DATE '{fx.WINDOW[1]}')::BIGINT AS terminated,
    count(*) FILTER (NOT event_observed)::BIGINT AS pending FROM facts GROUP BY 1),
own AS (
  SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS district_code, coalesce(filed, 0) AS filed, coalesce(terminated, 0) AS terminated,
    coalesce(pending, 0) AS pending FROM nation LEFT JOIN counted_own ON district_code = lpad(n_nationkey::VARCHAR, 2, '0')
  UNION ALL SELECT 'TOTAL', sum(filed)::BIGINT, sum(terminated)::BIGINT, sum(pending)::BIGINT FROM counted_own),
ao AS (
  SELECT district_code, CASE WHEN district_code IN ('03', '07') THEN filed + 5 ELSE filed END AS filed,
    CASE WHEN district_code = '11' THEN 0 ELSE terminated END AS terminated,
    CASE WHEN district_code = 'TOTAL' THEN pending + 1 ELSE pending END AS pending FROM own)
"""


def _population(spark, d):
    return matching.population_counts(fx.facts(spark, d), fx.districts(spark, d), *fx.WINDOW)


def _independent(own):
    """An independent table that differs on purpose: two filings, one zero cell and the pending total."""
    c = F.col("district_code")
    return own.select(
        "district_code",
        F.when(c.isin("03", "07"), F.col("filed") + 5).otherwise(F.col("filed")).alias("filed"),
        F.when(c == "11", F.lit(0).cast("long")).otherwise(F.col("terminated")).alias("terminated"),
        F.when(c == "TOTAL", F.col("pending") + 1).otherwise(F.col("pending")).alias("pending"),
    )


@query("ao_population", _POPULATION + "SELECT * FROM own")
def ao_population(spark, d):
    return _population(spark, d)


@query(
    "ao_reconciliation",
    _POPULATION
    + """, long_ao AS (UNPIVOT ao ON filed, terminated, pending INTO NAME measure VALUE ao_value),
long_own AS (UNPIVOT own ON filed, terminated, pending INTO NAME measure VALUE fjc_value),
compared AS (
  SELECT district_code, measure, ao_value::BIGINT AS ao_value, fjc_value::BIGINT AS fjc_value, (fjc_value - ao_value)::BIGINT AS difference,
    abs(fjc_value - ao_value)::DOUBLE / nullif(ao_value::DOUBLE, 0) AS relative_difference,
    CASE WHEN district_code = 'TOTAL' THEN 0.005::DOUBLE ELSE 0.02::DOUBLE END AS tolerance, district_code = 'TOTAL' AS required_for_gate
  FROM long_ao JOIN long_own USING (district_code, measure))
SELECT *, relative_difference <= tolerance AS passed,
  CASE WHEN difference = 0 THEN 'exact' WHEN district_code = 'TOTAL' THEN 'publication_version_lag'
    WHEN relative_difference <= tolerance THEN 'within_predeclared_district_tolerance' ELSE 'district_definition_or_mdl_review_required' END AS reason_code,
  CASE WHEN relative_difference <= tolerance THEN 'accepted' WHEN required_for_gate THEN 'blocks_reconciliation'
    ELSE 'retained_unresolved_district_diagnostic' END AS disposition FROM compared""",
)
def ao_reconciliation(spark, d):
    own = _population(spark, d)
    return matching.tie_out(_independent(own), own)


@query(
    "ao_scope_bridge",
    _POPULATION
    + f""", product AS (
  SELECT count(*) FILTER (filed_date BETWEEN DATE '{fx.WINDOW[0]}' AND DATE '{fx.WINDOW[1]}')::BIGINT AS filed,
    count(*) FILTER (terminated_date BETWEEN DATE '{fx.WINDOW[0]}' AND DATE '{fx.WINDOW[1]}')::BIGINT AS terminated,
    count(*) FILTER (NOT event_observed)::BIGINT AS pending FROM facts WHERE filed_date >= DATE '1996-01-01'),
total AS (SELECT * FROM own WHERE district_code = 'TOTAL'),
bridge AS (
  SELECT 'filed' AS measure, t.filed AS a, p.filed AS b FROM total t, product p UNION ALL
  SELECT 'terminated', t.terminated, p.terminated FROM total t, product p UNION ALL SELECT 'pending', t.pending, p.pending FROM total t, product p)
SELECT measure, a AS complete_snapshot_value, b AS product_value, a - b AS excluded_or_quarantined_records,
  CASE measure WHEN 'pending' THEN 'pre_2010_product_scope_exclusion' WHEN 'terminated' THEN 'structural_quarantine_and_product_scope'
    ELSE 'no_scope_difference' END AS explanation FROM bridge""",
)
def ao_scope_bridge(spark, d):
    return matching.scope_bridge(fx.facts(spark, d).where("filed_date >= DATE '1996-01-01'"), _population(spark, d), *fx.WINDOW)


# Public rows, metrics and pages


def _public(spark, d):
    key = F.left(F.sha2("source_record_identifier", 256), F.lit(22))
    facts = fx.facts(spark, d)
    return publish.public_rows(facts, fx.promoted(facts), key, "v1")


def _mart(spark, d):
    """Public rows as they are served: the mart that ``publish.write_public`` wrote, once a session and source."""
    return fx.written_mart(spark, d, _public)


@query("public_rows", "SELECT * FROM public")
def public_rows(spark, d):
    return _public(spark, d)


@query("public_keyed_rows")
def public_keyed_rows(spark, d):
    """With the keyed digest of a secret, which SQL cannot express; tests compare it with the standard library."""
    key = publish.release_key(F.col("source_record_identifier"), "v1", b"a test secret of at least 32 bytes")
    return publish.public_rows(*_facts_and_matches(spark, d), key, "v1")


_MARK = "left(sha256(release_record_key), 1)"
_VALIDATED = f""", planted AS (
  SELECT * REPLACE (
    CASE {_MARK} WHEN '0' THEN left(release_record_key, 21) ELSE release_record_key END AS release_record_key,
    CASE {_MARK} WHEN '1' THEN NULL WHEN '2' THEN 'v2' ELSE dataset_version END AS dataset_version,
    CASE {_MARK} WHEN '3' THEN NULL WHEN '4' THEN DATE '1999-01-01' ELSE source_snapshot_cutoff END AS source_snapshot_cutoff,
    CASE {_MARK} WHEN '5' THEN filed_month + 1 ELSE filed_month END AS filed_month,
    CASE {_MARK} WHEN '6' THEN NULL WHEN '7' THEN event_observed ELSE pending_status END AS pending_status,
    CASE {_MARK} WHEN '8' THEN DATE '1980-01-01' ELSE terminated_month END AS terminated_month,
    CASE {_MARK} WHEN '9' THEN -1 WHEN 'a' THEN NULL ELSE duration_days END AS duration_days,
    CASE {_MARK} WHEN 'b' THEN NULL ELSE nature_of_suit_mapping_status END AS nature_of_suit_mapping_status,
    CASE {_MARK} WHEN 'c' THEN NULL ELSE nature_of_suit_code END AS nature_of_suit_code,
    CASE {_MARK} WHEN 'd' THEN NULL WHEN 'e' THEN 'merged' ELSE identity_quality_status END AS identity_quality_status,
    CASE {_MARK} WHEN 'f' THEN NULL ELSE source_record_count END AS source_record_count) FROM public
  UNION ALL SELECT * FROM public WHERE district_code = '07')
SELECT 'schema' AS rule, 0::BIGINT AS failures
UNION ALL SELECT 'key_shape', count(*) FILTER (NOT regexp_full_match(release_record_key, '[A-Za-z0-9_-]{{22}}')) FROM planted
UNION ALL SELECT 'dataset_version', count(*) FILTER (dataset_version IS DISTINCT FROM 'v1') FROM planted
UNION ALL SELECT 'source_cutoff', count(*) FILTER (source_snapshot_cutoff IS DISTINCT FROM DATE '{fx.CUTOFF}') FROM planted
UNION ALL SELECT 'filed_month', count(*) FILTER (filed_month IS NULL OR day(filed_month) <> 1) FROM planted
UNION ALL SELECT 'pending_semantics', count(*) FILTER (pending_status IS NULL OR event_observed IS NULL OR pending_status = event_observed) FROM planted
UNION ALL SELECT 'termination_null_rule', count(*) FILTER (pending_status IS DISTINCT FROM (terminated_month IS NULL)) FROM planted
UNION ALL SELECT 'terminated_month', count(*) FILTER (terminated_month IS NOT NULL AND (day(terminated_month) <> 1 OR filed_month IS NULL OR terminated_month < filed_month)) FROM planted
UNION ALL SELECT 'duration', count(*) FILTER (duration_days IS NULL OR duration_days < 0) FROM planted
UNION ALL SELECT 'mapping_status', count(*) FILTER (nature_of_suit_mapping_status IS NULL OR nature_of_suit_mapping_status NOT IN ('supported', 'unsupported')) FROM planted
UNION ALL SELECT 'code_null_rule', count(*) FILTER (nature_of_suit_mapping_status IS NULL OR (nature_of_suit_mapping_status = 'supported') <> (nature_of_suit_code IS NOT NULL)) FROM planted
UNION ALL SELECT 'identity_status', count(*) FILTER (identity_quality_status IS NULL OR identity_quality_status NOT IN ('canonical', 'collision')) FROM planted
UNION ALL SELECT 'identity_count', count(*) FILTER (source_record_count IS NULL OR (CASE WHEN identity_quality_status = 'canonical' THEN source_record_count <> 1 ELSE source_record_count < 2 END)) FROM planted
UNION ALL SELECT 'collision_total', abs(count(*) FILTER (identity_quality_status = 'collision') - 5) FROM planted
UNION ALL SELECT 'not_empty', 0
UNION ALL SELECT 'key_unique', count(*) FROM (SELECT release_record_key FROM planted GROUP BY 1 HAVING count(*) > 1)"""


@query("public_validation", _VALIDATED)
def public_validation(spark, d):
    """Every rule over public rows with faults planted by the digest of the key, and one district twice."""
    rows = _public(spark, d)
    mark = F.left(F.sha2("release_record_key", 256), F.lit(1))

    def put(name, **values):
        out = F.col(name)
        for m, v in values.items():
            out = F.when(mark == m[1:], v if v is not None else F.lit(None)).otherwise(out)
        return out.cast(rows.schema[name].dataType)

    planted = rows.withColumns(
        {
            "release_record_key": put("release_record_key", _0=F.left("release_record_key", F.lit(21))),
            "dataset_version": put("dataset_version", _1=None, _2=F.lit("v2")),
            "source_snapshot_cutoff": put("source_snapshot_cutoff", _3=None, _4=F.lit("1999-01-01")),
            "filed_month": put("filed_month", _5=F.date_add("filed_month", 1)),
            "pending_status": put("pending_status", _6=None, _7=F.col("event_observed")),
            "terminated_month": put("terminated_month", _8=F.lit("1980-01-01")),
            "duration_days": put("duration_days", _9=F.lit(-1), _a=None),
            "nature_of_suit_mapping_status": put("nature_of_suit_mapping_status", _b=None),
            "nature_of_suit_code": put("nature_of_suit_code", _c=None),
            "identity_quality_status": put("identity_quality_status", _d=None, _e=F.lit("merged")),
            "source_record_count": put("source_record_count", _f=None),
        }
    )
    return publish.public_violations(planted.unionByName(rows.where("district_code = '07'")), "v1", fx.CUTOFF, expected_collisions=5)


@query(
    "prohibited_scan",
    r"""SELECT 'email' AS pattern, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}'))::BIGINT AS rows FROM documents
UNION ALL SELECT 'credential', count(*) FILTER (regexp_matches(text, '(?i)(password|secret|api_key)\s*[=:]\s*\S{6,}'))::BIGINT FROM documents
UNION ALL SELECT 'private_key', count(*) FILTER (regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'))::BIGINT FROM documents
UNION ALL SELECT 'access_key', count(*) FILTER (regexp_matches(text, 'AKIA[A-Z0-9]{16}'))::BIGINT FROM documents""",
    base=False,
)
def prohibited_scan(spark, d):
    return publish.prohibited_scan(spark.read.parquet(f"{d}/documents.parquet"), ["text"])


@query(
    "semantic_portfolio",
    f"""SELECT district_code, nature_of_suit_family, count(*)::BIGINT AS total_records, count(*) FILTER (pending_status)::BIGINT AS pending_records,
  count(*) FILTER (pending_status)::DOUBLE / count(*) AS pending_share, count(*) FILTER (recap_match_available)::DOUBLE / count(*) AS match_coverage,
  sum(CASE WHEN event_observed THEN duration_days ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (event_observed), 0) AS average_observed_duration_days
FROM public WHERE origin_code IN ('1', '2', '13') GROUP BY ALL HAVING count(*) >= {fx.SUPPORT // 2}""",
)
def semantic_portfolio(spark, d):
    return metrics.standard_registry(fx.SUPPORT // 2).query(
        _mart(spark, d),
        "portfolio",
        ["total_records", "pending_records", "pending_share", "match_coverage", "average_observed_duration_days"],
        ["district_code", "nature_of_suit_family"],
        [metrics.Filter("origin_code", "in", ["1", "2", "13"])],
    )


@query(
    "semantic_filing",
    f"""SELECT year(filed_month)::BIGINT AS filing_year, nature_of_suit_family, count(*)::BIGINT AS total_records,
  count(*) FILTER (recap_match_available)::BIGINT AS matched_records, sum(duration_days)::BIGINT AS followup_days
FROM public WHERE year(filed_month) BETWEEN 1996 AND 1999 GROUP BY ALL HAVING count(*) >= {fx.SUPPORT}""",
)
def semantic_filing(spark, d):
    return metrics.standard_registry(fx.SUPPORT).query(
        _mart(spark, d), "filing", ["total_records", "matched_records", "followup_days"], ["filing_year", "nature_of_suit_family"],
        [metrics.Filter("filing_year", "between", [1996, 1999])],
    )


@query(
    "semantic_pending_age",
    f"""SELECT CASE WHEN duration_days < 365 THEN 'under_1_year' WHEN duration_days < 730 THEN '1_to_2_years'
    WHEN duration_days < 1825 THEN '2_to_5_years' ELSE '5_years_or_more' END AS age_band, count(*)::BIGINT AS pending_records,
  sum(duration_days)::DOUBLE / count(*) AS average_age_days
FROM public WHERE pending_status AND identity_quality_status = 'canonical' GROUP BY ALL HAVING count(*) >= {fx.SUPPORT}""",
)
def semantic_pending_age(spark, d):
    return metrics.standard_registry(fx.SUPPORT).query(
        _mart(spark, d), "pending_age", ["pending_records", "average_age_days"], ["age_band"],
        [metrics.Filter("identity_quality_status", "eq", "canonical")],
    )


_PAGE = explorer.PageSpec(
    ("release_record_key", "district_code", "nature_of_suit_family", "filed_month", "terminated_month", "duration_days"),
    district="07", sort="terminated_month", descending=True, limit=100, offset=50,
)


@query(
    "record_page",
    """SELECT release_record_key, district_code, nature_of_suit_family, filed_month, terminated_month, duration_days FROM public
WHERE district_code = '07' ORDER BY terminated_month DESC NULLS LAST, release_record_key LIMIT 100 OFFSET 50""",
)
def record_page(spark, d):
    return explorer.page(_mart(spark, d), _PAGE)


@query("record_count", "SELECT count(*)::BIGINT AS matching_rows FROM public WHERE district_code = '07'")
def record_count(spark, d):
    return explorer.count(_mart(spark, d), _PAGE)


@query("record_detail", "SELECT * FROM public WHERE release_record_key = left(sha256('synthetic:1'), 22)")
def record_detail(spark, d):
    import hashlib

    return explorer.detail(_mart(spark, d), hashlib.sha256(b"synthetic:1").hexdigest()[:22])


@query(
    "safe_text",
    """SELECT role, count(*) FILTER (regexp_matches(left(t, 1), '[=+@\\t\\r-]'))::BIGINT AS neutralised, count(*)::BIGINT AS turns
FROM (SELECT role, CASE WHEN turn % 5 = 0 THEN '=' || text ELSE text END AS t FROM conversations) GROUP BY 1""",
    base=False,
)
def safe_text(spark, d):
    from tallyforge.functions.semantics import spreadsheet_safe

    t = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("="), F.col("text"))).otherwise(F.col("text"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("role", t.alias("t"))
    return rows.groupBy("role").agg(F.count_if(spreadsheet_safe(F.col("t")) != F.col("t")).alias("neutralised"), F.count("*").alias("turns"))


# Survival

_KM = """, {name}_counts AS (
  SELECT {keys}duration_days AS dur, count(*) AS n, count(*) FILTER (event_observed) AS d FROM train GROUP BY ALL),
{name}_risk AS (SELECT *, sum(n) OVER ({part}ORDER BY dur DESC ROWS UNBOUNDED PRECEDING) AS r FROM {name}_counts),
{name}_curve AS (SELECT *, product(1 - d::DOUBLE / r) OVER ({part}ORDER BY dur ROWS UNBOUNDED PRECEDING) AS s FROM {name}_risk),
{name} AS (SELECT {keys}sum(n)::BIGINT AS support, {times} FROM {name}_curve GROUP BY ALL)"""


def _km_sql(name: str, keys: list[str]) -> str:
    listed = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    times = ", ".join(f"coalesce(max_by(s, dur) FILTER (dur <= {t}), 1.0) AS s_{t}" for t in TIMES)
    return _KM.format(name=name, keys=listed, part=part, times=times)


_TRAIN = ", train AS (SELECT * FROM cases WHERE filed_date < DATE '1998-01-01' AND nature_family <> 'unsupported')"
_ROUTED = _TRAIN + "".join(_km_sql(f"km_{name}", keys) for name, keys in survival.LEVELS)
_JOINS = " ".join(
    f"LEFT JOIN (SELECT * FROM km_{name} WHERE support >= {fx.ROUTE_SUPPORT}) AS l_{name} ON "
    + " AND ".join(f"c.{k} = l_{name}.{k}" for k in keys)
    for name, keys in survival.LEVELS[:-1]
)
_SCORED = (
    _ROUTED
    + ", scored AS (SELECT c.source_record_identifier, c.district_code, c.nature_family, c.jurisdiction_code, c.origin_code, c.event_observed, c.duration_days, "
    + "CASE WHEN c.nature_family = 'unsupported' THEN 'abstain' "
    + " ".join(f"WHEN l_{name}.support IS NOT NULL THEN '{name}'" for name, _ in survival.LEVELS[:-1])
    + " ELSE 'global' END AS route, "
    + ", ".join(
        f"CASE WHEN c.nature_family <> 'unsupported' THEN 1 - coalesce({', '.join(f'l_{name}.s_{t}' for name, _ in survival.LEVELS[:-1])}, g.s_{t}) END AS p_{t}"
        for t in TIMES
    )
    + f" FROM (SELECT * FROM cases WHERE filed_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') c {_JOINS}, km_global g)"
)
_Y = {t: f"(event_observed AND duration_days <= {t})::INTEGER::DOUBLE" for t in TIMES}


def _split(spark, d):
    rows = fx.cases(fx.facts(spark, d))
    return rows.where("filed_date < DATE '1998-01-01'"), rows.where("filed_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")


def _scored(spark, d):
    train, test = _split(spark, d)
    names = ["source_record_identifier", *survival.KEYS, "event_observed", "duration_days"]
    return survival.routed_probability(train, test.select(*names), TIMES, fx.ROUTE_SUPPORT)


@query(
    "km_curve",
    ", train AS (SELECT * FROM cases)" + _km_sql("km", ["nature_family"])
    + " SELECT nature_family, support, " + ", ".join(f"round(s_{t}, 9) AS s_{t}" for t in TIMES) + " FROM km",
)
def km_curve(spark, d):
    return rounded(survival.km_curves(fx.cases(fx.facts(spark, d)), TIMES))


@query(
    "km_routed_probability",
    _SCORED + " SELECT * EXCLUDE (" + ", ".join(f"p_{t}" for t in TIMES) + "), " + ", ".join(f"round(p_{t}, 9) AS p_{t}" for t in TIMES) + " FROM scored",
)
def km_routed_probability(spark, d):
    return rounded(_scored(spark, d))


@query(
    "support_routes",
    ", exact AS (SELECT district_code, nature_family, jurisdiction_code, origin_code, count(*)::BIGINT AS n FROM cases GROUP BY ALL), wide AS (SELECT *, "
    + ", ".join(f"sum(n) OVER (PARTITION BY {', '.join(keys)}) AS n_{name}" for name, keys in survival.LEVELS[:-1])
    + " FROM exact) SELECT district_code, nature_family, jurisdiction_code, origin_code, n, CASE WHEN nature_family = 'unsupported' THEN 'abstain' "
    + " ".join(f"WHEN n_{name} >= {fx.ROUTE_SUPPORT} THEN '{name}'" for name, _ in survival.LEVELS[:-1])
    + " ELSE 'global' END AS route FROM wide",
)
def support_routes(spark, d):
    return survival.support_routes(fx.cases(fx.facts(spark, d)), fx.ROUTE_SUPPORT)


@query(
    "brier_by_case",
    _SCORED + " SELECT source_record_identifier, route, round(("
    + " + ".join(f"(pow(p_{a} - {_Y[a]}, 2) + pow(p_{b} - {_Y[b]}, 2)) / 2 * {b - a}" for a, b in zip(TIMES[:-1], TIMES[1:], strict=True))
    + f") / {TIMES[-1] - TIMES[0]}, 9) AS brier FROM scored",
)
def brier_by_case(spark, d):
    return rounded(survival.integrated_brier(_scored(spark, d), TIMES).select("source_record_identifier", "route", "brier"))


_MEANS = {t: f"avg(p_{t} - {_Y[t]})" for t in TIMES}


@query(
    "slice_calibration",
    _SCORED + ", slices AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, * FROM scored WHERE route <> 'abstain'" for k in survival.KEYS)
    + ") SELECT dimension, value, count(*)::BIGINT AS cases, " + ", ".join(f"round({_MEANS[t]}, 9) AS error_{t}" for t in TIMES)
    + ", round(greatest(" + ", ".join(f"abs({_MEANS[t]})" for t in TIMES) + "), 9) AS max_abs_error FROM slices GROUP BY ALL HAVING count(*) >= 20",
)
def slice_calibration(spark, d):
    return rounded(survival.slice_calibration(_scored(spark, d), TIMES, 20))


_KEYED = ", ".join(
    f"CASE WHEN route IN ({', '.join(repr(level) for level, keys in survival.LEVELS if k in keys)}) THEN {k} END AS {k}" for k in survival.KEYS
)


@query(
    "route_certification",
    _SCORED + f", r AS (SELECT route, {_KEYED}, count(*)::BIGINT AS cases, greatest(" + ", ".join(f"abs({_MEANS[t]})" for t in TIMES)
    + ") AS e FROM (SELECT * FROM scored WHERE route <> 'abstain') GROUP BY ALL) SELECT * EXCLUDE (e), round(e, 9) AS max_abs_error, cases >= 20 AND e <= 0.1 AS certified FROM r",
)
def route_certification(spark, d):
    return rounded(survival.route_certification(_scored(spark, d), TIMES, 20, 0.1))


SEED = 20260331


def _drawn_sql(rows: str, key: str, sums: dict[str, str], statistic: str, whole: str) -> str:
    """rows (key first) under the replicates' weights; the statistic's interval beside its whole value."""
    weighed = ", ".join(f"sum(w * ({e})::DOUBLE) AS {c}" for c, e in sums.items())
    prime, step, mix = calibration.PRIME, calibration.STEP, calibration.MIX
    weight = " + ".join(f"(share > {c!r}::DOUBLE)::INTEGER" for c in calibration.POISSON)
    return f""", keyed AS ({rows}), digests AS (SELECT *, ('0x' || left(md5({key}), 8))::BIGINT AS digest FROM keyed),
draws AS (SELECT *, (digest + (replicate + {SEED % prime}) * {step}) % {prime} + 1 AS start FROM digests, range(400) AS r(replicate)),
squared AS (SELECT *, (start * start + replicate * {mix}) % {prime} AS once FROM draws),
shares AS (SELECT *, ((once * once + digest) % {prime} * {step} % {prime})::DOUBLE / {prime} AS share FROM squared),
weighed AS (SELECT *, {weight} AS w FROM shares),
replicates AS (SELECT replicate, sum(w)::DOUBLE AS weight, {weighed} FROM weighed GROUP BY 1)
SELECT {whole}, round(quantile_cont({statistic}, 0.025), 9) AS low, round(quantile_cont({statistic}, 0.975), 9) AS high FROM replicates"""


_BRIER = (
    _SCORED + ", briers AS (SELECT source_record_identifier, (" + " + ".join(
        f"(pow(p_{a} - {_Y[a]}, 2) + pow(p_{b} - {_Y[b]}, 2)) / 2 * {b - a}" for a, b in zip(TIMES[:-1], TIMES[1:], strict=True)
    ) + f") / {TIMES[-1] - TIMES[0]} AS brier FROM scored)"
)


@query(
    "bootstrap_interval",
    _BRIER + _drawn_sql("SELECT * FROM briers WHERE brier IS NOT NULL", "source_record_identifier", {"brier": "brier"}, "brier / weight",
    "(SELECT round(avg(brier), 9) FROM keyed) AS mean"),
)
def bootstrap_interval(spark, d):
    scored = survival.integrated_brier(_scored(spark, d), TIMES).select("source_record_identifier", "brier")
    return rounded(calibration.mean_interval(scored, ["source_record_identifier"], "brier", seed=SEED))


_WINDOW98 = "filed_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
_CLUSTERS = f""", clusters AS (SELECT date_trunc('month', filed_date)::DATE AS filed_month, district_code, nature_family, origin_code,
  count(*)::BIGINT AS cases, count(*) FILTER (event_observed AND duration_days <= 365)::BIGINT AS resolved FROM cases WHERE {_WINDOW98} GROUP BY ALL)"""


def _clusters(spark, d):
    return survival.resolution_clusters(fx.cases(fx.facts(spark, d)), "1997-01-01", "1998-12-31", 365)


@query("resolution_clusters", _CLUSTERS + " SELECT * FROM clusters")
def resolution_clusters(spark, d):
    return _clusters(spark, d)


@query(
    "resolution_training",
    _CLUSTERS + " SELECT sum(cases)::BIGINT AS cases, sum(resolved)::BIGINT AS resolved, sum(resolved)::DOUBLE / sum(cases) AS rate FROM clusters HAVING sum(cases) > 0",
)
def resolution_training(spark, d):
    return survival.resolution_training(fx.cases(fx.facts(spark, d)), "1997-01-01", "1998-12-31", 365)


@query(
    "monthly_calibration",
    _CLUSTERS + """ SELECT filed_month, sum(cases)::BIGINT AS cases, sum(resolved)::BIGINT AS resolved,
  abs(sum(resolved)::DOUBLE / sum(cases) - 0.5) AS abs_error FROM clusters GROUP BY 1 HAVING sum(cases) >= 60""",
)
def monthly_calibration(spark, d):
    return survival.monthly_calibration(_clusters(spark, d), 0.5, 60)


# Profiles


@query(
    "semantics_audit",
    """SELECT count(*)::BIGINT AS cases, count(*) FILTER (event_observed)::BIGINT AS observed_terminations,
  count(*) FILTER (NOT event_observed)::BIGINT AS right_censored, count(*) FILTER (duration_days < 0)::BIGINT AS negative_durations,
  count(*) FILTER (event_observed AND terminated_date IS NULL)::BIGINT AS event_without_termination,
  count(*) FILTER (NOT event_observed AND terminated_date IS NOT NULL)::BIGINT AS censor_with_termination,
  count(*) FILTER (analysis_end_date <> coalesce(terminated_date, source_snapshot_cutoff))::BIGINT AS analysis_end_mismatches FROM cases""",
)
def semantics_audit(spark, d):
    return profiles.semantics_audit(fx.cases(fx.facts(spark, d)))


_RATES = """count(*)::BIGINT AS cases, avg((event_observed AND duration_days <= 365)::INTEGER) AS termination_rate_365d,
  avg((event_observed AND duration_days <= 730)::INTEGER) AS termination_rate_730d"""


@query(
    "cohort_profile",
    f"SELECT intake_procedural_cohort AS procedural_cohort, {_RATES}, avg((NOT event_observed)::INTEGER) AS censored_at_snapshot_share FROM cases GROUP BY 1",
)
def cohort_profile(spark, d):
    return profiles.cohort_profile(fx.cases(fx.facts(spark, d)))


@query(
    "calendar_drift",
    f""", segments AS (
  SELECT *, 'all_cases' AS segment FROM cases UNION ALL SELECT *, 'district_19' FROM cases WHERE district_code = '19'
  UNION ALL SELECT *, 'origin_13' FROM cases WHERE origin_code = '13'
  UNION ALL SELECT *, 'personal_injury_tort' FROM cases WHERE nature_family = 'tort_personal_injury'
  UNION ALL SELECT *, 'social_security' FROM cases WHERE nature_family = 'social_security'
  UNION ALL SELECT *, 'multidistrict_litigation' FROM cases WHERE intake_procedural_cohort = 'multidistrict_litigation')
SELECT year(filed_date)::INTEGER AS filing_year, segment, {_RATES} FROM segments GROUP BY 1, 2""",
)
def calendar_drift(spark, d):
    return profiles.calendar_drift(fx.cases(fx.facts(spark, d)), "19")


_BAD = """, k AS (SELECT *, (regexp_extract(source_record_identifier, '[0-9]+$'))::BIGINT AS o FROM facts),
bad AS (
  SELECT * EXCLUDE (o) REPLACE (
    CASE WHEN o % 101 = 0 THEN 'collision' ELSE identity_quality_status END AS identity_quality_status,
    CASE WHEN o % 103 = 0 THEN 'unsupported' ELSE nature_of_suit_mapping_status END AS nature_of_suit_mapping_status,
    CASE WHEN o % 107 = 0 THEN -1 ELSE duration_days END AS duration_days,
    CASE WHEN o % 109 = 0 THEN NULL ELSE censoring_date END AS censoring_date,
    CASE WHEN o % 113 = 0 THEN NULL ELSE terminated_date END AS terminated_date,
    CASE WHEN o % 127 = 0 THEN 'ordinary_original' ELSE intake_procedural_cohort END AS intake_procedural_cohort,
    CASE WHEN o % 131 = 0 THEN 'synthetic:0' ELSE source_record_identifier END AS source_record_identifier) FROM k),
twice AS (SELECT * FROM portfolio UNION ALL SELECT * FROM portfolio WHERE district_code = '07'),
filings AS (SELECT * FROM filing UNION ALL SELECT * FROM filing WHERE filing_year = 1995),
pendings AS (SELECT * FROM inventory UNION ALL SELECT * FROM inventory WHERE district_code = '11'),
pairings AS (SELECT * REPLACE ('review_eligible' AS candidate_status) FROM candidates UNION ALL SELECT * FROM candidates WHERE recap_docket_id LIKE '%3')
SELECT 'identity_status_matches_count' AS assertion, count(*) FILTER ((source_record_count = 1) <> (identity_quality_status = 'canonical'))::BIGINT AS failures FROM bad
UNION ALL SELECT 'mapping_status_consistent', count(*) FILTER ((nature_of_suit_mapping_status = 'supported') <> (nature_of_suit_family IS NOT NULL)) FROM bad
UNION ALL SELECT 'nonnegative_exact_duration', count(*) FILTER (duration_days < 0 OR duration_days <> date_diff('day', filed_date, analysis_end_date)) FROM bad
UNION ALL SELECT 'pending_censoring_semantics', count(*) FILTER (NOT event_observed AND (terminated_date IS NOT NULL OR censoring_date IS NULL)) FROM bad
UNION ALL SELECT 'terminated_event_semantics', count(*) FILTER (event_observed AND (terminated_date IS NULL OR censoring_date IS NOT NULL)) FROM bad
UNION ALL SELECT 'intake_procedural_cohort', count(*) FILTER (origin_code IN ('6', '13') AND intake_procedural_cohort <> 'multidistrict_litigation') FROM bad
UNION ALL SELECT 'source_identity_unique', count(*) FROM (SELECT 1 FROM bad GROUP BY source_record_identifier HAVING count(*) > 1)
UNION ALL SELECT 'portfolio_grain_unique', count(*) FROM (SELECT 1 FROM twice GROUP BY district_code, nature_family HAVING count(*) > 1)
UNION ALL SELECT 'filing_grain_unique', count(*) FROM (SELECT 1 FROM filings GROUP BY filing_year, district_code, nature_family HAVING count(*) > 1)
UNION ALL SELECT 'inventory_grain_unique', count(*) FROM (SELECT 1 FROM pendings GROUP BY district_code, nature_family, age_band HAVING count(*) > 1)
UNION ALL SELECT 'candidate_pair_unique', count(*) FROM (SELECT 1 FROM pairings GROUP BY case_identifier, recap_docket_id HAVING count(*) > 1)
UNION ALL SELECT 'review_eligible_has_no_collision', count(*) FILTER (candidate_status = 'review_eligible' AND (recap_candidates_for_fjc > 1 OR fjc_candidates_for_recap > 1)) FROM pairings
UNION ALL SELECT 'portfolio_rows_reconcile', abs((SELECT count(*) FROM bad) - sum(total_records))::BIGINT FROM twice
UNION ALL SELECT 'filing_rows_reconcile', abs((SELECT count(*) FROM bad) - sum(cohort_records))::BIGINT FROM filings
UNION ALL SELECT 'pending_rows_reconcile', abs((SELECT count(*) FROM bad WHERE NOT event_observed) - sum(pending_records))::BIGINT FROM pendings"""


@query("assertions", _BAD)
def assertions(spark, d):
    """Every assertion over relations with faults planted by order key, district, year and docket."""
    facts, promoted = _facts_and_matches(spark, d)
    key = fx.order_key()
    put = lambda n, c, v: F.when(key % n == 0, v).otherwise(F.col(c))
    bad = facts.withColumns(
        {
            "identity_quality_status": put(101, "identity_quality_status", "collision"),
            "nature_of_suit_mapping_status": put(103, "nature_of_suit_mapping_status", "unsupported"),
            "duration_days": put(107, "duration_days", -1),
            "censoring_date": put(109, "censoring_date", F.lit(None)),
            "terminated_date": put(113, "terminated_date", F.lit(None)),
            "intake_procedural_cohort": put(127, "intake_procedural_cohort", "ordinary_original"),
            "source_record_identifier": put(131, "source_record_identifier", "synthetic:0"),
        }
    )
    portfolio, filing, inventory = marts.portfolio_summary(facts, promoted), marts.filing_cohorts(facts, promoted), marts.pending_inventory(facts, promoted)
    portfolio, filing, inventory = (written(mart, "mart") for mart in (portfolio, filing, inventory))
    cases = warehouse.cases(facts)
    pairs = written(matching.match_candidates(cases, fx.districts(spark, d), fx.dockets(spark, d)), "pairs")
    pairs = pairs.withColumn("candidate_status", F.lit("review_eligible")).unionByName(pairs.where("recap_docket_id LIKE '%3'"))
    return profiles.assertions(
        bad,
        portfolio.unionByName(portfolio.where("district_code = '07'")),
        filing.unionByName(filing.where("filing_year = 1995")),
        inventory.unionByName(inventory.where("district_code = '11'")),
        pairs,
    )


# Ingest and planning

_RAW = """WITH raw_rows AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'none' WHEN o_orderkey % 51 = 0 THEN '13/45/2001' WHEN o_orderkey % 53 = 0 THEN NULL
    ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS FILEDATE,
    CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'L' ELSE 'S' END AS STATUSCD,
    CASE WHEN o_orderkey % 7 = 0 THEN '01/02/1999' ELSE '01/01/1900' END AS TERMDATE, '2099' AS TAPEYEAR FROM orders),
parsed AS (SELECT *, try_strptime(FILEDATE, '%m/%d/%Y')::DATE AS f FROM raw_rows),
judged AS (
  SELECT *, CASE WHEN f < DATE '1996-01-01' THEN 'before_product_start' WHEN f IS NULL THEN 'invalid_filed_date' WHEN f > DATE '2000-12-31' THEN 'filed_after_snapshot'
    WHEN NOT coalesce(STATUSCD = 'L' OR (STATUSCD = 'S' AND TERMDATE = '01/01/1900' AND TAPEYEAR = '2099'), false) THEN 'invalid_status_sentinel' END AS reason FROM parsed)
SELECT CASE WHEN reason = 'before_product_start' THEN 'excluded' WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, reason,
  year(f)::INTEGER AS filing_year, count(*)::BIGINT AS records FROM judged GROUP BY ALL"""


def raw_rows(spark, d):
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    filed = F.when(k % 50 == 0, "none").when(k % 51 == 0, "13/45/2001").when(k % 53 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    status = F.when(k % 61 == 0, F.lit(None)).when(F.col("o_orderstatus") == "F", "L").otherwise("S")
    return o.select(
        k.cast("string").alias("source_row_number"), filed.alias("FILEDATE"), status.alias("STATUSCD"),
        F.when(k % 7 == 0, "01/02/1999").otherwise("01/01/1900").alias("TERMDATE"), F.lit(None).cast("string").alias("TDATEUSE"), F.lit("2099").alias("TAPEYEAR"),
    )


@query("raw_triage", _RAW, base=False)
def raw_triage(spark, d):
    rows = ingest.triage(raw_rows(spark, d), "1996-01-01", "2000-12-31")
    return rows.groupBy("outcome", "reason", F.year("filed_date_parsed").alias("filing_year")).agg(F.count("*").alias("records"))


@query(
    "docket_normalise",
    """WITH src AS (
  SELECT ' ' || o_orderkey || ' ' AS id, 'court' || (o_custkey % 6) AS court_id, CASE WHEN o_orderkey % 29 = 0 THEN 'T' ELSE '' END AS blocked,
    CASE WHEN o_orderkey % 31 = 0 THEN 'cr' ELSE 'CV' END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS date_filed,
    CASE WHEN o_orderkey % 37 = 0 THEN '20-123' ELSE lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') END AS core, (o_custkey % 11)::VARCHAR AS office FROM orders),
judged AS (
  SELECT *, CASE WHEN court_id NOT IN ('court0', 'court1', 'court2', 'court3', 'court4') THEN 'court_not_selected' WHEN lower(trim(blocked)) IN ('1', 't', 'true') THEN 'blocked'
    WHEN lower(trim(kind)) <> 'cv' THEN 'not_civil' WHEN NOT coalesce(try_strptime(date_filed, '%Y-%m-%d')::DATE BETWEEN DATE '1996-01-01' AND DATE '2000-12-31', false) THEN 'filed_outside_population'
    WHEN NOT regexp_full_match(core, '[0-9]{7}') THEN 'invalid_docket_core' WHEN length(office::INTEGER::VARCHAR) <> 1 THEN 'invalid_office' END AS reject_reason FROM src)
SELECT trim(id) AS recap_docket_id, court_id, CASE WHEN office::INTEGER < 10 THEN office::INTEGER::VARCHAR END AS office_code, core AS docket_number_core,
  date_filed::DATE AS filed_date, NULL::DATE AS terminated_date, reject_reason FROM judged""",
    base=False,
)
def docket_normalise(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit(" "), k.cast("string"), F.lit(" ")).alias("id"), F.concat(F.lit("court"), (c % 6).cast("string")).alias("court_id"),
        F.when(k % 29 == 0, "T").otherwise("").alias("blocked"), F.when(k % 31 == 0, "cr").otherwise("CV").alias("federal_dn_case_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_filed"), F.lit(None).cast("string").alias("date_terminated"),
        F.when(k % 37 == 0, "20-123").otherwise(F.lpad((k % 10_000_000).cast("string"), 7, "0")).alias("docket_number_core"),
        (c % 11).cast("string").alias("federal_dn_office_code"),
    )
    return ingest.normalise_dockets(rows, [f"court{i}" for i in range(5)], "1996-01-01", "2000-12-31")


@query(
    "scenario_table",
    """WITH a AS (SELECT n_nationkey AS scenario, (10 + n_nationkey)::DECIMAL(5,0) * 12::DECIMAL(2,0) AS months FROM nation),
c(kind, m) AS (VALUES ('low', 0.755::DECIMAL(8,6)), ('base', 1::DECIMAL(8,6)), ('high', 1.125::DECIMAL(8,6))),
h AS (SELECT scenario, kind, (months::DECIMAL(7,0) * 6.255::DECIMAL(8,3))::DECIMAL(15,6) * m AS ah, (months::DECIMAL(7,0) * 3.505::DECIMAL(8,3))::DECIMAL(15,6) * m AS ph FROM a, c)
SELECT scenario, kind AS "case", ah::DOUBLE AS attorney_hours, ph::DOUBLE AS paralegal_hours, round_even(ah::DOUBLE / 1560.0, 2) AS attorney_fte,
  round_even(ph::DOUBLE / 1560.0, 2) AS paralegal_fte, round(ah::DECIMAL(26,12) * 310.505::DECIMAL(8,3) + ph::DECIMAL(26,12) * 120.255::DECIMAL(8,3), 2)::DOUBLE AS budget_usd FROM h""",
    base=False,
)
def scenario_table(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").select(
        F.col("n_nationkey").alias("scenario"), (F.col("n_nationkey") + 10).alias("matters"), F.lit(12).alias("horizon_months"),
        F.lit("6.255").alias("attorney_hours_per_matter_month"), F.lit("3.505").alias("paralegal_hours_per_matter_month"),
        F.lit("310.505").alias("attorney_rate_usd"), F.lit("120.255").alias("paralegal_rate_usd"), F.lit("130").alias("productive_hours_per_fte_month"),
        F.lit("0.755").alias("low_multiplier"), F.lit("1.125").alias("high_multiplier"),
    )
    return planning.scenario_table(rows)


@query(
    "review_precision",
    """SELECT count(*)::BIGINT AS true_matches, 0::BIGINT AS false_matches, round(pow(0.025, 1.0 / count(*)), 9) AS lower_bound,
  pow(0.025, 1.0 / count(*)) >= 0.995 AS passed FROM labels WHERE quality = 1""",
    base=False,
)
def review_precision(spark, d):
    """Reviews that all agree, for which the exact bound has a closed form in SQL; tests cover the others."""
    rows = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select(F.lit("true_match").alias("review_label"))
    out = matching.review_precision(rows)
    row = (out["true_matches"], out["false_matches"], round(out["lower_bound"], 9), out["passed"])
    return spark.createDataFrame([row], "true_matches long, false_matches long, lower_bound double, passed boolean")
