"""Unit tests of the library's rules on hand-made rows."""

import base64
import hashlib
import hmac
import math
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.contracts import Contract, ContractError, require, violations
from tallyforge.functions import semantics
from tallyforge.functions.codebook import FAMILIES, codebook
from tallyforge.operators import calibration, cube, explorer, marts, matching, metrics, planning, publish, survival, warehouse
from tallyforge.plans import catalogue, fixtures, governance, registry
from tallyforge.sources import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_null_parts_keep_their_separators(spark):
    key = semantics.joined_key(F.lit("a"), F.lit(None).cast("string"), F.lit("c"))
    assert one(spark, key) == "a||c"


@pytest.mark.parametrize("text,want", [("1/2/2026", date(2026, 1, 2)), ("01/02/2026", date(2026, 1, 2)), ("13/45/2001", None), ("none", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, semantics.parse_us_date(F.lit(text).cast("string"))) == want


def test_cohort_order_and_bands(spark):
    c = lambda o, f: one(spark, semantics.procedural_cohort(F.lit(o), F.lit(f)))
    assert c("13", "social_security") == "multidistrict_litigation"
    assert c("1", "social_security") == "social_security_review"
    assert c("1", "labor") == "ordinary_original" and c("4", "labor") == "other_procedural_origin"
    band = lambda d: one(spark, semantics.age_band(F.lit(d)))
    assert [band(d) for d in (364, 365, 730, 1825)] == ["under_1_year", "1_to_2_years", "2_to_5_years", "5_years_or_more"]


@pytest.mark.parametrize("text,want", [("3", "3"), ("07", "7"), ("10", None), ("x", None), ("", None)])
def test_office(spark, text, want):
    assert one(spark, semantics.office_code(F.lit(text))) == want


def test_zero_denominator_is_null(spark):
    assert one(spark, semantics.ratio(F.lit(1), F.lit(0))) is None


def test_codebook(spark):
    rows = codebook(spark).collect()
    assert len(rows) == 93 == len({r.raw_code for r in rows}) and len(FAMILIES) == 13


def test_contract(spark):
    contract = Contract("a string, b bigint", not_null=("a",), unique=(("b",),), accepted={"a": ("x", "y")})
    good = spark.createDataFrame([("x", 1, 0), ("y", 2, 0)], "a string, b int, extra int")
    assert require(good, contract).dtypes == [("a", "string"), ("b", "bigint")]
    bad = spark.createDataFrame([("z", 1), (None, 1)], "a string, b int")
    assert {(r["rule"], r["column"]): r["failures"] for r in violations(bad, contract).collect()} == {
        ("not_null", "a"): 1, ("accepted", "a"): 1, ("unique", "b"): 1,
    }
    with pytest.raises(ContractError):
        require(bad, contract)
    with pytest.raises(ContractError):
        require(good.drop("b"), contract)


def test_kaplan_meier_golden(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, True)], "duration_days long, event_observed boolean")
    out = survival.km_curves(rows, [0, 1, 2, 3], []).first()
    assert [round(out[f"s_{t}"], 9) for t in range(4)] == [1.0, round(2 / 3, 9), round(2 / 3, 9), 0.0]


def test_curves_never_rise(spark):
    cases = fixtures.cases(fixtures.facts(spark, SF))
    out = survival.km_curves(cases, [0, 100, 400, 900, 2000]).collect()
    for r in out:
        s = [r[f"s_{t}"] for t in (0, 100, 400, 900, 2000)]
        assert s == sorted(s, reverse=True)


def test_resampled_intervals(spark):
    rows = spark.range(500).select("id", (F.col("id") % 10).cast("double").alias("v"), (F.col("id") % 10 / 2).alias("w"))
    mean, low, high = calibration.mean_interval(rows, ["id"], "v", 200).first()
    assert mean == 4.5 and low < mean < high and high - low < 1.2
    mean, low, high = calibration.mean_interval(rows.withColumn("v", -F.col("v")), ["id"], "v", 200, absolute=True).first()
    assert mean == 4.5 and low < mean < high
    gain, low, high = calibration.improvement_interval(rows, ["id"], "v", "w", 200).first()
    assert gain == 0.5 and abs(low - 0.5) < 1e-9 and abs(high - 0.5) < 1e-9
    clusters = spark.createDataFrame([(k, 40, 10 + k % 7) for k in range(60)], "k long, cases long, resolved long")
    error, low, high = calibration.cluster_interval(clusters, ["k"], 0.4, 200).first()
    true = abs(0.4 - sum(10 + k % 7 for k in range(60)) / 2400)
    assert abs(error - true) < 1e-12 and low < true < high
    assert calibration.mean_interval(rows.limit(0), ["id"], "v", 20).first() == (None, None, None)


def test_draws_follow_the_rows_and_not_their_tasks(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("v"))
    one, many = (sorted(map(tuple, calibration.resampled_sums(rows.repartition(n), ["id"], ["v"], 300).collect())) for n in (1, 7))
    assert one == many and len(one) == 300
    weights = np.array([r[1] for r in one]) / 2000
    assert abs(weights.mean() - 1) < 0.01 and 0.7 < weights.std() * math.sqrt(2000) < 1.3  # of a Poisson(1) sum
    draws = rows.select(*[calibration.poisson_weight(calibration.drawn_share(calibration.digest_number(F.col("id").cast("string")), F.lit(r).cast("long"), 1)).alias(f"r{r}") for r in range(40)]).toPandas().to_numpy()
    share = [(draws == k).mean() for k in range(5)]
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=0.005)
    across = np.corrcoef(draws.T)[np.triu_indices(40, 1)]
    assert abs(across.mean()) < 0.003 and abs(across).max() < 0.12


def test_calibration_is_recovered(spark):
    p = F.col("id") / 1001
    rows = spark.range(1, 1001).select(p.alias("p"), (1 / (1 + F.exp(-(0.4 + 1.5 * F.log(p / (1 - p)))))).alias("y"))
    a, b = calibration.fit_logit_affine(rows, "p", F.col("y"))
    assert abs(a - 0.4) < 0.02 and abs(math.exp(b) - 1.5) < 0.03
    z = [-3.0, -1.0, 0.0, 0.5, 2.5]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(calibration.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 2e-7 for r, x in zip(got, z))
    # Durations of a log-normal law with location 5 and scale 0.5.
    quantiles = spark.range(1, 2000).select(F.lit(5.0).alias("mu"), (F.col("id") / 2000).alias("u"))
    cases = quantiles.select("mu", F.lit(True).alias("event_observed"), F.exp(5 + 0.5 * F.log(F.col("u") / (1 - F.col("u"))) / 1.702).alias("duration_days"))
    a, b, s = calibration.fit_aft(cases, "mu", [60, 120, 150, 200, 400])
    assert abs(a + 5 * b - 5) < 0.05 and abs(s - 0.5) < 0.05


def test_year_over_year_takes_complete_published_years(spark):
    rows = [("a", "f", 2018, 50), ("a", "f", 2020, 100), ("a", "f", 2023, 120), ("a", "f", 2026, 9), ("b", None, 2023, 5), (None, None, 2019, 0), (None, None, 2020, 5)]
    df = spark.createDataFrame(rows, "district_code string, nature_family string, filing_year int, cohort_records long")
    out = [tuple(r) for r in cube.yoy_change(df, 2026).collect()]
    assert out == [("a", "f", 2023, 2020, 120, 100, 0.2)]


def test_scenario_keeps_all_places(spark):
    names = list(planning.BOUNDS)
    row = ("s", 100, 12, "6.255", "3.5", "310.5", "120.25", "120", "0.755", "1.125")
    df = lambda r: spark.createDataFrame([r], "scenario string, matters int, horizon_months int, " + ", ".join(f"{n} string" for n in names[2:]))
    assert [r.attorney_hours for r in planning.scenario_table(df(row)).collect()] == [5667.03, 7506.0, 8444.25]
    for k, bad in ((1, 0), (1, 10_001), (2, 61), (3, "500.1"), (7, "0.5"), (8, "1.1"), (9, "0.9"), (9, None)):
        wrong = row[:k] + (bad,) + row[k + 1 :]
        with pytest.raises(Exception, match="outside bounds"):
            planning.scenario_table(df(wrong)).collect()


def test_merge_replaces_and_skips_loaded_snapshots(spark):
    make = lambda rows: spark.createDataFrame(rows, "source_record_identifier string, source_digest string, v int")
    out = warehouse.merge_new(make([("1", "a", 1), ("2", "a", 1)]), make([("2", "b", 2), ("3", "b", 2), ("1", "a", 9)]))
    assert sorted(tuple(r) for r in out.collect()) == [("1", "a", 1), ("2", "b", 2), ("3", "b", 2)]


def test_policies_and_holdouts():
    gates = [planning.Gate("error", "<=", 0.05), planning.Gate("n", ">=", 200)]
    digest = planning.policy_digest(gates)
    cases = {"total": 10, "supported": 8, "abstained": 2}
    assert planning.evaluate_policy(gates, digest, {"error": 0.01, "n": 300}, cases)["passed"]
    out = planning.evaluate_policy(gates, digest, {"error": float("inf")}, {**cases, "total": 11})
    assert out["reasons"] == ["case_accounting", "not_finite:error", "missing:n"]
    with pytest.raises(ValueError):
        planning.evaluate_policy(gates[:1], digest, {}, cases)
    planning.guard_holdout(date(2026, 1, 1), date(2024, 6, 1), 365, 0)
    for args in ((date(2026, 1, 1), date(2025, 6, 1), 365, 0), (date(2026, 1, 1), date(2024, 6, 1), 365, 1)):
        with pytest.raises(PermissionError):
            planning.guard_holdout(*args)


def test_snapshot_guard_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(date(2026, 3, 31),), (date(2026, 1, 1),)], "as_of_date date")
    assert calibration.guard_snapshot(rows, "2026-03-31") is rows
    with pytest.raises(ValueError):
        calibration.guard_snapshot(rows, "2026-06-30")
    spark.range(3).withColumn("filing_year", F.lit(2020)).write.partitionBy("filing_year").parquet(str(tmp_path / "m"))
    assert ingest.read_years(spark, str(tmp_path / "m"), [2020]).count() == 3
    with pytest.raises(ingest.IngestError, match="2021"):
        ingest.read_years(spark, str(tmp_path / "m"), [2020, 2021])
    ingest.write_review(spark.createDataFrame([("=1+1", 2)], "note string, n int"), str(tmp_path / "review.csv"))
    assert ingest.read_review(spark, str(tmp_path / "review.csv"), "note string, n int").first() == ("'=1+1", 2)
    with pytest.raises(ingest.IngestError):
        ingest.read_review(spark, str(tmp_path / "review.csv"), "other string")
    dockets = spark.createDataFrame([("1", date(2020, 5, 1), None), ("2", date(2021, 5, 1), "blocked")], "recap_docket_id string, filed_date date, reject_reason string")
    ingest.write_dockets(dockets, str(tmp_path / "dockets"), "d", "2026-03-31")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "dockets")).select("recap_docket_id", "source_digest", "filing_year").collect()] == [("1", "d", 2020)]
    with pytest.raises(ValueError):
        publish.release_inventory({"a": b"123"}, ceiling=2)
    assert publish.release_inventory({"b": b"1", "a": b"22"})["bytes"] == 3
    assert publish.prohibited_columns(["district_code", "Docket_Number", "judge_name"]) == ["Docket_Number", "judge_name"]
    assert publish.export_provenance(["a"], {"x": "1"}, 2, "v1", "d") == publish.export_provenance(["a"], {"x": "1"}, 2, "v1", "d")


def test_archive_budgets_and_envelopes(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "0" * 1_000_000)
    monkeypatch.setattr(ingest, "MAX_RATIO", 10)
    with pytest.raises(ingest.IngestError):
        ingest.check_archive(str(tmp_path / "a.zip"))
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.7 body %%EOF\n")
    (tmp_path / "bad.pdf").write_bytes(b"<html>%%EOF")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))
    assert {r.path.rsplit("/", 1)[1]: r.valid for r in ingest.check_pdf(files).collect()} == {"good.pdf": True, "bad.pdf": False}
    data = (tmp_path / "good.pdf").read_bytes()
    ingest.verify_digest(str(tmp_path / "good.pdf"), len(data), hashlib.sha256(data).hexdigest())
    with pytest.raises(ingest.IngestError):
        ingest.verify_digest(str(tmp_path / "good.pdf"), len(data) + 1, hashlib.sha256(data).hexdigest())


def test_served_mart_prunes(spark):
    """A district and a span of years reach the files as partition and pushed filters."""
    rows = registry._mart(spark, SF)
    plan = rows.where("district_code = '07' AND filed_month >= DATE '1996-01-01'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(district_code), IsNotNull(filed_month), EqualTo(district_code,07)" in plan


def test_cube_json(spark, tmp_path):
    cells = spark.createDataFrame([("b", 2), ("a", 1)], "district_code string, n int")
    digest = cube.cube_json({"portfolio": cells}, str(tmp_path / "cube.json"))
    assert digest == cube.cube_json({"portfolio": cells.orderBy("n")}, str(tmp_path / "again.json"))
    assert (tmp_path / "cube.json").read_text() == '{"portfolio":[{"district_code":"a","n":1},{"district_code":"b","n":2}]}'
    assert metrics.as_markdown(metrics.standard_registry()).count("\n") > 14


def test_published_cells_put_totals_first_and_bands_by_age(spark):
    bands = ["5_years_or_more", None, "under_1_year", "2_to_5_years", "1_to_2_years"]
    cells = spark.createDataFrame([(d, b, 1) for d in ("02", None, "01") for b in bands], "district_code string, age_band string, n int")
    got = [(r.district_code, r.age_band) for r in cells.orderBy(*cube.publication_order(cells)).collect()]
    by_age = [None, "under_1_year", "1_to_2_years", "2_to_5_years", "5_years_or_more"]
    assert got == [(d, b) for d in (None, "01", "02") for b in by_age]


def test_partition_of_cases_and_exceptions(spark):
    facts = fixtures.facts(spark, SF)
    assert warehouse.cases(facts).count() + warehouse.identity_exceptions(facts).count() == facts.count()
    p = marts.portfolio_summary(facts, fixtures.promoted(facts)).agg(
        F.sum("total_records").alias("n"), F.sum(F.col("pending_records") + F.col("terminated_records")).alias("m")
    ).first()
    assert p["n"] == p["m"] == facts.count()


def test_repeated_promotions_do_not_multiply(spark):
    facts = fixtures.facts(spark, SF)
    p = fixtures.promoted(facts)
    assert warehouse.with_matches(facts, p.unionByName(p)).count() == facts.count()


def test_binomial_bound():
    assert abs(matching.binomial_lower_bound(800, 800) - 0.9953995) < 1e-6
    assert matching.binomial_lower_bound(0, 5) == 0.0
    assert matching.binomial_lower_bound(799, 800) < 0.995


def test_review_precision(spark):
    rows = lambda bad: spark.createDataFrame([("true_match",)] * (800 - bad) + [("false_match",)] * bad, "review_label string")
    assert matching.review_precision(rows(0))["passed"] and not matching.review_precision(rows(1))["passed"]
    with pytest.raises(ValueError):
        matching.review_precision(spark.createDataFrame([("maybe",)], "review_label string"))


def test_review_sample_covers_strata(spark):
    facts = fixtures.facts(spark, SF)
    pairs = matching.match_candidates(warehouse.cases(facts), fixtures.districts(spark, SF), fixtures.dockets(spark, SF))
    good = pairs.where("candidate_status = 'review_eligible'")
    out = matching.review_sample(pairs, 100).collect()
    assert [r.review_item for r in out] == list(range(1, 101))
    assert {r.court_id for r in out} == {r.court_id for r in good.select("court_id").distinct().collect()}


def test_tie_out_zero_cell(spark):
    own = spark.createDataFrame([("01", 2, 1, 1), ("TOTAL", 2, 1, 1)], "district_code string, filed long, terminated long, pending long")
    other = spark.createDataFrame([("01", 2, 0, 1), ("TOTAL", 2, 1, 1)], own.schema)
    out = {(r.district_code, r.measure): r for r in matching.tie_out(other, own).collect()}
    zero = out["01", "terminated"]
    assert zero.relative_difference is None and zero.passed is None
    assert zero.disposition == "retained_unresolved_district_diagnostic"
    assert out["TOTAL", "filed"].reason_code == "exact"


def public(spark):
    facts = fixtures.facts(spark, SF)
    return publish.public_rows(facts, fixtures.promoted(facts), F.left(F.sha2("source_record_identifier", 256), F.lit(22)), "v1")


def test_metrics_refuse(spark):
    rows, registry_ = public(spark), metrics.standard_registry(1)
    bad = [
        {"context": "nope", "measures": ["total_records"]},
        {"context": "portfolio", "measures": []},
        {"context": "portfolio", "measures": ["total_records; drop"]},
        {"context": "portfolio", "measures": ["total_records"], "dimensions": ["duration_days"]},
        {"context": "portfolio", "measures": ["total_records"], "limit": 0},
        {"context": "portfolio", "measures": ["total_records"], "limit": True},
        {"context": "portfolio", "measures": ["total_records"], "filters": [metrics.Filter("origin_code", "like", "1")]},
        {"context": "portfolio", "measures": ["total_records"], "filters": [metrics.Filter("origin_code", "in", [])]},
        {"context": "portfolio", "measures": ["total_records"], "filters": [metrics.Filter("origin_code", "eq", 1)]},
        {"context": "portfolio", "measures": ["total_records"], "filters": [metrics.Filter("origin_code", "between", ["1", "2"])]},
        {"context": "portfolio", "measures": ["total_records"], "filters": [metrics.Filter("origin_code", "in", ["1"] * 101)]},
        {"context": "portfolio", "measures": ["total_records"], "order_by": [("district_code", False)]},
    ]
    for request in bad:
        with pytest.raises(metrics.MetricError):
            registry_.query(rows, **request)
    assert registry_.query(rows, "portfolio", ["total_records"]).first()["total_records"] == 1500
    assert metrics.standard_registry(5000).query(rows, "portfolio", ["total_records"]).count() == 0


def test_pages(spark):
    rows = public(spark)
    spec = explorer.PageSpec(("release_record_key", "terminated_month"), sort="terminated_month", limit=200)
    first = explorer.page(rows, spec).collect()
    second = explorer.page(rows, explorer.PageSpec(spec.columns, sort="terminated_month", limit=200, offset=200)).collect()
    assert len({r[0] for r in first} & {r[0] for r in second}) == 0
    assert None not in [r[1] for r in first]
    for wrong in (dict(limit=201), dict(offset=-1), dict(sort="secret"), dict(columns=())):
        with pytest.raises(explorer.PageError):
            explorer.page(rows, explorer.PageSpec(**({"columns": spec.columns} | wrong)))
    with pytest.raises(explorer.PageError):
        explorer.detail(rows, "' OR 1=1")


def test_csv(spark):
    rows = spark.createDataFrame([("k2", '=un"safe'), ("k1", None)], "release_record_key string, v string")
    spec = explorer.PageSpec(("release_record_key", "v"), sort="release_record_key")
    assert explorer.csv_text(rows, spec) == '"release_record_key","v"\r\n"k1",""\r\n"k2","\'=un""safe"\r\n'


def test_keys_and_files(spark, tmp_path):
    secret = b"s" * 32
    rows = spark.createDataFrame([("a:1",), (None,)], "i string").select("i", publish.release_key(F.col("i"), "v1", secret).alias("k"))
    want = base64.urlsafe_b64encode(hmac.new(secret, b"v1\0v1\0a:1", hashlib.sha256).digest()[:16]).decode().rstrip("=")
    assert [r.k for r in rows.collect()] == [want, None]
    assert "ssss" not in rows._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        publish.release_key(F.col("i"), "v1", b"short")
    out = public(spark)
    publish.write_public(out, str(tmp_path / "mart"))
    back = spark.read.parquet(str(tmp_path / "mart")).select(*out.columns)
    assert publish.content_digest(out) == publish.content_digest(back)
    assert publish.manifest(out, "v1")["total_rows"] == 1500
    n = explorer.export_parquet(out, explorer.PageSpec(("release_record_key", "filed_month"), limit=500), str(tmp_path / "x"))
    assert n == 500


def test_public_violations_are_found(spark):
    rows = public(spark)
    check = lambda df: {r["rule"]: r["failures"] for r in publish.public_violations(df, "v1", fixtures.CUTOFF).collect()}
    assert not any(check(rows).values())
    out = check(rows.withColumn("duration_days", F.lit(-1)).withColumn("dataset_version", F.lit("v2")))
    assert out["duration"] == out["dataset_version"] == 1500 and out["key_unique"] == 0
    for column, rules in {
        "dataset_version": ["dataset_version"], "nature_of_suit_mapping_status": ["mapping_status", "code_null_rule"],
        "identity_quality_status": ["identity_status"], "source_snapshot_cutoff": ["source_cutoff"], "source_record_count": ["identity_count"],
        "pending_status": ["pending_semantics", "termination_null_rule"], "filed_month": ["filed_month"],
    }.items():
        out = check(rows.withColumn(column, F.lit(None).cast(rows.schema[column].dataType)))
        assert [out[r] for r in rules] == [1500] * len(rules), column
    assert check(rows.withColumn("docket", F.lit(1))) == {"schema": 1} == check(rows.drop("circuit_code"))
    assert check(rows.limit(0))["not_empty"] == 1


def test_triage_and_replay(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            ("03/04/2020", "L", "05/06/2021", None, "2021"),
            ("03/04/2009", "X", None, None, None),
            ("03/04/2031", "L", None, None, None),
            ("03/04/2021", None, None, None, None),
            ("03/04/2021", "S", "01/01/1900", None, "2099"),
        ],
        "FILEDATE string, STATUSCD string, TERMDATE string, TDATEUSE string, TAPEYEAR string",
    ).coalesce(1).withColumn("source_row_number", F.monotonically_increasing_id())
    run = ingest.load_snapshot(rows, str(tmp_path), "2010-01-01", "2026-03-31", "d1")
    assert (run["input"], run["accepted"], run["excluded"], run["rejected"], run["replayed"]) == (5, 2, 1, 2, False)
    assert ingest.load_snapshot(rows, str(tmp_path), "2010-01-01", "2026-03-31", "d1")["replayed"]
    quarantine = spark.read.parquet(str(tmp_path / "source_digest=d1" / "quarantine"))
    assert sorted(tuple(r) for r in quarantine.collect()) == [(2, "filed_after_snapshot"), (3, "invalid_status_sentinel")]
    assert quarantine.columns == ["source_row_number", "reason"]
    with pytest.raises(Exception):
        ingest.load_snapshot(rows.drop("TAPEYEAR"), str(tmp_path), "2010-01-01", "2026-03-31", "d2")
    assert (tmp_path / "failure-d2.json").exists() and not (tmp_path / "source_digest=d2.staging").exists()


def test_tsv(spark, tmp_path):
    header = ["A", "B", "C"]
    data = b"A\tB\tC\n1\t\xc3\xa9\tx\n2\t\xff\ty\n3\tb\t\xff\n4\tb\n"
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.txt", data)
    path = ingest.unpack(str(tmp_path / "t.zip"), str(tmp_path))
    assert ingest.read_header(str(tmp_path / "t.zip")) == (header, "\t")
    out = {r.A: r for r in ingest.read_tsv(spark, path, header, ["A", "B"]).collect()}
    assert out["1"].B == "é" and out["1"]._structural is None
    assert out["2"]._structural == "invalid_utf8" and out["3"]._structural is None and out["4"]._structural == "field_count"
    with pytest.raises(ingest.IngestError):
        ingest.read_tsv(spark, path, ["A", "B"], ["A"])
    assert [out[k].source_row_number for k in "1234"] == [0, 1, 2, 3]
    (tmp_path / "again.txt").write_bytes(b"A\tB\tC\n1\tx\ty\nA\tB\tC\n2\tx\ty\n" * 1 + b"z\tx\ty\n" * 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = ingest.read_tsv(spark, str(tmp_path / "again.txt"), header, ["A"]).orderBy("source_row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.source_row_number for r in rows] == list(range(5003)) and [r.A for r in rows[:4]] == ["1", "A", "2", "z"]


def test_planning():
    assert planning.mature_window(date(2020, 4, 1)) == (date(2016, 4, 2), date(2019, 4, 1))
    gates = [planning.Gate("error", "<=", 0.05), planning.Gate("n", ">=", 200)]
    assert planning.evaluate_gates(gates, {"error": 0.01, "n": 300})["passed"]
    assert not planning.evaluate_gates(gates, {"error": float("nan"), "n": 300})["passed"]
    assert not planning.evaluate_gates(gates, {"n": 300})["passed"]
    assert planning.loosened(gates, [planning.Gate("error", "<=", 0.06), gates[1]]) == ["error"]
    with pytest.raises(PermissionError):
        planning.guard_outcome_access(date(2030, 1, 1), date(2024, 1, 1))


def test_registry_is_complete():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 80
