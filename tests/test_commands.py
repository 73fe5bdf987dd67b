"""The command line, and small helpers of staging and release."""

import bz2
import json
from datetime import date, datetime

import pytest

from tallyforge.__main__ import main
from tallyforge.operators import planning, publish
from tallyforge.plans import evaluation, fixtures
from tallyforge.sources import ingest

SF = "/root/testdata/sf0.001"


def test_dockets_from_a_compressed_extract(spark, tmp_path):
    head = "id,court_id,blocked,federal_dn_case_type,federal_dn_office_code,docket_number_core,date_filed,date_terminated\n"
    rows = '1,c1,f,cv,1,0000001,1999-02-03,"2000-01-01"\n2,c2,f,cv,1,0000002,1999-02-03,\n3,c1\n4,c1,f,cv,1,0000004,2000-02-03,\n'
    (tmp_path / "d.csv.bz2").write_bytes(bz2.compress((head + rows).encode()))
    main(["dockets", f"{tmp_path}/d.csv.bz2", f"{tmp_path}/out", "--courts", "c1", "--start", "1999-01-01", "--end", "2000-12-31", "--cutoff", "2001-01-01", "--digest", "x"])
    good = spark.read.parquet(f"{tmp_path}/out/accepted").orderBy("recap_docket_id").collect()
    assert [(r.recap_docket_id, r.filing_year, r.source_row_number, r.terminated_date) for r in good] == [("1", 1999, 1, date(2000, 1, 1)), ("4", 2000, 4, None)]
    bad = spark.read.parquet(f"{tmp_path}/out/rejected").collect()
    assert {(r.source_row_number, r.reason) for r in bad} == {(2, "court_not_selected"), (3, "field_count")}


def test_evaluate_prints_each_fold(spark, tmp_path, capsys):
    fixtures.cases(fixtures.facts(spark, SF)).write.parquet(f"{tmp_path}/cases")
    fold = evaluation.FOLDS[0]
    text = ":".join([fold.name, *["..".join(w) for w in (fold.train, fold.validate, fold.assess)]])
    main(["evaluate", f"{tmp_path}/cases", "--fold", text, "--grid", "30,365,730", "--training-cases", "5", "--certify-cases", "3"])
    (line,) = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert json.loads(line)["fold"] == fold.name and json.loads(line)["eligible_cases"] > 0


def test_other_commands(spark, tmp_path, capsys):
    main(["queries"])
    assert "portfolio_summary" in capsys.readouterr().out.split()
    main(["registry"])
    assert json.loads(capsys.readouterr().out)
    main(["run", "dim_nature_of_suit", SF, f"{tmp_path}/dim"])
    assert spark.read.parquet(f"{tmp_path}/dim").count() == 93
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", SF, f"{tmp_path}/x"])


def test_small_stages(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"source_row_number": 3, "reason": "field_count"}\n{"source_row_number": 9}\n')
    assert sorted(map(tuple, ingest.read_rejects(spark, f"{tmp_path}/r.json").collect())) == [(3, "field_count"), (9, None)]
    rows = spark.createDataFrame([(" 01 ", "court01 ", " a", 1)], "district_code string, court_id string, ao_label string, more int")
    assert [tuple(r) for r in ingest.stage_districts(rows).collect()] == [("01", "court01", "a")]
    rows = spark.createDataFrame([(1, 2, 3, "exact", "2001-02-03 04:05:06", "x")], "case_identifier int, source_record_identifier int, recap_docket_id int, match_rule_id string, review_completed_at_utc string, y string")
    assert [tuple(r) for r in ingest.stage_promoted(rows).collect()] == [("1", "2", "3", "exact", datetime(2001, 2, 3, 4, 5, 6))]
    assert planning.milestone_availability(rows, ["y"]) == {"status": "available", "missing_fields": []}
    assert planning.milestone_availability(rows, ["z", "y"]) == {"status": "unavailable", "reason": "required_fields_missing", "missing_fields": ["z"]}


def test_manifests_that_do_not_fit():
    part = {"filing_year": 1999, "rows": 5, "digest": "0123456789abcdef"}
    good = {"dataset_version": "v1", "partitions": [part], "total_rows": 5}
    assert publish.compatible_manifest(good, "v1", [1999]) == []
    assert publish.compatible_manifest(good, "v2", [1999, 2000]) == ["dataset_version", "partitions"]
    assert publish.compatible_manifest(good | {"total_rows": 6, "partitions": [part | {"digest": "x"}]}, "v1", [1999]) == ["total_rows", "digest"]
    assert publish.compatible_manifest({}, "v1", []) == ["dataset_version", "total_rows"]
