"""Footers, byte-identical layouts, verified copies, deep pages and inferred schemas."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import explorer, publish, storage
from tallyforge.plans import fixtures, registry
from tallyforge.sources import drift

SF = "/root/testdata/sf0.001"


def test_footers_of_the_written_mart(spark, tmp_path):
    rows = registry._public(spark, SF)
    publish.write_public(rows, f"{tmp_path}/mart")
    foot = storage.footers(spark, f"{tmp_path}/mart")
    own = foot.where("column = 'district_code'").collect()
    assert sum(r.row_group_rows for r in own) == rows.count() and {r.codec for r in own} == {"ZSTD"}
    first = pq.read_metadata(own[0].file.removeprefix("file:")).row_group(own[0].row_group)
    assert first.num_rows == own[0].row_group_rows
    faults = {r.fault: r.row_groups for r in storage.layout_faults(foot, "district_code", publish.ROW_GROUP_ROWS, "ZSTD").collect()}
    assert faults == {"too_many_rows": 0, "codec": 0, "order": 0}
    faults = {r.fault: r.row_groups for r in storage.layout_faults(foot, "district_code", 0, "SNAPPY").collect()}
    assert faults["too_many_rows"] == faults["codec"] == len(own)
    year = spark.read.parquet(f"{tmp_path}/mart").agg(F.min("filing_year")).first()[0]
    pruned = spark.read.parquet(f"{tmp_path}/mart").where((F.col("filing_year") == year) & (F.col("district_code") == "07"))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(filing_year" in plan and "EqualTo(district_code,07)" in plan


def test_order_faults_are_found(spark):
    rows = [("f", 0, 5, "c", "ZSTD", 1, "a", "m", 0), ("f", 1, 5, "c", "ZSTD", 1, "k", "z", 0)]
    out = storage.layout_faults(spark.createDataFrame(rows, storage.FOOTER), "c", 5, "ZSTD").collect()
    assert {r.fault: r.row_groups for r in out} == {"too_many_rows": 0, "codec": 0, "order": 1}


def contents(path):
    return {p.name: p.read_bytes() for p in Path(path).iterdir()}


def test_equal_rows_give_equal_files(spark, tmp_path):
    """Under another partitioning and order, with ties, nulls and repeated rows; a changed row changes one file."""
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("v"), F.lit("x").alias("t"))
    one = storage.write_fixed(rows.repartition(2), f"{tmp_path}/a", ["k"], 300, 128)
    many = storage.write_fixed(rows.repartition(9, "v").orderBy(F.desc("v")), f"file:{tmp_path}/b", ["k"], 300, 128)
    assert contents(f"{tmp_path}/a") == contents(f"{tmp_path}/b")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert [r.rows for r in one.orderBy("file_number").collect()] == [300, 300, 300, 100]
    meta = pq.read_metadata(f"{tmp_path}/a/part-00000000.parquet")
    assert [meta.row_group(g).num_rows for g in range(3)] == [128, 128, 44]
    back = spark.read.parquet(f"{tmp_path}/a")
    assert storage.value_digest(back) == storage.value_digest(rows)
    storage.write_fixed(rows.withColumn("t", F.when(F.col("k") == 6, "y").otherwise("x")), f"{tmp_path}/c", ["k"], 300, 128)
    changed = contents(f"{tmp_path}/c")
    assert [n for n, data in sorted(contents(f"{tmp_path}/a").items()) if changed[n] != data] == ["part-00000002.parquet", "part-00000003.parquet"]
    assert storage.write_fixed(rows.limit(0), f"{tmp_path}/d", ["k"]).collect() == []


def test_a_task_writes_many_files(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    made = storage.write_fixed(rows, f"{tmp_path}/many", ["k"], 10, 4)
    assert len(made.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert [(r.file_number, r.rows) for r in made.orderBy("file_number").collect()] == [(i, 10) for i in range(500)]
    assert pq.read_table(f"{tmp_path}/many/part-00000123.parquet").column("k").to_pylist() == list(range(1230, 1240))


def test_a_changed_value_or_type_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, None, "a")], "a int, b int, c string")
    before = storage.copy_verified(rows, f"{tmp_path}/good")
    assert before["rows"] == 3 and storage.value_digest(rows.repartition(3).orderBy(F.desc("b"))) == before
    for wrong, what in (
        (rows.withColumn("c", F.when(F.col("b") == 1, "z").otherwise(F.col("c"))), "sums"), (rows.withColumn("a", F.col("a").cast("long")), "types"),
        (rows.distinct(), "rows"), (rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"), "sums"),
    ):
        with pytest.raises(storage.StorageError, match=what):
            storage.verify_copy(wrong, before)


@pytest.mark.parametrize("sort,descending", [("filed_month", False), ("terminated_month", True), ("duration_days", False), ("district_code", True), ("event_observed", False), ("release_record_key", True)])
def test_deep_pages_equal_sorted_ones(spark, sort, descending):
    rows = registry._mart(spark, SF)
    n = rows.count()
    for offset in (0, 700, n - 30, n + 5):
        spec = explorer.PageSpec(("release_record_key", sort) if sort != "release_record_key" else (sort,), sort=sort, descending=descending, limit=60, offset=offset)
        assert explorer.deep_page(rows, spec, sorted_rows=20).collect() == explorer.page(rows, spec).collect(), (sort, offset)


def test_a_deep_page_sorts_only_its_range(spark):
    rows = registry._mart(spark, SF)
    (part,) = explorer.seek(rows, [("duration_days", False), (explorer.KEY, False)], 700, 1, sorted_rows=50)
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan or "Filter" in plan
    assert part.count() == 1


def test_drift_is_reported(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c,d\n" + "1,2,2001-01-01,\n" * 500 + "1.5,2,2001-01-02,\n")
    found = drift.inferred(spark, f"{tmp_path}/x.csv", "csv")
    rows = {r.column: (r.change, r.agreed, r.found) for r in drift.drift(spark, found, "a int, b bigint, c date, e string").collect()}
    assert rows == {"a": ("widened", "int", "double"), "b": ("narrowed", "bigint", "int"), "d": ("added", None, "string"), "e": ("lost", "string", None)}
    with pytest.raises(ValueError, match="a widened"):
        drift.scan(spark, f"{tmp_path}/x.csv", "csv", "a int, b int, c date, d string")
    out = drift.scan(spark, f"{tmp_path}/x.csv", "csv", "a double, b bigint, c date, d string")
    assert out.count() == 501 and dict(out.dtypes)["b"] == "bigint"
    (tmp_path / "y.json").write_text('{"a": 1, "n": {"x": 1}}\n{"a": "two", "n": {"x": 1.5}}\n')
    found = drift.inferred(spark, f"{tmp_path}/y.json", "json")
    rows = {r.column: r.change for r in drift.drift(spark, found, "a bigint, n struct<x:bigint>").collect()}
    assert rows == {"a": "widened", "n": "changed"}
    assert drift.drift(spark, found, "a string, n struct<x:double>").collect() == []
