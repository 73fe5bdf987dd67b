"""Incremental upkeep against a full rebuild, and what it leaves alone."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import upkeep, warehouse
from tallyforge.plans import fixtures

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(store):
    return {y: sorted((p.name, p.stat().st_mtime_ns) for p in Path(f.removeprefix("file:")).iterdir() if p.suffix == ".parquet") for y, f in store.folders().items()}


def snapshots(spark):
    """Three snapshots: the second revises keys and filing years of rows of the first, the third adds to shared keys and takes a collision apart."""
    r = fixtures.records(spark, SF)
    k = F.col("o_orderkey")
    first = r.where(k % 4 < 2)
    second = r.where(k % 4 == 2).unionByName(
        r.where(k % 20 == 0).withColumn("docket_number", F.lit("shared")).withColumn("circuit_code", F.lit("1")).withColumn("office_code", F.lit("1"))
    ).unionByName(r.where(k % 100 == 1).withColumn("filed_date", F.add_months("filed_date", 12)))
    third = r.where((k % 4 == 3) & (F.year("filed_date") == 1996)).unionByName(r.where(k % 60 == 0))
    return [("a", first), ("b", second), ("c", third)]


def test_equals_a_full_rebuild_after_three_snapshots(spark, tmp_path):
    store, whole = upkeep.FactStore(spark, f"{tmp_path}/facts"), None
    for digest, records in snapshots(spark):
        years = store.load(records, digest)
        whole = records if whole is None else whole.join(records.select(upkeep.ID), upkeep.ID, "left_anti").unionByName(records)
        want = warehouse.statistical_records(whole)
        assert rows_of(store.facts()) == rows_of(want.select(*store.facts().columns))
        assert rows_of(store.mart()) == rows_of(upkeep.summed(upkeep.contributions(want, 1)))
        assert years
    assert store.facts().where("source_record_count > 1").count() > 3
    before = files(store)
    assert store.load(snapshots(spark)[0][1], "a") == [] and files(store) == before


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    store = upkeep.FactStore(spark, f"{tmp_path}/facts")
    records = fixtures.records(spark, SF)
    store.load(records.where("o_orderkey % 4 < 2"), "a")
    before = files(store)
    one = records.where("o_orderkey % 4 = 2 AND year(filed_date) = 1997").limit(3).withColumn("docket_number", F.concat(F.lit("new-"), "o_orderkey"))
    assert store.load(one, "b") == ["1997"]
    after = files(store)
    assert {y for y in after if after[y] != before.get(y)} == {"1997"}


def test_failed_and_refused_loads_leave_the_state(spark, tmp_path):
    store = upkeep.FactStore(spark, f"{tmp_path}/facts")
    with pytest.raises(ValueError, match="nothing is loaded"):
        store.facts()
    records = fixtures.records(spark, SF).where("o_orderkey < 100")
    store.load(records, "a")
    state = rows_of(store.facts())
    with pytest.raises(ValueError, match="repeats"):
        store.load(records.unionByName(records), "b")
    with pytest.raises(Exception):
        store.load(records.withColumn("filed_date", F.raise_error(F.lit("lost")).cast("date")), "c")
    assert rows_of(store.facts()) == state
    assert store.load(records.where("false"), "d") == [] and rows_of(store.facts()) == state
    moved = records.withColumn("filed_date", F.to_date(F.lit("2003-01-05"))).withColumn("event_observed", F.lit(False))
    store.load(moved, "e")
    assert set(store.folders()) == {"2003"}  # years that no row is left in are gone
