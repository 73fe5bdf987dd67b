"""Steps that several uses share are made once and read from files."""

from tallyforge.operators import upkeep
from tallyforge.plans import evaluation, fixtures, registry

SF = "/root/testdata/sf0.001"


def made(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_written_before_they_are_matched(spark):
    facts, promoted = registry._facts_and_matches(spark, SF)
    assert "Join" not in made(facts) and "Join" not in made(promoted)
    plain = fixtures.facts(spark, SF)
    assert not facts.exceptAll(plain).count() and not plain.exceptAll(facts).count()


def test_cases_are_written_before_training(spark):
    assert "Join" not in made(evaluation._cases(spark, SF))


def test_a_load_counts_once(spark, tmp_path):
    rows = fixtures.records(spark, SF)
    store = upkeep.FactStore(spark, f"{tmp_path}/facts")
    store.load(rows.where("o_orderkey % 2 = 0"), "a")
    store.load(rows.where("o_orderkey % 4 > 0"), "b")
    counted, gone = (spark.read.parquet(f"{tmp_path}/facts/load-1/{x}") for x in ("counted", "gone"))
    stays = counted.where("_was <=> source_record_count")
    assert not gone.join(stays, upkeep.ID).count() and counted.count() >= rows.where("o_orderkey % 4 > 0").count()
    assert store.facts().count() == rows.count()
