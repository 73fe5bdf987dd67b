"""Extracts in ordered parts: rows are numbered through all of them, and no task has them all."""

from pyspark.sql import functions as F

from tallyforge.sources import archives, ingest
from tallyforge.sources.shared import write_parts


def test_rows_are_numbered_through_parts(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k")).select("k", F.concat_ws("\t", "k", F.lit("x")).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_parts(rows, "k", "a\tb", f"{tmp_path}/parts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.text(f"{tmp_path}/parts").inputFiles()) == 4
    got = ingest.read_tsv(spark, f"{tmp_path}/parts", ["a", "b"], ["a"], parts=True).collect()
    assert sorted((r.source_row_number, r.a, r._structural) for r in got) == [(i, str(i), None) for i in range(2000)]
    apart = ingest.read_tsv(spark, f"{tmp_path}/parts", ["a", "b"], ["a"])
    assert apart.where("source_row_number = 0").count() == 4


def test_records_are_numbered_through_parts(spark, tmp_path):
    note = F.when(F.col("k") % 3 == 0, F.concat(F.lit('"a\n'), F.col("k").cast("string"), F.lit('\n,b"'))).otherwise(F.col("k").cast("string"))
    rows = spark.range(300).select((F.col("id") * 7 % 300).alias("k")).select("k", F.concat_ws(",", "k", note).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_parts(rows, "k", "id,note", f"{tmp_path}/parts", "bzip2")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = archives.read_csv(spark, f"{tmp_path}/parts", ["id"], parts=True)
    assert got.select("file").distinct().count() == 4
    assert sorted((r.source_row_number, r.id, r.note) for r in got.collect()) == [(i + 1, str(i), f"a\n{i}\n,b" if i % 3 == 0 else str(i)) for i in range(300)]
