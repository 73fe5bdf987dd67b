"""Arrivals are taken in once, with the same outcomes as in one batch."""

from tallyforge.plans.registry import raw_rows
from tallyforge.sources.ingest import triage
from tallyforge.streaming.arrivals import triage_arrivals


def test_arrivals(spark, tmp_path):
    rows = raw_rows(spark, "/root/testdata/sf0.001")
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in range(2):
        rows.where(f"cast(source_row_number as long) % 2 = {part}").write.mode("append").parquet(source)
        for _ in range(2):  # the second call finds nothing new
            triage_arrivals(spark, source, rows.schema, target, mark, "1996-01-01", "2000-12-31").awaitTermination()
    got = {(r.outcome, r.reason): r["count"] for r in spark.read.parquet(target).groupBy("outcome", "reason").count().collect()}
    want = triage(rows, "1996-01-01", "2000-12-31").groupBy("outcome", "reason").count().collect()
    assert got == {(r.outcome, r.reason): r["count"] for r in want}
