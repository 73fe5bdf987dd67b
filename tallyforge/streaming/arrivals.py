"""Incremental arrivals: new files of raw rows are triaged as they come.

Each file is read once, whatever happens in between; accepted and rejected rows
go to one table by outcome. Identity counts span all arrivals of a snapshot, so
they are made from the finished table and not inside the stream.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyforge.sources.ingest import triage


def triage_arrivals(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, start: str, cutoff: str
) -> StreamingQuery:
    """Takes in what has arrived in ``source`` since the last call and stops; the checkpoint remembers."""
    rows = spark.readStream.schema(schema).parquet(source)
    return (
        triage(rows, start, cutoff)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("outcome")
        .trigger(availableNow=True)
        .start()
    )
