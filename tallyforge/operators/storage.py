"""Written Parquet as data: footers as a table, a layout whose files come out byte by byte the same, and verified copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.shared import arrow_files, files_under, written


class StorageError(ValueError):
    """Files that are not as they should be."""


# Footers

FOOTER = (
    "file string, row_group int, row_group_rows long, column string, codec string, compressed_bytes long, "
    "least string, greatest string, nulls long"
)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    names = [c.split()[0] for c in FOOTER.split(", ")]
    for batch in batches:
        for file in batch.column(0).to_pylist():
            fs, at = arrow_files(file)
            rows = []
            with fs.open_input_file(at) as f:
                meta = pq.read_metadata(f)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    own = group.column(c)
                    s = own.statistics
                    ends = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                    rows.append((file, g, group.num_rows, own.path_in_schema, own.compression, own.total_compressed_size, *ends, s.null_count if s is not None else None))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column of each row group of all Parquet files under a path. Tasks read footers, no data."""
    files = [(f,) for f, _ in files_under(spark, path) if f.endswith(".parquet")]
    listed = spark.createDataFrame(files, "file string").repartition(max(1, min(len(files), 1000)))
    return listed.mapInArrow(_footers, FOOTER)


def layout_faults(footer: DataFrame, sorted_by: str, most_rows: int, codec: str) -> DataFrame:
    """(fault, row_groups): row groups with too many rows or another codec, and those that begin before the one ahead of them ends.

    The order is that of the column's statistics as text.
    """
    from pyspark.sql import Window as W

    ahead = W.partitionBy("file", "column").orderBy("row_group")
    own = footer.where(F.col("column") == sorted_by).withColumn("_end", F.lag("greatest").over(ahead))
    counts = own.agg(
        F.count_if(F.col("row_group_rows") > most_rows).alias("too_many_rows"),
        F.count_if(F.col("codec") != codec).alias("codec"),
        F.count_if(F.col("least") < F.col("_end")).alias("order"),
    )
    return counts.unpivot([], ["too_many_rows", "codec", "order"], "fault", "row_groups")


# Layout


def _writer(path: str, columns: list[str], group_rows: int):
    """Writes the files that a task's rows, which come in order, are of; one row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        fs, at = arrow_files(path)
        schema = number = writer = sink = None
        made, rows, held, held_rows = "", 0, [], 0

        def group(n: int) -> None:
            nonlocal held, held_rows
            table = pa.Table.from_batches(held).combine_chunks()
            writer.write_table(table.slice(0, n), row_group_size=group_rows)
            rest = table.slice(n)
            held, held_rows = rest.to_batches(), rest.num_rows

        def close() -> pa.RecordBatch:
            if held_rows:
                group(held_rows)
            writer.close()
            sink.close()
            digest, size = hashlib.sha256(), 0
            with fs.open_input_stream(made) as f:
                while block := f.read(1 << 22):
                    digest.update(block)
                    size += len(block)
            name = f"part-{number:08d}.parquet"
            fs.move(made, f"{at}/{name}")  # another attempt's file would be the same
            return pa.RecordBatch.from_pydict(
                {"file_number": pa.array([number], pa.int64()), "file": [name], "rows": [rows], "bytes": [size], "sha256": [digest.hexdigest()]}
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                fs.create_dir(at, recursive=True)
                schema = pa.schema([batch.schema.field(c).remove_metadata() for c in columns])
            own = pa.RecordBatch.from_arrays([batch.column(c) for c in columns], schema=schema)
            of = batch.column("_file").to_numpy()
            ends = [*(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if of[start] != number:
                    if number is not None:
                        yield close()
                    number, rows = int(of[start]), 0
                    made = f"{at}/.part-{number:08d}.parquet-{TaskContext.get().taskAttemptId()}"
                    sink = fs.open_output_stream(made)
                    writer = pq.ParquetWriter(sink, schema, compression="zstd", write_statistics=True, store_schema=False)
                held.append(own.slice(start, end - start))
                held_rows, rows = held_rows + int(end - start), rows + int(end - start)
                while held_rows >= group_rows:
                    group(group_rows)
        if number is not None:
            yield close()

    return run


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``_rank``, their place from 0 in the order of the keys and then of all columns; no row meets all others.

    Ranges are sorted apart and written with their rows' numbers; a range's
    first rank is a running sum over the ranges' counts.
    """
    from pyspark.sql import Window as W

    order = [*keys, *[c for c in rows.columns if c not in keys]]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ordered.withColumn("_n", F.monotonically_increasing_id()), "ranked")
    part, inside = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    first = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    return numbered.withColumn("_part", part).join(first, "_part").select(*rows.columns, (F.col("_first") + inside).alias("_rank"))


#: Rows of the consecutive files that one task writes, if there are more files than tasks.
TASK_ROWS = 1 << 19


def write_fixed(rows: DataFrame, path: str, keys: list[str], file_rows: int = 1 << 22, group_rows: int = 1 << 17) -> DataFrame:
    """Writes files that depend on the rows alone; returns (file_number, file, rows, bytes, sha256) of each.

    Every file holds the same number of consecutive ranks, in row groups of a
    fixed size and under a fixed name. However the rows are dealt, equal rows
    give equal files. A task writes consecutive files one after the other, so
    the number of tasks follows that of the rows and not that of the files.
    """
    placed = ranked(rows, keys).withColumn("_file", F.floor(F.col("_rank") / file_rows).cast("long"))
    n = placed.count()
    files = max(1, -(-n // file_rows))
    tasks = min(files, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    run = -(-files // tasks)
    dealt = placed.repartitionById(-(-files // run), F.floor(F.col("_file") / run).cast("int")).sortWithinPartitions("_rank").drop("_rank")
    made = dealt.mapInArrow(_writer(path, rows.columns, group_rows), "file_number long, file string, rows long, bytes long, sha256 string")
    return written(made, "files")


# Verified copies


def value_digest(rows: DataFrame) -> dict:
    """Types, number of rows, and two sums over the rows' hashes, which do not depend on order: equal for equal multisets of rows."""
    marks = [F.col(c).isNull() for c in rows.columns]  # a null is passed over by the hash of values
    one, two = F.xxhash64(*rows.columns, *marks), F.xxhash64(*marks, *reversed(rows.columns))
    out = rows.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("a"), F.sum(two.cast("decimal(20,0)")).alias("b")).first()
    return {"types": rows.dtypes, "rows": out["n"], "sums": (int(out["a"] or 0), int(out["b"] or 0))}


def copy_verified(rows: DataFrame, path: str) -> dict:
    """Writes rows as Parquet and reads them back; types, number and values must be those of the rows. Returns their digest."""
    before = value_digest(rows)
    rows.write.mode("errorifexists").parquet(path)
    verify_copy(rows.sparkSession.read.parquet(path), before)
    return before


def verify_copy(back: DataFrame, before: dict) -> None:
    after = value_digest(back)
    wrong = [k for k in before if before[k] != after[k]]
    if wrong:
        raise StorageError(f"the copy does not read back as written: {', '.join(wrong)} differ")
