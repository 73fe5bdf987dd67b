"""Compressed extracts as distributed sources: members of ZIP archives, and CSV records of (bz2) text.

``zip_lines`` is a Spark data source with one partition for each member. Only
the archives' directories are read where the query is planned; executors inflate
the members, and what they inflate is held against the budgets as it comes,
whatever the directory claims.

``csv_records`` reads text files, compressed by a codec that Spark can split or
not, line by line and in parallel, and puts records with quoted line breaks
together: a line starts a record if the quotes before it are even. Quotes and
records are counted by block as they are read, so a line's place needs a running
sum over the blocks' counts only. Lines of a record of more than one line meet by
number; all others stay where they are.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyforge.sources.ingest import MAX_EXPANDED_BYTES, MAX_MEMBERS, MAX_RATIO, IngestError
from tallyforge.sources.shared import arrow_files, written

#: Bytes of a line, and lines and bytes of a record.
MAX_LINE_BYTES, MAX_RECORD_LINES, MAX_RECORD_BYTES = 1 << 20, 10_000, 8 << 20

# ZIP archives


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    packed: int


def within_budget(expanded: int, packed: int, most: int = MAX_EXPANDED_BYTES, ratio: int = MAX_RATIO) -> None:
    if expanded > most or expanded > ratio * max(packed, 4096):
        raise IngestError("the archive exceeds its budgets")


class ZipReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, most: int, ratio: int):
        self.path, self.pattern, self.most, self.ratio = path, pattern, most, ratio

    def partitions(self) -> list[Member]:
        from pyarrow import fs as pafs

        fs, at = arrow_files(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
            archives = sorted(f.path for f in found if f.is_file and f.path.endswith(".zip"))
        else:
            archives = [at]
        out: list[Member] = []
        for archive in archives:
            with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                members = [m for m in z.infolist() if not m.is_dir()]
                if len(members) > MAX_MEMBERS:
                    raise IngestError("the archive exceeds its budgets")
                within_budget(sum(m.file_size for m in members), sum(m.compress_size for m in members), self.most, self.ratio)
                out += [Member(archive, m.filename, m.compress_size) for m in members if re.search(self.pattern, m.filename)]
        return out or [Member("", "", 0)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = arrow_files(self.path)
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            number, expanded = 0, 0
            while lines := member.readlines(4 << 20):
                expanded += sum(map(len, lines))
                within_budget(expanded, partition.packed, self.most, self.ratio)
                if max(map(len, lines)) > MAX_LINE_BYTES:
                    raise IngestError("a line exceeds its budget")
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.archive.rsplit("/", 1)[-1]] * n),
                        pa.array([partition.name] * n),
                        pa.array(range(number, number + n), pa.int64()),
                        pa.array([x.rstrip(b"\r\n") for x in lines], pa.binary()),
                    ],
                    names=["archive", "member", "line", "value"],
                )
                number += n


class ZipLines(DataSource):
    """``spark.read.format("zip_lines").load(path)``: (archive, member, line, value) of an archive or of all in a folder.

    Options: ``members`` (a pattern of names; by default tables), ``maxBytes`` and ``maxRatio`` of an archive or member.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, line long, value binary"

    def reader(self, schema) -> ZipReader:
        o = self.options
        return ZipReader(
            o["path"], o.get("members", r"\.(txt|tsv|csv)$"), int(o.get("maxbytes", MAX_EXPANDED_BYTES)), int(o.get("maxratio", MAX_RATIO))
        )


def zip_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").options(**options).load(path)


def tsv_fields(lines: DataFrame, header: list[str], selected: list[str]) -> DataFrame:
    """(archive, member, selected columns, source_row_number, _structural) of numbered lines of tables with one header.

    A member's first line must be the header; else it is a row with the reason
    ``header``. Later lines are judged by their number of fields and the bytes
    of selected fields.
    """
    # These functions work on bytes, so a field keeps what the member holds, valid or not.
    text = F.col("value").cast("string")
    raw = {c: F.substring_index(F.substring_index(text, "\t", header.index(c) + 1), "\t", -1) for c in selected}
    fields = F.octet_length("value") - F.octet_length(F.replace(text, F.lit("\t"), F.lit(""))) + 1
    bad = F.lit(False)
    for c in raw.values():
        bad = bad | ~F.is_valid_utf8(c)
    first = F.col("line") == 0
    right = F.col("value") == F.lit(bytearray("\t".join(header).encode()))
    reason = F.when(first, "header").when(fields != len(header), "field_count").when(bad, "invalid_utf8")
    values = [F.nullif(F.try_validate_utf8(v), F.lit("")).alias(c) for c, v in raw.items()]
    return lines.where(~(first & right)).select(
        "archive", "member", *values, (F.col("line") - 1).alias("source_row_number"), reason.alias("_structural")
    )


# CSV records


def _counted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a line's place in its block, whether the quotes before it there are even, and the even lines up to it."""
    block, n, quotes, even = None, 0, 0, 0
    for batch in batches:
        of = pc.struct_field(batch.column("_block"), [1]).to_numpy()
        file = batch.column("_block").field(0)
        starts = [0] if batch.num_rows else []
        if batch.num_rows > 1:
            new = (of[1:] != of[:-1]) | pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
            starts += (np.flatnonzero(new) + 1).tolist()
        q = batch.column("_q").to_numpy()
        places, evens, seen = [], [], []
        for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            at = (file[i].as_py(), int(of[i]))
            if at != block:
                block, n, quotes, even = at, 0, 0, 0
            before = quotes + np.cumsum(q[i:j]) - q[i:j]
            own = before % 2 == 0
            places.append(np.arange(n, n + j - i))
            evens.append(own)
            seen.append(even + np.cumsum(own))
            n, quotes, even = n + j - i, quotes + int(q[i:j].sum()), int(seen[-1][-1])
        if places:
            more = (pa.array(np.concatenate(places)), pa.array(np.concatenate(evens)), pa.array(np.concatenate(seen).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_place", "_even", "_seen"])


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, line, starts, record, alone): every line with its number and its record's, both from 0 in its file.

    ``starts`` says whether the line is its record's first, ``alone`` whether it
    is the whole record. The text is decompressed once, into a written table that
    all further steps read. Lines are counted where they are read, in their
    order; of blocks, only the counts meet.
    """
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_block")
    )
    size = F.octet_length("value")
    lines = lines.withColumn("value", F.when(size <= MAX_LINE_BYTES, F.col("value")).otherwise(F.raise_error(F.lit("a line exceeds its budget"))))
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")
    lines = lines.withColumn("_q", quotes)
    schema = T.StructType([*lines.schema, T.StructField("_place", T.LongType()), T.StructField("_even", T.BooleanType()), T.StructField("_seen", T.LongType())])
    lines = written(lines.mapInArrow(_counted_lines, schema), "lines").select("*", F.col("_block.file").alias("file"), F.col("_block.start").alias("_start")).drop("_block")
    # Of a block: its lines, its quotes, and its record starts if the quotes before the block are even, or odd.
    blocks = lines.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.sum("_q").alias("_quotes"), F.count_if("_even").alias("_starts_even"))
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_odd", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1)
    blocks = blocks.withColumn("_starts", F.when(F.col("_odd"), F.col("_n") - F.col("_starts_even")).otherwise(F.col("_starts_even")))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    blocks = blocks.select("file", "_start", "_odd", total("_n").alias("_lines"), total("_starts").alias("_records"))
    placed = lines.join(F.broadcast(blocks), ["file", "_start"]).withColumn("starts", F.col("_even") != F.col("_odd"))  # a row a block
    seen = F.when(F.col("_odd"), F.col("_place") + 1 - F.col("_seen")).otherwise(F.col("_seen"))
    return placed.select(
        "file", "value", (F.col("_lines") + F.col("_place")).alias("line"), "starts", (F.col("_records") + seen - 1).alias("record"),
        (F.col("starts") & (F.col("_q") % 2 == 0)).alias("alone"),
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text, too_long, earlier): each CSV record whole, with its number in its file (the header's is 0).

    A record of too many lines or bytes, as after a quote that is never closed,
    has no text and is marked. ``earlier`` counts the records of files with
    earlier names, a header each left out.
    """
    lines = written(placed_lines(spark, path), "placed")
    single = lines.where("alone").select("file", "record", F.col("value").alias("text"), F.lit(False).alias("too_long"))
    several = lines.where("NOT alone")
    sizes = several.groupBy("file", "record").agg(F.count("*").alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    fits = (F.col("_n") <= MAX_RECORD_LINES) & (F.col("_bytes") <= MAX_RECORD_BYTES)
    over = sizes.where(~fits).select("file", "record")
    joined = several.join(over, ["file", "record"], "left_anti").groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text")
    )
    records = (
        single.unionByName(joined.withColumn("too_long", F.lit(False)))
        .unionByName(over.select("file", "record", F.lit(None).cast("string").alias("text"), F.lit(True).alias("too_long")))
    )
    ahead = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    files = lines.where("starts").groupBy("file").agg(F.count("*").alias("_n"))
    files = files.select("file", F.coalesce(F.sum(F.col("_n") - 1).over(ahead), F.lit(0)).alias("earlier"))
    return records.join(F.broadcast(files), "file")


def read_csv(spark: SparkSession, path: str, required: list[str], parts: bool = False) -> DataFrame:
    """All columns of the header as strings, ``source_row_number`` (from 1) and ``_structural``, the reason of a reject.

    The header's columns may come in any order, but the required ones must be there and all files must have the same.
    Rows are numbered in each file or, where the files are parts of one table in the order of their names, through all parts.
    """
    first = spark.read.text(path).limit(1).collect()
    header = next(iter(_fields(first[0][0]))) if first else []
    if missing := sorted(set(required) - set(header)):
        raise IngestError(f"missing columns: {', '.join(missing)}")
    if len(set(header)) < len(header):
        raise IngestError("columns are repeated")
    records = csv_records(spark, path)
    schema = ", ".join(f"`{c}` string" for c in header) + ", _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    row: Column = F.from_csv("text", F.lit(schema), options)
    rows = records.where((F.col("record") > 0) | (F.col("text") != first[0][0])).withColumn("_row", row)
    reason = F.when(F.col("record") == 0, "header").when(F.col("too_long"), "record_too_long").when(F.col("_row._bad").isNotNull(), "field_count")
    number = F.col("record") + (F.col("earlier") if parts else F.lit(0))
    return rows.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in header], "file", number.alias("source_row_number"), reason.alias("_structural")
    )


def _fields(line: str) -> Iterator[list[str]]:
    import csv

    return csv.reader([line])
