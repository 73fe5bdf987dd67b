"""Tables that a job writes in the folder all executors share, and reads again."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: the checkpoint folder, else a temporary one in a session of one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there: later jobs start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parts(lines: DataFrame, key: str, header: str, path: str, compression: str = "none") -> None:
    """``value`` in the order of a key, as text files whose names have that order too; each begins with the header."""
    ordered = lines.repartitionByRange(key).sortWithinPartitions(key)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    ordered.select(F.when(first, F.concat(F.lit(f"{header}\n"), F.col("value"))).otherwise(F.col("value")).alias("value")).write.option("compression", compression).text(path)


def files_under(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of every file under a path that Spark can read, in order; by its file systems, on the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, every = [], fs.listFiles(at, True)
    while every.hasNext():
        f = every.next()
        found.append((f.getPath().toString(), int(f.getLen())))
    return sorted(found)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and moved there."""
    at, fs = _hadoop(spark, path)
    new, _ = _hadoop(spark, f"{path}.new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    at, fs = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode()


def arrow_files(path: str):
    """(Arrow file system, path in it) of a path or URI; for code in tasks, which has no JVM at hand."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
