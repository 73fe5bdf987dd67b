"""Archives and compressed CSV against plain readers."""

import bz2
import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import archives
from tallyforge.sources.ingest import IngestError


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_members_are_partitions(spark, tmp_path):
    zipped(tmp_path / "a.zip", {"one.txt": b"A\tB\r\n1\t2\n\xff\t3\n4\t\xff\n5\n", "notes.md": b"no"})
    zipped(tmp_path / "b.zip", {"two.tsv": b"B\tA\nx\ty\n", "three.csv": b""})
    lines = archives.zip_lines(spark, f"file:{tmp_path}")
    assert lines.rdd.getNumPartitions() == 3
    got = sorted((r.archive, r.member, r.line, bytes(r.value)) for r in lines.collect())
    assert got[0] == ("a.zip", "one.txt", 0, b"A\tB") and got[-1] == ("b.zip", "two.tsv", 1, b"x\ty") and len(got) == 7
    rows = archives.tsv_fields(lines, ["A", "B"], ["A"]).collect()
    want = {("a.zip", 0, "1", None), ("a.zip", 1, None, "invalid_utf8"), ("a.zip", 2, "4", None), ("a.zip", 3, "5", "field_count"), ("b.zip", -1, "B", "header"), ("b.zip", 0, "x", None)}
    assert {(r.archive, r.source_row_number, r.A, r._structural) for r in rows} == want
    assert archives.zip_lines(spark, f"{tmp_path}/a.zip", members="nothing").count() == 0


def test_budgets_hold_where_bytes_are_read(spark, tmp_path):
    zipped(tmp_path / "big.zip", {"big.txt": b"0\n" * 2_000_000})
    with pytest.raises(Exception, match="exceeds its budgets"):
        archives.zip_lines(spark, f"{tmp_path}/big.zip").count()
    reader = archives.ZipReader(f"{tmp_path}/big.zip", "", 1 << 20, 10**9)
    with pytest.raises(IngestError, match="exceeds its budgets"):  # the directory is not believed
        list(reader.read(archives.Member(f"{tmp_path}/big.zip", "big.txt", 10**6)))
    zipped(tmp_path / "line.zip", {"line.txt": bytes(range(33, 127)) * 20_000})
    with pytest.raises(Exception, match="line exceeds"):
        archives.zip_lines(spark, f"{tmp_path}/line.zip", maxRatio="100000").count()


def content(n):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "note", "x"])
    rows = []
    for i in range(n):
        note = ["plain", 'say "hi", then', "two\nlines", 'a "quoted\n\nbreak",\n', "", "é漢 'x'", "\n", "tail\n"][i % 8] + "z" * (i % 50)
        rows.append([str(i), note, "" if i % 9 == 0 else f"v{i}"])
        w.writerow(rows[-1])
    return out.getvalue(), rows


@pytest.mark.parametrize("split", [False, True])
def test_records_against_the_csv_module(spark, tmp_path, split):
    """Quoted line breaks and quotes, empty fields; with splits that fall into records."""
    n = 60_000 if split else 400
    text, rows = content(n)
    (tmp_path / "x.csv.bz2").write_bytes(bz2.compress(text.encode(), 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k" if split else "128m")
    try:
        assert not split or spark.read.text(f"{tmp_path}/x.csv.bz2").rdd.getNumPartitions() > 3
        got = archives.read_csv(spark, f"{tmp_path}/x.csv.bz2", ["id", "x"]).where("_structural IS NULL").orderBy("source_row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n and [r.source_row_number for r in got] == list(range(1, n + 1))
    assert [[r.id, r.note or "", r.x or ""] for r in got] == rows


def test_rejects_keep_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "MAX_RECORD_LINES", 3)
    (tmp_path / "x.csv").write_text('b,a\n1,2\n3\n4,5,6\n"one\ntwo",7\n"never closed\n1\n2\n3\n4,4\n')
    (tmp_path / "y.csv").write_text("a,b\n8,9\n")
    rows = {(r.file[-5:], r.source_row_number): (r.a, r._structural) for r in archives.read_csv(spark, str(tmp_path), ["a", "b"]).collect()}
    assert rows == {
        ("x.csv", 1): ("2", None), ("x.csv", 2): (None, "field_count"), ("x.csv", 3): ("5", "field_count"), ("x.csv", 4): ("7", None),
        ("x.csv", 5): (None, "record_too_long"), ("y.csv", 0): ("b", "header"), ("y.csv", 1): ("9", None),
    }
    with pytest.raises(IngestError, match="missing columns: c"):
        archives.read_csv(spark, f"{tmp_path}/x.csv", ["a", "c"])
