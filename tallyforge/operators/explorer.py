"""Bounded, deterministically ordered pages, counts, details and exports of public rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.semantics import spreadsheet_safe
from tallyforge.operators import storage

MAX_PAGE, MAX_PARQUET, MAX_CSV, MAX_OFFSET = 200, 10_000, 50_000, 5_008_333
KEY = "release_record_key"


class PageError(ValueError):
    """A page request outside its bounds."""


@dataclass(frozen=True)
class PageSpec:
    columns: tuple[str, ...]
    district: str | None = None
    family: str | None = None
    sort: str = "filed_month"
    descending: bool = False
    limit: int = 100
    offset: int = 0

    def check(self, rows: DataFrame, most: int) -> None:
        if not self.columns or set(self.columns) - set(rows.columns):
            raise PageError("columns must be public")
        if self.sort not in rows.columns:
            raise PageError("unknown sort column")
        if not 1 <= self.limit <= most or not 0 <= self.offset <= MAX_OFFSET:
            raise PageError("limit or offset out of bounds")


def _matching(rows: DataFrame, spec: PageSpec) -> DataFrame:
    if spec.district is not None:
        rows = rows.where(F.col("district_code") == spec.district)
    if spec.family is not None:
        rows = rows.where(F.col("nature_of_suit_family") == spec.family)
    return rows


def page(rows: DataFrame, spec: PageSpec, most: int = MAX_PAGE) -> DataFrame:
    """Rows in a total order: the sort column, nulls last, then the key."""
    spec.check(rows, most)
    first = F.desc_nulls_last(spec.sort) if spec.descending else F.asc_nulls_last(spec.sort)
    return _matching(rows, spec).orderBy(first, KEY).offset(spec.offset).limit(spec.limit).select(*spec.columns)


#: Ranges of a counting pass, and rows that a range may have to be sorted as it is.
RANGES, SORTED_ROWS = 256, 100_000


def _ranged(rows: DataFrame, column: str, depth: int) -> Column:
    """A value that grows with the column, with few different ones: quantile ranges of numbers and dates, prefixes of texts."""
    kind = rows.schema[column].dataType.simpleString()
    if kind == "string":
        return F.substring(column, 1, depth)
    number = F.unix_date(column) if kind == "date" else F.col(column).cast("double")
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    ends = sorted(set(rows.agg(F.approx_percentile(number, shares, F.lit(10_000)).alias("q")).first()["q"] or []))
    return F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < number)) if ends else F.lit(0)


def seek(rows: DataFrame, order: list[tuple[str, bool]], offset: int, limit: int, sorted_rows: int = SORTED_ROWS, depth: int = 1) -> list[DataFrame]:
    """Parts that together hold the rows from ``offset`` on, ``limit`` of them, in an order of (column, descending) with nulls last.

    Rows are counted by ranges of the first column; only ranges that the page
    reaches into are looked at further, by finer ranges or, where a range is one
    value, by the next column. A range that is small enough is sorted.
    """
    (column, descending), rest = order[0], order[1:]
    value = _ranged(rows, column, depth)
    null = F.col(column).isNull()
    tagged = rows.withColumn("_range", value).withColumn("_null", null)
    found = tagged.groupBy("_null", "_range").agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("greatest")).collect()
    known = sorted((r for r in found if not r["_null"]), key=lambda r: r["_range"], reverse=descending)
    parts, at = [], 0
    for r in known + [r for r in found if r["_null"]]:
        low, high = max(offset, at), min(offset + limit, at + r["n"])
        if low < high:
            own = tagged.where(F.col("_null") if r["_null"] else ~F.col("_null") & (F.col("_range") == r["_range"])).drop("_null", "_range")
            single = r["_null"] or r["least"] == r["greatest"]
            if r["n"] <= sorted_rows or single and not rest:
                by = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in order]
                parts.append(own.orderBy(*by).offset(low - at).limit(high - low))
            elif single:
                parts += seek(own, rest, low - at, high - low, sorted_rows)
            else:
                parts += seek(own, order, low - at, high - low, sorted_rows, depth + 1)
        at += r["n"]
    return parts


def deep_page(rows: DataFrame, spec: PageSpec, most: int = MAX_PAGE, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The rows of ``page`` at any offset, found by counts of ranges: no task gathers the rows before the page."""
    spec.check(rows, most)
    matching = _matching(rows, spec)
    order = [(spec.sort, spec.descending)] + ([(KEY, False)] if spec.sort != KEY else [])
    parts = seek(matching, order, spec.offset, spec.limit, sorted_rows)
    out = parts[0] if parts else matching.limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    by = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in order]
    return out.orderBy(*by).select(*spec.columns)


def count(rows: DataFrame, spec: PageSpec) -> DataFrame:
    return _matching(rows, spec).agg(F.count("*").alias("matching_rows"))


def detail(rows: DataFrame, key: str) -> DataFrame:
    if not re.fullmatch(r"[A-Za-z0-9_-]{22}", key):
        raise PageError("not a record key")
    return rows.where(F.col(KEY) == key).limit(1)


def csv_text(rows: DataFrame, spec: PageSpec) -> str:
    """A bounded CSV export: CRLF, every field quoted, formulas neutralised."""
    out = page(rows, spec, MAX_CSV)
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(spreadsheet_safe(F.col(c).cast("string")), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in spec.columns]
    lines = [r[0] for r in out.select(F.concat_ws(",", *cells)).collect()]
    return "\r\n".join([",".join(f'"{c}"' for c in spec.columns), *lines]) + "\r\n"


def export_parquet(rows: DataFrame, spec: PageSpec, path: str) -> int:
    """Writes a bounded selection in one file and reads it back; types, number and values must agree."""
    out = page(rows, spec, MAX_PARQUET).coalesce(1)
    return storage.copy_verified(out, path)["rows"]
