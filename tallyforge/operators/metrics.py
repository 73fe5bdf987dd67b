"""An allowlisted metric registry, compiled to columns.

A request names a context, measures, dimensions and filters. Everything that it
can name is in the registry; anything else is refused before a plan exists.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.semantics import age_band, ratio

MAX_ROWS, MAX_IN = 10_000, 100
_NAME = re.compile(r"[a-z][a-z0-9_]*")
TYPES = {"string": "string", "boolean": "boolean", "integer": "bigint", "date": "date"}


class MetricError(ValueError):
    """A request or registry that is not allowed."""


#: What measures are made of (fixed tokens).
AGGREGATIONS = {
    "rows": lambda: F.count("*"),
    "canonical_rows": lambda: F.count_if(F.col("identity_quality_status") == "canonical"),
    "pending_rows": lambda: F.count_if("pending_status"),
    "terminated_rows": lambda: F.count_if("event_observed"),
    "matched_rows": lambda: F.count_if("recap_match_available"),
    "supported_nature_rows": lambda: F.count_if(F.col("nature_of_suit_mapping_status") == "supported"),
    "duration_days": lambda: F.sum("duration_days").cast("long"),
    "observed_duration_days": lambda: F.sum(F.when(F.col("event_observed"), F.col("duration_days")).otherwise(0)).cast("long"),
}
DERIVED = {
    "filing_year": lambda: F.year("filed_month").cast("long"),
    "age_band": lambda: age_band(F.col("duration_days")),
}


@dataclass(frozen=True)
class Dimension:
    name: str
    type: str


@dataclass(frozen=True)
class Measure:
    """A count or sum, or the ratio of two of them."""

    name: str
    numerator: str
    denominator: str | None = None


@dataclass(frozen=True)
class Context:
    name: str
    dimensions: tuple[str, ...]
    measures: tuple[str, ...]
    pending_only: bool = False
    minimum_support: int = 200


@dataclass(frozen=True)
class Filter:
    dimension: str
    operator: str
    value: object


@dataclass
class Registry:
    dimensions: dict[str, Dimension]
    measures: dict[str, Measure]
    contexts: dict[str, Context] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in [*self.dimensions, *self.measures, *self.contexts]:
            if not _NAME.fullmatch(name):
                raise MetricError(f"not a name: {name!r}")
        for d in self.dimensions.values():
            if d.type not in TYPES:
                raise MetricError(f"unknown type of {d.name}: {d.type}")
        for m in self.measures.values():
            if {m.numerator, m.denominator} - {None} - set(AGGREGATIONS):
                raise MetricError(f"unknown aggregation in {m.name}")
        for c in self.contexts.values():
            if set(c.dimensions) - set(self.dimensions) or set(c.measures) - set(self.measures):
                raise MetricError(f"{c.name} names what the registry does not hold")
            if c.minimum_support < 1:
                raise MetricError(f"{c.name} has no support threshold")

    def query(
        self,
        rows: DataFrame,
        context: str,
        measures: list[str],
        dimensions: list[str] = (),
        filters: list[Filter] = (),
        order_by: list[tuple[str, bool]] | None = None,
        limit: int = MAX_ROWS,
    ) -> DataFrame:
        """The request's rows; cells below the context's support are absent. ``order_by`` is (name, descending)."""
        if context not in self.contexts:
            raise MetricError(f"unknown context: {context!r}")
        c = self.contexts[context]
        if not measures or len(set(measures)) != len(measures) or set(measures) - set(c.measures):
            raise MetricError("measures must be distinct and of the context")
        if len(set(dimensions)) != len(dimensions) or set(dimensions) - set(c.dimensions):
            raise MetricError("dimensions must be distinct and of the context")
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_ROWS:
            raise MetricError(f"limit must be 1 to {MAX_ROWS}")
        order_by = [(d, False) for d in dimensions] if order_by is None else order_by
        if {n for n, _ in order_by} - set(measures) - set(dimensions):
            raise MetricError("order must name what is selected")
        if c.pending_only:
            rows = rows.where("pending_status")
        for f in filters:
            rows = rows.where(self._condition(c, f))
        made = [self._column(d).alias(d) for d in dimensions]
        out = rows.groupBy(*made).agg(F.count("*").alias("_support"), *[self._measure(m).alias(m) for m in measures])
        out = out.where(F.col("_support") >= c.minimum_support).drop("_support")
        keys = [F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, down in order_by]
        return (out.orderBy(*keys) if keys else out).limit(limit)

    def _column(self, name: str) -> Column:
        return DERIVED[name]() if name in DERIVED else F.col(name)

    def _measure(self, name: str) -> Column:
        m = self.measures[name]
        top = AGGREGATIONS[m.numerator]()
        return ratio(top, AGGREGATIONS[m.denominator]()) if m.denominator else top

    def _condition(self, c: Context, f: Filter) -> Column:
        if f.dimension not in c.dimensions:
            raise MetricError(f"unknown filter: {f.dimension!r}")
        d = self.dimensions[f.dimension]
        column = self._column(d.name)
        if f.operator == "eq":
            return column == self._literal(d, f.value)
        if not isinstance(f.value, (list, tuple)):
            raise MetricError(f"{f.operator!r} needs a list")
        if f.operator == "in" and 1 <= len(f.value) <= MAX_IN:
            return column.isin(*[self._literal(d, v) for v in f.value])
        if f.operator == "between" and len(f.value) == 2 and d.type in ("integer", "date"):
            return column.between(*[self._literal(d, v) for v in f.value])
        raise MetricError(f"filter not allowed: {f.operator!r} on {d.name}")

    @staticmethod
    def _literal(d: Dimension, value: object) -> Column:
        wanted = {"string": str, "boolean": bool, "integer": int, "date": str}[d.type]
        if not isinstance(value, wanted) or (d.type == "integer" and isinstance(value, bool)):
            raise MetricError(f"{d.name} takes {d.type} values")
        if d.type == "date" and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            raise MetricError(f"{d.name} takes dates")
        return F.lit(value).cast(TYPES[d.type])


def standard_registry(minimum_support: int = 200) -> Registry:
    dims = {
        n: Dimension(n, t)
        for n, t in {
            "district_code": "string", "nature_of_suit_family": "string", "filing_year": "integer", "age_band": "string",
            "origin_code": "string", "jurisdiction_code": "string", "procedural_cohort": "string",
            "identity_quality_status": "string", "nature_of_suit_mapping_status": "string", "filed_month": "date",
            "pending_status": "boolean", "recap_match_available": "boolean",
        }.items()
    }
    measures = {
        m.name: m
        for m in (
            Measure("total_records", "rows"), Measure("collision_free_records", "canonical_rows"),
            Measure("pending_records", "pending_rows"), Measure("terminated_records", "terminated_rows"),
            Measure("matched_records", "matched_rows"), Measure("supported_nature_records", "supported_nature_rows"),
            Measure("followup_days", "duration_days"), Measure("pending_share", "pending_rows", "rows"),
            Measure("match_coverage", "matched_rows", "rows"), Measure("average_age_days", "duration_days", "rows"),
            Measure("average_observed_duration_days", "observed_duration_days", "terminated_rows"),
        )
    }
    every = tuple(n for n in dims if n != "age_band")
    contexts = {
        "portfolio": Context("portfolio", every, tuple(m for m in measures if m != "average_age_days"), False, minimum_support),
        "filing": Context("filing", every, ("total_records", "pending_records", "terminated_records", "matched_records", "followup_days"), False, minimum_support),
        "pending_age": Context("pending_age", (*every, "age_band"), ("pending_records", "matched_records", "average_age_days"), True, minimum_support),
    }
    return Registry(dims, measures, contexts)


def compiled(registry: Registry) -> dict:
    """The registry as plain data, in a fixed order: what a client may ask for."""
    return {
        "contexts": [
            {"id": c.name, "dimensions": sorted(c.dimensions), "measures": sorted(c.measures), "pending_only": c.pending_only, "minimum_support": c.minimum_support}
            for _, c in sorted(registry.contexts.items())
        ],
        "dimensions": [{"id": d.name, "type": d.type, "derived": d.name in DERIVED} for _, d in sorted(registry.dimensions.items())],
        "measures": [{"id": m.name, "numerator": m.numerator, "denominator": m.denominator} for _, m in sorted(registry.measures.items())],
        "limits": {"rows": MAX_ROWS, "values_in_filter": MAX_IN},
    }


def as_markdown(registry: Registry) -> str:
    """The registry's measures and contexts as two tables."""
    body = compiled(registry)
    lines = ["| Measure | Made of |", "| - | - |"]
    lines += [f"| {m['id']} | {m['numerator']}{' / ' + m['denominator'] if m['denominator'] else ''} |" for m in body["measures"]]
    lines += ["", "| Context | Measures | Support |", "| - | - | - |"]
    lines += [f"| {c['id']} | {', '.join(c['measures'])} | {c['minimum_support']} |" for c in body["contexts"]]
    return "\n".join(lines) + "\n"


def reconcile(registry: Registry, rows: DataFrame, context: str, groupings: list[list[str]], measures: list[str], cube: DataFrame) -> DataFrame:
    """(grouping, slices, missing_slices, extra_slices, comparisons, max_abs_difference) of answers against a cube.

    ``cube`` has the dimensions' and measures' names, and null for a rolled-up
    dimension. Answers and cube are joined null-safely, so a slice that only one
    side has is counted.
    """
    every = sorted({d for g in groupings for d in g})
    out: DataFrame | None = None
    for grouping in groupings:
        asked = registry.query(rows, context, measures, grouping)
        rest = [d for d in every if d not in grouping]
        own = cube
        for d in grouping:
            own = own.where(F.col(d).isNotNull())
        for d in rest:
            own = own.where(F.col(d).isNull())
        own = own.select(*[F.col(d).alias(f"_{d}") for d in grouping], *[F.col(m).alias(f"_{m}") for m in measures], F.lit(1).alias("_in"))
        # The total of all rows is one slice; it is joined by a key of its own.
        own, asked = own.withColumn("_all", F.lit(0)), asked.withColumns({"_asked": F.lit(1), "_total": F.lit(0)})
        condition = asked["_total"] == own["_all"]
        for d in grouping:
            condition = condition & asked[d].eqNullSafe(own[f"_{d}"])
        both = F.col("_asked").isNotNull() & F.col("_in").isNotNull()
        gaps = [F.abs(F.col(m).cast("double") - F.col(f"_{m}").cast("double")) for m in measures]
        worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
        one = asked.join(own, condition, "full").agg(
            F.count_if(F.col("_asked").isNotNull()).alias("slices"),
            F.count_if(F.col("_asked").isNull()).alias("missing_slices"),
            F.count_if(F.col("_in").isNull()).alias("extra_slices"),
            (F.count_if(both) * len(measures)).alias("comparisons"),
            F.coalesce(F.max(F.when(both, worst)), F.lit(0.0)).alias("max_abs_difference"),
        )
        one = one.select(F.lit(",".join(grouping)).alias("grouping"), "*")
        out = one if out is None else out.unionByName(one)
    return out
