"""Relation contracts: types, order and presence of columns, and checks that Spark does not make itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A relation does not meet its contract."""


@dataclass(frozen=True)
class Contract:
    """``schema`` as DDL; rules on top of it."""

    schema: str
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    accepted: dict[str, tuple] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema)


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns in order and type; a missing column is an error, an extra one is dropped."""
    missing = [f.name for f in contract.struct if f.name not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.struct])


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, column, failures): one row for each rule, all column rules from one pass."""
    counts = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in contract.not_null}
    counts |= {
        f"accepted:{c}": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)) for c, values in contract.accepted.items()
    }
    parts = []
    if counts:
        one = df.agg(*[v.alias(k) for k, v in counts.items()])
        parts.append(one.unpivot([], list(counts), "rule", "failures"))
    for columns in contract.unique:
        again = df.groupBy(*columns).count().where("count > 1").agg(F.count("*").alias("failures"))
        parts.append(again.select(F.lit("unique:" + ",".join(columns)).alias("rule"), "failures"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        F.split("rule", ":")[0].alias("rule"), F.split("rule", ":")[1].alias("column"), F.col("failures").cast("long").alias("failures")
    )


def require(df: DataFrame, contract: Contract) -> DataFrame:
    """df conformed, after its rules were found to hold."""
    df = conform(df, contract)
    bad = [(r["rule"], r["column"], r["failures"]) for r in violations(df, contract).where("failures > 0").collect()]
    if bad:
        raise ContractError("; ".join(f"{rule} {column}: {n}" for rule, column, n in bad))
    return df


FACT = Contract(
    "source_record_identifier string, natural_case_identifier string, circuit_code string, district_code string, "
    "office_code string, docket_number string, filed_date date, terminated_date date, censoring_date date, "
    "analysis_end_date date, duration_days bigint, event_observed boolean, nature_of_suit_raw string, "
    "nature_of_suit_code string, nature_of_suit_family string, nature_of_suit_mapping_status string, "
    "jurisdiction_code string, origin_code string, intake_procedural_cohort string, identity_quality_status string, "
    "source_record_count bigint, source_snapshot_cutoff date",
    not_null=("source_record_identifier", "natural_case_identifier", "district_code", "filed_date", "event_observed"),
    unique=(("source_record_identifier",),),
    accepted={
        "identity_quality_status": ("canonical", "collision"),
        "nature_of_suit_mapping_status": ("supported", "unsupported"),
    },
)
