"""Incremental upkeep of facts and of a portfolio mart: only what a snapshot touches is evaluated and written anew.

A record's identity depends on all records with its natural key. A snapshot
touches the keys of its rows, and the keys that rows it replaces had before.
Identity is counted again over the rows with these keys alone. Partitions
(filing years) are written again if a row in them is new, replaced or has
another count; all others keep their files. The mart holds counts, so it is
patched: contributions of rows that went or changed are taken off, those of
their successors added.

A load writes the changed partitions and the mart into a folder of its own and
then a manifest, which says where each year lies. Readers see the manifest's
state; a load that fails before it leaves the old state.

Defined results: a snapshot whose digest was loaded before changes nothing.
Rows of a snapshot replace earlier rows of their identifier. A snapshot without
rows is noted as loaded. A snapshot that repeats an identifier is refused.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.contracts import FACT
from tallyforge.functions.semantics import UNSUPPORTED
from tallyforge.operators import warehouse
from tallyforge.sources.shared import read_text, write_text

IDENTITY = ["source_record_count", "identity_quality_status"]
KEY, ID = "natural_case_identifier", "source_record_identifier"
MART_KEYS = ["district_code", "nature_family"]
MART_COUNTS = ["total_records", "collision_free_records", "pending_records", "terminated_records", "supported_nature_records"]


def contributions(facts: DataFrame, sign: int) -> DataFrame:
    """What each fact adds to the mart's counts, times the sign."""
    one = lambda c: F.when(c, sign).otherwise(0).cast("long")
    return facts.select(
        "district_code",
        F.coalesce("nature_of_suit_family", F.lit(UNSUPPORTED)).alias("nature_family"),
        F.lit(sign).cast("long").alias("total_records"),
        one(F.col("source_record_count") == 1).alias("collision_free_records"),
        one(~F.col("event_observed")).alias("pending_records"),
        one(F.col("event_observed")).alias("terminated_records"),
        one(F.col("nature_of_suit_mapping_status") == "supported").alias("supported_nature_records"),
    )


def summed(rows: DataFrame) -> DataFrame:
    """Counts by mart key; keys that no record is left of are gone."""
    return rows.groupBy(*MART_KEYS).agg(*[F.sum(c).alias(c) for c in MART_COUNTS]).where("total_records > 0")


class FactStore:
    """Facts by filing year and their mart under a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _state(self) -> dict:
        found = read_text(self.spark, f"{self.path}/manifest.json")
        return json.loads(found) if found else {"loads": 0, "digests": [], "years": {}, "mart": None, "schema": None}

    def _read(self, state: dict, years: list[str] | None = None) -> DataFrame | None:
        folders = [f for y, f in state["years"].items() if years is None or y in years]
        if not folders:
            return None
        return self.spark.read.schema(state["schema"]).parquet(*folders)

    def facts(self) -> DataFrame:
        state = self._state()
        found = self._read(state)
        if found is None:
            raise ValueError(f"nothing is loaded at {self.path}")
        return found

    def mart(self) -> DataFrame:
        return self.spark.read.parquet(self._state()["mart"])

    def folders(self) -> dict[str, str]:
        """Filing year -> folder of its current files."""
        return self._state()["years"]

    def load(self, records: DataFrame, digest: str) -> list[str]:
        """Loads a snapshot of records; the years whose files were written anew."""
        state = self._state()
        if digest in state["digests"]:
            return []
        folder = f"{self.path}/load-{state['loads']}"
        mapped = warehouse.map_codes(warehouse.record_semantics(records))
        mapped.write.mode("overwrite").parquet(f"{folder}/incoming")  # read by several steps
        incoming = self.spark.read.parquet(f"{folder}/incoming")
        again = incoming.groupBy(ID).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if again:
            raise ValueError(f"snapshot {digest} repeats {again[0][ID]}")
        old = self._read(state)
        plain = [f.name for f in FACT.struct if f.name not in IDENTITY]
        incoming = incoming.select(*plain)
        if old is None:
            changed = self._kept(self._counted(incoming), f"{folder}/counted")
            gone = None
        else:
            replaced = old.join(incoming.select(ID).distinct(), ID, "left_semi").select(KEY)
            touched = incoming.select(KEY).unionByName(replaced).distinct().withColumn("_touched", F.lit(True))
            marked = old.join(touched, KEY, "left").join(incoming.select(ID).distinct().withColumn("_replaced", F.lit(True)), ID, "left")
            marked.where("_touched").write.mode("overwrite").parquet(f"{folder}/touched")
            before = self.spark.read.parquet(f"{folder}/touched").drop("_touched")
            kept = before.where("_replaced IS NULL")
            was = kept.select(*plain, F.col("source_record_count").alias("_was"))
            new = self._kept(self._counted(was.unionByName(incoming, allowMissingColumns=True), "_was"), f"{folder}/counted")
            stays = F.col("_was").eqNullSafe(F.col("source_record_count"))
            changed = new.where(~stays)
            # Rows whose count stays are neither taken off nor added.
            gone = self._kept(before.join(new.where(stays).select(ID).distinct(), ID, "left_anti"), f"{folder}/gone")
        years = self._years(changed) | (self._years(gone) if gone is not None else set())
        self._write(state, folder, years, changed, gone)
        state["loads"] += 1
        state["digests"].append(digest)
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(state))
        return sorted(years)

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        """Rows that several steps read, written once."""
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @staticmethod
    def _counted(rows: DataFrame, *more: str) -> DataFrame:
        counted = warehouse.identity_quality(rows)
        return counted.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT.struct], *more)

    @staticmethod
    def _year() -> Column:
        return F.coalesce(F.year("filed_date").cast("string"), F.lit("none"))

    def _years(self, rows: DataFrame) -> set[str]:
        return {r["y"] for r in rows.select(self._year().alias("y")).distinct().collect()}

    def _write(self, state: dict, folder: str, years: set[str], changed: DataFrame, gone: DataFrame | None) -> None:
        added = changed.drop("_was")
        state["schema"] = state["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added.schema)
        rows, mart = added, contributions(added, 1)
        if gone is not None:
            mart = self.spark.read.parquet(state["mart"]).unionByName(mart).unionByName(contributions(gone, -1))
            rest = self._read(state, sorted(years))
            if rest is not None:
                # What changed or went is told by identifier; all its rows are in the changed ones.
                out = gone.select(ID).unionByName(added.select(ID)).distinct()
                rows = rest.join(out, ID, "left_anti").unionByName(added.select(*rest.columns))
        summed(mart).write.mode("overwrite").parquet(f"{folder}/mart")
        parts = rows.withColumn("_year", self._year()).hint("rebalance", "_year")
        parts.write.mode("overwrite").partitionBy("_year").parquet(f"{folder}/facts")
        back = self.spark.read.schema(f"{state['schema']}, _year string").parquet(f"{folder}/facts")
        left = {r["_year"] for r in back.select("_year").distinct().collect()}
        state["years"] = {y: f for y, f in state["years"].items() if y not in years} | {y: f"{folder}/facts/_year={y}" for y in sorted(left)}
        state["mart"] = f"{folder}/mart"
