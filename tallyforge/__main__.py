"""Command line: list the queries, run one into Parquet, load raw extracts, or evaluate development folds."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import folds, metrics
from tallyforge.plans import catalogue
from tallyforge.sources import archives, ingest


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyforge")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of all queries")
    commands.add_parser("registry", help="the metric registry as JSON")
    run = commands.add_parser("run", help="write one query's rows as Parquet")
    run.add_argument("name", choices=sorted(catalogue.QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("out")
    load = commands.add_parser("load", help="judge a tab-separated extract and load it once")
    load.add_argument("path")
    load.add_argument("folder")
    load.add_argument("--header", required=True, help="the agreed column names, comma-joined")
    load.add_argument("--start", required=True)
    load.add_argument("--cutoff", required=True)
    load.add_argument("--digest", required=True)
    dockets = commands.add_parser("dockets", help="write a compressed docket extract as Parquet by filing year, with its rejects")
    dockets.add_argument("path")
    dockets.add_argument("out")
    dockets.add_argument("--courts", required=True, help="comma-joined")
    for name in ("--start", "--end", "--cutoff", "--digest"):
        dockets.add_argument(name, required=True)
    evaluate = commands.add_parser("evaluate", help="rolling folds over written cases, as JSON lines")
    evaluate.add_argument("cases")
    evaluate.add_argument("--fold", action="append", required=True, help="name:train:validate:assess, a window as first..last date")
    evaluate.add_argument("--grid", default="30,60,90,120,150,180,210,240,270,300,330,365,395,425,455,485,515,545,575,605,635,665,695,730")
    for name in ("training_cases", "certify_cases", "slice_cases"):
        evaluate.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(folds.Rules, name))
    a = parser.parse_args(arguments)
    if a.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
    elif a.command == "registry":
        print(json.dumps(metrics.compiled(metrics.standard_registry()), sort_keys=True))
    else:
        spark = SparkSession.builder.appName("tallyforge").getOrCreate()
        if a.command == "run":
            catalogue.QUERIES[a.name](spark, a.sf_dir).write.parquet(a.out)
        elif a.command == "dockets":
            read = archives.read_csv(spark, a.path, ["id", "court_id", "blocked", "federal_dn_case_type", "federal_dn_office_code", "docket_number_core", "date_filed", "date_terminated"])
            judged = ingest.normalise_dockets(read.where("_structural IS NULL"), a.courts.split(","), a.start, a.end, keep=["source_row_number"])
            ingest.write_dockets(judged, f"{a.out}/accepted", a.digest, a.cutoff)
            bad = judged.where("reject_reason IS NOT NULL").select("source_row_number", F.col("reject_reason").alias("reason"))
            bad.unionByName(read.where("_structural IS NOT NULL").select("source_row_number", F.col("_structural").alias("reason"))).write.parquet(f"{a.out}/rejected")
        elif a.command == "evaluate":
            windows = [(name, *[tuple(w.split("..")) for w in rest]) for name, *rest in (f.split(":") for f in a.fold)]
            rules = folds.Rules(tuple(map(int, a.grid.split(","))), training_cases=a.training_cases, certify_cases=a.certify_cases, slice_cases=a.slice_cases)
            for r in folds.rolling_folds(spark.read.parquet(a.cases), [folds.Fold(*w) for w in windows], rules).orderBy("fold").toJSON().collect():
                print(r)
        else:
            header = a.header.split(",")
            rows = ingest.read_tsv(spark, a.path, header, header)
            print(json.dumps(ingest.load_snapshot(rows, a.folder, a.start, a.cutoff, a.digest), sort_keys=True))


if __name__ == "__main__":
    main()
