"""Command line: one subcommand per stage over a workspace folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from liftgrid.plans import stages
from liftgrid.session import checkpoint_dir
from liftgrid.sources import tables
from liftgrid.spec import ExperimentSpec


def _names(text: str) -> tuple[str, ...]:
    return tuple(c for c in text.split(",") if c)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="liftgrid", description=__doc__)
    p.add_argument("--features", type=_names, help="comma-separated; f0 to f11 by default")
    p.add_argument("--outcomes", type=_names, help="comma-separated, the rarest last")
    p.add_argument("--treatment", help="name of the 0/1 arm column")
    p.add_argument("--unit-id", help="name of the unit key")
    sub = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, text: str, workspace: bool = True) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=text)
        if workspace:
            s.add_argument("--workspace", required=True)
            s.add_argument("--which", choices=["full", "sample"], default="full")
        return s

    s = stage("ingest", "store the raw CSV as Parquet by arm, and a stratified sample")
    s.add_argument("--input", required=True)
    s.add_argument("--sample-fraction", type=float, default=0.10)
    s.add_argument("--partitions", type=int, help="spread a gzip file over so many tasks")
    s = stage("combined", "both tables, balance and counts from one pass", workspace=False)
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--sample-fraction", type=float, default=0.10)
    s.add_argument("--partitions", type=int)
    stage("validate", "check schema, nulls and rates; exit code 1 if a check fails")
    stage("balance", "standardized mean differences")
    stage("abtest", "test and detectable effect per outcome")
    s = stage("abtest-from-counts", "the same from a JSON file of counts", workspace=False)
    s.add_argument("--counts-file", required=True)
    s.add_argument("--output", required=True)
    s = stage("split", "stratified split, scaler fitted on train")
    s.add_argument("--seed", type=int, default=42)
    s = stage("train", "fit a learner and store its scores")
    s.add_argument("--model", choices=stages.MODELS, required=True)
    s.add_argument("--outcome")
    s.add_argument("--forest-units", type=int, default=stages.FOREST_UNITS)
    s = stage("evaluate", "metrics with bootstrap intervals")
    s.add_argument("--model", action="append")
    s.add_argument("--outcome")
    s.add_argument("--n-boot", type=int, default=200)
    s = stage("compare", "leaderboard and rank agreement")
    s.add_argument("--outcome")
    s = stage("placebo", "effect of an assignment nobody received")
    s.add_argument("--outcome")
    s = stage("tail", "diagnose deciles 1, 9 and 10")
    s.add_argument("--model", required=True)
    s.add_argument("--outcome")
    s = stage("winsorize", "metrics with clipped scores")
    s.add_argument("--model", required=True)
    s.add_argument("--outcome")
    s.add_argument("--lower-pct", type=float, default=1.0)
    s.add_argument("--upper-pct", type=float, default=99.0)
    return p


def spec_of(args: argparse.Namespace) -> ExperimentSpec:
    chosen = {
        "features": args.features,
        "outcomes": args.outcomes,
        "treatment": args.treatment,
        "unit_id": args.unit_id,
    }
    return ExperimentSpec(**{k: v for k, v in chosen.items() if v})


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    spec = spec_of(args)
    checkpoint_dir(spark)
    if args.stage == "combined":
        raw = tables.find_raw_csv(spark, args.input, spec, args.partitions)
        for frame in stages.combined_job(raw, args.output, spec, args.sample_fraction).values():
            frame.show(50, truncate=False)
        return 0
    if args.stage == "abtest-from-counts":
        stages.ab_test_from_counts(spark, args.counts_file, args.output, spec).show(truncate=False)
        return 0
    ws = stages.Workspace(args.workspace, args.which)
    if args.stage == "ingest":
        raw = tables.find_raw_csv(spark, args.input, spec, args.partitions)
        stages.ingest(raw, ws, spec, args.sample_fraction).show()
    elif args.stage == "validate":
        passed = stages.validate(spark, ws, spec)
        print("all checks passed" if passed else "some checks failed")
        return 0 if passed else 1
    elif args.stage == "balance":
        stages.balance_report(spark, ws, spec).show(100)
    elif args.stage == "abtest":
        stages.ab_test(spark, ws, spec).show(truncate=False)
    elif args.stage == "split":
        stages.split_and_scale(spark, ws, spec, args.seed).show()
    elif args.stage == "train":
        out = stages.train(spark, ws, spec, args.model, args.outcome, forest_units=args.forest_units)
        out.show(truncate=False)
    elif args.stage == "evaluate":
        stages.evaluate(spark, ws, spec, args.model, args.outcome, args.n_boot).show(vertical=True, truncate=False)
    elif args.stage == "compare":
        for frame in stages.compare(spark, ws, spec, args.outcome):
            frame.show(100, truncate=False)
    elif args.stage == "placebo":
        stages.placebo_test(spark, ws, spec, args.outcome).show(vertical=True)
    elif args.stage == "tail":
        stages.tail_report(spark, ws, spec, args.model, args.outcome).show(vertical=True, truncate=False)
    elif args.stage == "winsorize":
        bounds = (args.lower_pct / 100, args.upper_pct / 100)
        stages.winsorize_stage(spark, ws, spec, args.model, args.outcome, *bounds).show(vertical=True, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"liftgrid-{args.stage}").getOrCreate()
    try:
        return run(args, spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
