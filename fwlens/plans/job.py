"""Command line: ``spark-submit fwlens/plans/job.py --input LOGS --output DIR [--config FILE] [--baseline]``."""

from __future__ import annotations

import argparse

from fwlens.config import Config, load_config
from fwlens.plans.analysis import run_job
from fwlens.session import build_session


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Analyse firewall logs with Spark.")
    parser.add_argument("--input", required=True, help="CSV, JSON, JSONL, NDJSON or parquet path")
    parser.add_argument("--output", default="outputs", help="output directory on shared storage")
    parser.add_argument("--config", help="YAML parameter file")
    parser.add_argument("--multi-line", action="store_true", help="CSV records may span lines")
    parser.add_argument("--check-utf8", action="store_true", help="look for undecodable text first")
    parser.add_argument("--keep-rejected", action="store_true", help="write unreadable records apart instead of failing")
    switch = parser.add_mutually_exclusive_group()
    switch.add_argument("--baseline", dest="baselining", action="store_true", default=None)
    switch.add_argument("--no-baseline", dest="baselining", action="store_false")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    config = load_config(args.config) if args.config else Config()
    if args.baselining is not None:
        config = config.with_baselining(args.baselining)
    spark = build_session()
    paths = run_job(spark, args.input, args.output, config, args.multi_line, args.check_utf8, args.keep_rejected)
    summary = spark.read.option("header", True).csv(paths["run_summary"]).first().asDict()
    for name, value in {**summary, **paths}.items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
