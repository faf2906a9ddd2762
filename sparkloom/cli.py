"""Command line: fit FEATURES LABELS [--module --output-dir --join-key --target --limit]."""

from __future__ import annotations

import argparse
import sys

from sparkloom.plans import modules
from sparkloom.sources.tables import check_path, positive


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom", description="Relations between a feature table and a label table.")
    fit = top.add_subparsers(dest="command", required=True).add_parser("fit", help="run a module on two tables")
    fit.add_argument("features")
    fit.add_argument("labels")
    fit.add_argument("--module", default="statistics", choices=modules.list_modules())
    fit.add_argument("--output-dir", default="reports")
    fit.add_argument("--join-key")
    fit.add_argument("--target", action="append", dest="targets")
    fit.add_argument("--limit", type=_limit)
    return top


def _limit(text: str) -> int:
    try:
        return positive(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError("must be a positive integer") from e


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    for path in (args.features, args.labels):  # before a session is started
        try:
            check_path(path)
        except ValueError as e:
            p.error(str(e))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    found = modules.run(spark, args.module, args.features, args.labels, args.output_dir, args.join_key, args.targets, args.limit)
    print(found.report_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
