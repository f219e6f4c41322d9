"""Check deliveries from a shell: python -m sieveworks PATH... Exit codes: 0, 1, 2 as `report.exit_code`, 64 for wrong usage, 70 for a fault of this tool."""

from __future__ import annotations

import argparse
import sys
import traceback

from pyspark.sql import SparkSession

from sieveworks.operators import grouping
from sieveworks.plans import report

USAGE, FAULT = 64, 70


class _Arguments(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(USAGE, f"{self.prog}: {message}\n")


def arguments() -> argparse.ArgumentParser:
    a = _Arguments(prog="sieveworks", description="Check documentation deliveries.")
    a.add_argument("paths", nargs="*", help="files or folders, by any path that Spark reads")
    a.add_argument("--json", action="store_true", help="one JSON array instead of text")
    a.add_argument("--quiet", action="store_true", help="leave notes out")
    a.add_argument("--fail-on", choices=grouping.SEVERITIES, default="error", help="the least severity that makes the exit code 1")
    a.add_argument("--bundle", metavar="FILE", help="write a diagnosis without names or contents")
    a.add_argument("--rules", action="store_true", help="list the rules")
    a.add_argument("--classes", action="store_true", help="list the document classes")
    return a


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = arguments()
    args = parser.parse_args(given)
    if not (args.paths or args.rules or args.classes):
        parser.error("name a path, --rules or --classes")
    try:
        spark = spark or SparkSession.builder.appName("sieveworks").getOrCreate()
        for asked, listing in ((args.rules, report.rule_listing), (args.classes, report.class_listing)):
            if asked:
                for row in listing(spark).toLocalIterator():
                    print(*row, sep="  ")
        if not args.paths:
            return report.EXIT["clean"]
        done = report.check(spark, *args.paths)
        if args.json:
            report.write_json_array(done.json(args.quiet), sys.stdout)
        else:
            for row in done.text(args.quiet).orderBy("delivery").toLocalIterator():
                print(row["report"])
        if args.bundle:
            with open(args.bundle, "w", encoding="utf-8") as out:
                out.write(done.bundle())
        return done.exit_code(args.fail_on)
    except Exception:  # noqa: BLE001 - the exit code has to tell a fault of this tool from a finding
        traceback.print_exc()
        return FAULT


if __name__ == "__main__":
    sys.exit(main())
