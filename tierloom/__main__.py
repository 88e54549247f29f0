"""Command line: parse documents, or run registered queries over a folder of tables."""

from __future__ import annotations

import argparse
import sys


def main(arguments: list[str] | None = None) -> int:
    """0: done, 1: wrong arguments or nothing to do, 2: some steps failed."""
    parser = argparse.ArgumentParser(prog="tierloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="annotation documents to parsed tables")
    parse.add_argument("folder")
    parse.add_argument("out")
    parse.add_argument("--exceptions-file")
    parse.add_argument("--overwrite", action="store_true")
    query = commands.add_parser("query", help="registered queries over a folder of tables")
    query.add_argument("tables")
    query.add_argument("out")
    query.add_argument("names", nargs="+")
    query.add_argument("--overwrite", action="store_true")
    commands.add_parser("list", help="names of the registered queries")
    try:
        options = parser.parse_args(arguments)
    except SystemExit as e:
        return 1 if e.code else 0
    from .plans import registry

    if options.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    from .plans import pipelines

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if options.command == "parse":
        report = pipelines.parsing(spark, options.folder, options.out, pipelines.exceptions_from(spark, options.exceptions_file), options.overwrite)
    else:
        unknown = [n for n in options.names if n not in registry.QUERIES]
        if unknown:
            print("no such query:", *unknown, file=sys.stderr)
            return 1
        report = pipelines.run_steps(spark, options.out, {n: (lambda n=n: registry.QUERIES[n](spark, options.tables)) for n in options.names}, overwrite=options.overwrite)
    for name, error in report.failed.items():
        print(name, error, file=sys.stderr)
    for name, totals in report.totals.items():
        print(name, *(f"{k}={v}" for k, v in totals.items()), f"resolved={report.resolved_percent:.1f}%")
    print("written:", *report.written, "skipped:", *report.skipped)
    return report.exit_code


if __name__ == "__main__":
    sys.exit(main())
