"""Command line: list the queries, or run one over a data directory.

    python -m strandline [--queries MODULE] list
    python -m strandline [--queries MODULE] run NAME --data DIR [--out DIR] [--format parquet|csv|json] [--rows N] [--explain]

MODULE has a function queries(); `__spark_entry__` adds the corpus operators to this package's own.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from .session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandline")
    parser.add_argument("--queries", default="strandline.plans.registry", help="module whose queries() are known")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder of the parquet tables")
    run.add_argument("--out", help="where to write the result; without it the first rows are shown")
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--explain", action="store_true", help="show the plan instead of running it")
    args = parser.parse_args(argv)
    queries = importlib.import_module(args.queries).queries()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if args.name not in queries:
        print(f"unknown query {args.name}", file=sys.stderr)
        return 2
    df = queries[args.name](local_session(), args.data)
    if args.explain:
        df.explain("formatted")
    elif args.out:
        df.write.mode("overwrite").format(args.format).options(**({"header": "true"} if args.format == "csv" else {})).save(args.out)
    else:
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
