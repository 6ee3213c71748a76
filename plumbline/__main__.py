"""Command line: ``python -m plumbline parse|validate|info|serve``."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from .plans.mode import COMPAT, STRICT
from .plans.shapes import ShapeError, parse_shapes
from .sources.readers import ParseError, format_of_path, read_files, read_triples_file


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    top.add_argument("--quiet", action="store_true", help="errors only")
    top.add_argument("--compat", action="store_true", help="the older, looser semantics")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("parse", help="print the shapes of a file")
    p.add_argument("shapes")
    p.add_argument("--format", default=None)
    p.add_argument("--output", choices=("pretty", "json", "compact"), default="pretty")
    v = sub.add_parser("validate", help="validate data files; exits with 1 if they don't conform")
    v.add_argument("shapes")
    v.add_argument("data", nargs="+")
    v.add_argument("-d", "--data-format", default=None)
    v.add_argument("-s", "--shapes-format", default=None)
    v.add_argument("-o", "--output", default=None, help="a file for the report")
    v.add_argument("--output-format", default="text", help="text, json, or an RDF format")
    v.add_argument("--parts", action="store_true", help="the executors write the report to the folder --output, as json lines or nt")
    i = sub.add_parser("info", help="count a file's shapes, targets and constraints")
    i.add_argument("shapes")
    i.add_argument("--format", default=None)
    i.add_argument("--detailed", action="store_true")
    sub.add_parser("serve", help="answer JSON-RPC requests, a line each, on standard input")
    return top.parse_args(argv)


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    a = arguments(argv)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.WARNING)
    mode = COMPAT if a.compat else STRICT
    try:
        if a.command == "serve":
            from .server import serve

            return serve(sys.stdin, out)
        if a.command in ("parse", "info"):
            shapes = parse_shapes(read_triples_file(a.shapes, a.format), mode)
            if a.command == "info":
                total = [s.counts() for s in shapes]
                print(f"shapes: {len(shapes)}", *(f"{k}: {sum(t[k] for t in total)}" for k in ("targets", "constraints", "properties")), sep="\n", file=out)
                if a.detailed:
                    print(*(s.compact() for s in shapes), sep="\n", file=out)
            elif a.output == "json":
                print(json.dumps([s.as_dict() for s in shapes], indent=2, ensure_ascii=False), file=out)
            else:
                print(*(s.compact() if a.output == "compact" else str(s) for s in shapes), sep="\n", file=out)
            return 0
        return validate(a, mode, out)
    except (ParseError, ShapeError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def validate(a: argparse.Namespace, mode, out) -> int:
    from .api import validate_triples

    for path in a.data:
        if a.data_format is None:
            format_of_path(path)
    triples = read_triples_file(a.shapes, a.shapes_format)
    report = validate_triples(read_files(session(), a.data, a.data_format), triples, mode)
    report.results = report.results.cache()
    if a.parts:
        if not a.output or a.output_format not in ("json", "nt"):
            raise ValueError("--parts takes --output and the format json or nt")
        report.write(a.output, a.output_format)
        return 0 if report.conforms else 1
    text, good = report.render(a.output_format), report.conforms
    report.results.unpersist()
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, file=out)
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
