"""Command line: python -m graphloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

#: Rows of a result that are printed.
SHOWN = 10_000


def _read(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, data: bool = True, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if data:
            c.add_argument("--data", nargs="+", required=True, help="RDF files")
            c.add_argument("--format", default=None)
            c.add_argument("--lax", action="store_true")
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), default=v)
        return c

    command("data", to="turtle")
    command("query", "query", result="markdown")
    command("node", "node", depth="1", direction="both")
    command("shacl", "shapes", mode="native", sort="Node")
    command("shex", "schema", "shapemap", sort="node")
    command("pgschema", "graph", "schema", "typemap", data=False)
    command("convert", "schema", data=False, source="shex", target="sparql")
    command("compare", "first", "second", data=False, source="shex")
    command("dctap", "profile", data=False, target="shexc")
    command("generate", "schema", data=False, source="shex", entities="100", strategy="balanced", seed="0", out="generated")
    command("void")
    command("service", "description", data=False, to="yaml")
    return p


def _schema(session, path: str, kind: str):
    text = _read(path)
    return session.load_shacl_shapes(text) if kind == "shacl" else session.load_dctap(text) if kind == "dctap" else session.load_shex_schema(text, "shexj" if path.endswith(".json") else "shexc")


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "service":
        from .sources import rdf, service

        own = service.parse_service(rdf.parse_text(_read(a.description), "turtle"))
        print(service.mie_text(service.to_mie(own), a.to))
        return 0
    from pyspark.sql import SparkSession

    from .operators import generate
    from .session import Session
    from .sources import convert

    s = Session(spark or SparkSession.builder.getOrCreate())
    if hasattr(a, "data"):
        s.load_data(a.data, a.format, mode="lax" if a.lax else "strict")

    def show(df) -> None:
        """At most SHOWN rows; it is said if there are more."""
        rows = df.limit(SHOWN + 1).collect()
        print(convert.table_text(df.columns, [["" if x is None else str(x) for x in r] for r in rows[:SHOWN]]))
        if len(rows) > SHOWN:
            print(f"only the first {SHOWN} rows are shown; use the Python interface to write all", file=sys.stderr)

    if a.command == "data":
        print(s.serialize_data(a.to))
    elif a.command == "query":
        print(s.query_text(_read(a.query), a.result))
    elif a.command == "node":
        show(s.show_node_info(a.node, depth=int(a.depth), direction=a.direction).selectExpr("root", "depth", "direction", "node", "p", "value.lex AS value"))
    elif a.command == "shacl":
        s.load_shacl_shapes(_read(a.shapes))
        report = s.validate_shacl(a.mode, a.sort)
        show(report)
        return int(not report.isEmpty())
    elif a.command == "shex":
        _schema(s, a.schema, "shex")
        s.load_shapemap(_read(a.shapemap))
        show(s.validate_shex(sort=a.sort))
    elif a.command == "pgschema":
        s.load_pg(_read(a.graph), _read(a.schema), _read(a.typemap))
        show(s.validate_pgschema())
    elif a.command == "convert":
        _schema(s, a.schema, a.source)
        print(s.show_schema_conversion(a.source, a.target))
    elif a.command == "dctap":
        _schema(s, a.profile, "dctap")
        print(s.show_schema_conversion("dctap", a.target))
    elif a.command == "compare":
        show(s.show_schema_comparison(_schema(s, a.first, a.source), _schema(s, a.second, a.source)))
    elif a.command == "generate":
        shapes = convert.to_generator(_schema(s, a.schema, a.source))
        print(generate.write(generate.generate(s.spark, shapes, int(a.entities), a.strategy, seed=int(a.seed)), a.out))
    elif a.command == "void":
        for name, df in s.void_stats().items():
            print(name)
            show(df)
    return 0


if __name__ == "__main__":
    sys.exit(main())
