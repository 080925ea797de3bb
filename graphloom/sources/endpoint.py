"""A remote SPARQL endpoint as a graph: each pattern is a SELECT over HTTP, read by a Python data source."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.terms import LANG_STRING, XSD, Term, term
from ..operators.graph import FrameGraph, Graph

TIMEOUT = 60


def post(url: str, query: str) -> dict:
    body = urllib.parse.urlencode({"query": query}).encode()
    request = urllib.request.Request(url, body, {"Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return json.loads(answer.read())


def ask(url: str, query: str) -> bool:
    return bool(post(url, query)["boolean"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.query = options["url"], options["query"]
        self.names = options["variables"].split(",")
        self.pages, self.rows = int(options.get("pages", 1)), int(options.get("rows", 0))

    def partitions(self):
        return [InputPartition(k) for k in range(self.pages)]

    def read(self, partition):
        text = self.query + (f" LIMIT {self.rows} OFFSET {partition.value * self.rows}" if self.rows else "")
        for b in post(self.url, text)["results"]["bindings"]:
            row = []
            for n in self.names:
                x = b.get(n)
                if x is None:
                    row += [None] * 4
                else:
                    kind = {"uri": "iri", "bnode": "bnode"}.get(x["type"], "literal")
                    lang = x.get("xml:lang", "").lower()
                    row += [kind, ("_:" if kind == "bnode" else "") + x["value"], "" if kind != "literal" else LANG_STRING if lang else x.get("datatype", XSD + "string"), lang]
            yield tuple(row)


class EndpointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql_endpoint"

    def schema(self) -> str:
        return ", ".join(f"`{n}_{f}` string" for n in self.options["variables"].split(",") for f in ("k", "lex", "dt", "lang"))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def select(spark: SparkSession, url: str, query: str, variables: list[str], pages: int = 1, rows: int = 0) -> DataFrame:
    """A term column for each variable. With rows, `pages` tasks ask for as many rows each; the query should then be ordered."""
    spark.dataSource.register(EndpointSource)
    raw = spark.read.format("sparql_endpoint").options(url=url, query=query, variables=",".join(variables), pages=str(pages), rows=str(rows)).load()
    return raw.select(*(F.when(F.col(f"{n}_k").isNotNull(), term(*(F.col(f"{n}_{f}") for f in ("k", "lex", "dt", "lang")))).alias(n) for n in variables))


class _Lines(DataSourceReader):
    """The N-Triples lines of a CONSTRUCT or DESCRIBE, asked for by a task."""

    def __init__(self, options: dict):
        self.url, self.query = options["url"], options["query"]

    def read(self, partition):
        body = urllib.parse.urlencode({"query": self.query}).encode()
        request = urllib.request.Request(self.url, body, {"Accept": "application/n-triples"})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            for line in answer:
                yield (line.decode().rstrip("\n"),)


class EndpointLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql_endpoint_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Lines(dict(self.options))


def construct(spark: SparkSession, url: str, query: str) -> FrameGraph:
    """The triples of a CONSTRUCT or DESCRIBE at an endpoint that answers in N-Triples."""
    from .rdf import from_lines

    spark.dataSource.register(EndpointLines)
    lines = spark.read.format("sparql_endpoint_lines").options(url=url, query=query).load()
    return FrameGraph(from_lines(lines).select("s", "p", "o").distinct())


class EndpointGraph(Graph):
    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, url

    def pattern(self, s=None, p=None, o: Term | None = None) -> DataFrame:
        known = {"s": f"<{s}>" if s else None, "p": f"<{p}>" if p else None, "o": str(o) if o else None}
        text = "SELECT * WHERE { " + " ".join(known[n] or f"?{n}" for n in "spo") + " }"
        asked = [n for n in "spo" if known[n] is None]
        if not asked:
            found = ask(self.url, text.replace("SELECT * WHERE", "ASK"))
            df = self.spark.range(1 if found else 0).select()
        else:
            df = select(self.spark, self.url, text, asked)
        node = lambda n, x: F.col(f"{n}.lex") if n in asked else F.lit(x)
        obj = F.col("o") if "o" in asked else term(o.k, o.lex, o.dt, o.lang)
        return df.select(node("s", s).alias("s"), node("p", p).alias("p"), obj.alias("o"))
