"""The façade: load graphs and schemas, validate, query, convert, compare, generate. Results are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import Term
from .operators import generate, stats
from .operators.graph import FederatedGraph, FrameGraph, Graph
from .plans import pgschema, shacl, shex, sparql
from .plans.sparql_parser import classify
from .sources import convert, dctap, lift, rdf, shex_text, turtle


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.graph, self.prefixes = spark, None, {}
        self.shacl_schema = self.shex_schema = self.shape_map_rows = self.pg_schema = self.pg_graph = self.typemap = self.tap = None

    # data
    def load_data(self, source: str | list[str], kind: str | None = None, merge: bool = False, mode: str = "strict", base: str = "") -> Graph:
        """Files (paths) or, with a kind and a text that is no path, a document."""
        if isinstance(source, str) and ("\n" in source or " " in source.strip()):
            new = rdf.from_text(self.spark, source, kind or "turtle", base, mode)
            if (kind or "turtle") == "turtle":
                self.prefixes.update(turtle.parse(source, base, mode == "strict")[1])
        else:
            new = rdf.read_rdf(self.spark, source, kind, base, mode)
        self.graph = self.graph.merge(new) if merge and self.graph is not None else new
        return self.graph

    def from_tables(self, sf_dir: str, *tables: str) -> Graph:
        self.graph = lift.from_tables(self.spark, sf_dir, tables) if tables else lift.from_tables(self.spark, sf_dir)
        return self.graph

    def use(self, graph: Graph, **others: Graph) -> Graph:
        self.graph = FederatedGraph(graph, **others) if others else graph
        return self.graph

    def reset_data(self) -> None:
        self.graph, self.prefixes = None, {}

    def serialize_data(self, kind: str = "turtle", path: str | None = None):
        if path is not None:
            return rdf.write_rdf(self.graph.triples(), path)
        if kind == "turtle":
            return rdf.to_turtle(self.graph.triples(), self.prefixes)
        if kind == "ntriples":
            return "\n".join(r.value for r in rdf.to_lines(self.graph.triples()).collect()) + "\n"
        raise rdf.RdfSyntaxError(f"writing {kind} isn't supported")

    def show_node_info(self, *nodes: str, depth: int = 1, direction: str = "both", predicates=None) -> DataFrame:
        return self.graph.neighbourhood(self.spark.createDataFrame([(n,) for n in nodes], "node string"), depth, direction, predicates)

    # queries
    def run_query(self, text: str) -> DataFrame:
        return sparql.query(self.graph, text, self.prefixes)

    def query_text(self, text: str, kind: str = "markdown", most: int = 10_000) -> str:
        """A small result as Markdown, CSV or JSON, with IRIs in short form; ASK as true or false; CONSTRUCT as Turtle."""
        df = self.run_query(text)
        form = classify(text)
        if form == "ASK":
            return str(df.collect()[0]["result"]).lower()
        if form in ("CONSTRUCT", "DESCRIBE"):
            return rdf.to_turtle(df, self.prefixes, most)
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows; write the DataFrame instead")
        return convert.table_text(df.columns, [[convert.qualify(c, self.prefixes) for c in r] for r in rows], kind)

    # schemas and validation
    def load_shacl_shapes(self, text: str | None = None, kind: str = "turtle") -> shacl.Schema:
        """From a document, or from the data graph if there is none."""
        if text is None:
            rows = [(r.s, r.p, Term(r.o.k, r.o.lex, r.o.dt, r.o.lang)) for r in self.graph.triples().collect()]
            self.shacl_schema = shacl.parse_schema(rows, self.prefixes)
        elif kind == "turtle":
            self.shacl_schema = shacl.parse_schema(*turtle.parse(text))
        else:
            self.shacl_schema = shacl.parse_schema(rdf.parse_text(text, kind))
        return self.shacl_schema

    def validate_shacl(self, mode: str = "native", sort: str | None = None) -> DataFrame:
        report = shacl.validate(self.graph, self.shacl_schema, mode)
        return shacl.sort_report(report, sort) if sort else report

    def load_shex_schema(self, text: str, kind: str = "shexc", base: str = "", resolve=None) -> shex.Schema:
        self.shex_schema = shex_text.load(text, kind, base, resolve)
        return self.shex_schema

    def check_shex_schema(self) -> None:
        self.shex_schema.check()

    def load_shapemap(self, text: str) -> list:
        self.shape_map_rows = shex_text.parse_shapemap(text, {**self.prefixes, **(self.shex_schema.prefixes if self.shex_schema else {})})
        return self.shape_map_rows

    def validate_shex(self, externals=None, sort: str | None = None) -> DataFrame:
        got = shex.Validator(self.graph, self.shex_schema, externals).validate(shex.shape_map(self.graph, self.shape_map_rows))
        return got.orderBy(sort) if sort else got

    def materialize(self, label: str, state: DataFrame) -> FrameGraph:
        return FrameGraph(shex.materialize(self.shex_schema, label, state))

    def load_pg(self, graph: str | None = None, schema: str | None = None, typemap: str | None = None, mode: str = "native") -> None:
        if graph is not None:
            self.pg_graph = pgschema.PropertyGraph.of(self.spark, *pgschema.parse_graph(graph))
        if schema is not None:
            self.pg_schema = pgschema.parse_schema(schema, mode)
        if typemap is not None:
            self.typemap = self.spark.createDataFrame(pgschema.parse_typemap(typemap), "element_id string, type_name string, expected boolean")

    def validate_pgschema(self) -> DataFrame:
        return self.pg_graph.validate(self.pg_schema, self.typemap)

    def load_dctap(self, text: str) -> list:
        self.tap = dctap.parse(text)
        return self.tap

    # conversion, comparison, generation, statistics
    def show_schema_conversion(self, source: str, target: str, **kw) -> str:
        own = {"shacl": self.shacl_schema, "shex": self.shex_schema, "dctap": self.tap}[source]
        return convert.convert(own, source, target, self.prefixes, **kw)

    def show_schema_comparison(self, first, second) -> DataFrame:
        df = lambda s: self.spark.createDataFrame([(x,) for x in sorted(convert.predicates(s))], "predicate string")
        return stats.compare_schemas(df(first), df(second))

    def generate_data(self, shapes: list[generate.Shape] | None = None, total: int = 100, **kw) -> FrameGraph:
        own = shapes or convert.to_generator(self.shex_schema or self.shacl_schema)
        return FrameGraph(generate.generate(self.spark, own, total, **kw))

    def void_stats(self) -> dict[str, DataFrame]:
        return {"graph": stats.graph_stats(self.graph), "classes": stats.class_counts(self.graph), "properties": stats.property_partition(self.graph), "class_properties": stats.class_property_partition(self.graph)}

    def conformance_metrics(self, schema) -> DataFrame:
        rows = [(cls, p, high) for cls, p, _, high in convert.constraints(schema)]
        return stats.conformance_metrics(self.graph, self.spark.createDataFrame(rows, "class string, property string, most int"))

    def plantuml(self, most: int = 1000) -> str:
        return convert.graph_uml(self.graph.triples().limit(most + 1).select("s", "p", F.col("o.k").alias("k"), F.col("o.lex").alias("lex")).collect()[:most], self.prefixes)
