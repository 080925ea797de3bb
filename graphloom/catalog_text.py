"""Registered queries of readers, writers and text formats, and of modes and functions that the first catalog leaves out.

Readers and writers are run as round trips: a lifted table is written in a format to the shared folder, read back
and held against the table's SQL. Schemas are given as text of their formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import CUSTOMER, CUSTOMER_NATION, EX, LINE, NATION, NATION_REGION, ORACLES, ORDER, ORDER_CUSTOMER, PART, PREFIX, QUERIES, REGION, SUPPLIER, C, S, lines, p, register, sparql_query
from .functions.terms import RDF, SUBCLASS, TYPE, XSD, Term, iri, literal, resource, term
from .operators import generate, stats
from .operators.graph import FederatedGraph, FrameGraph
from .operators.paths import Alt, Inv, lists, scratch
from .plans import pgschema as pg
from .plans import shacl, shex, sparql
from .plans.shacl import conforms
from .sources import convert, dctap, rdf, service, shex_text, turtle
from .sources.lift import from_tables, key_iri
from .sources.shexr import parse_shexr

# readers and writers

_ORDER_ARCS = (f"SELECT {ORDER} AS s, '{EX}o_orderstatus' AS p, o_orderstatus AS value, NULL::DOUBLE AS num FROM orders UNION ALL SELECT {ORDER}, '{EX}o_custkey', {ORDER_CUSTOMER}, NULL FROM orders "
               f"UNION ALL SELECT {ORDER}, '{EX}o_totalprice', NULL, o_totalprice FROM orders")  # fmt: skip


def _orders(spark, d) -> DataFrame:
    g = from_tables(spark, d, ("orders",))
    return g.pattern(p=EX + "o_orderstatus").unionByName(g.pattern(p=EX + "o_custkey")).unionByName(g.pattern(p=EX + "o_totalprice"))


def _values(df: DataFrame) -> DataFrame:
    """Numbers as numbers, since their texts differ by writer."""
    return df.select("s", "p", F.when(F.col("o.num").isNull(), F.col("o.lex")).alias("value"), F.col("o.num").alias("num"))


def _round_trip(kind: str):
    def run(spark, d):
        path = scratch(spark, kind)
        rdf.write_rdf(_orders(spark, d), path, kind=kind)
        return _values(rdf.read_rdf(spark, path, kind).triples())

    return run


for _kind in ("ntriples", "turtle", "rdfxml", "jsonld"):
    QUERIES[f"io_{_kind}"], ORACLES[f"io_{_kind}"] = _round_trip(_kind), _ORDER_ARCS

_TEXT = "SELECT '" + EX + "documents/' || doc_id AS s, lang, text AS value FROM documents WHERE text IS NOT NULL"


def _texts(kind: str):
    """Whole texts as language-tagged literals: line feeds, quotes and other characters are escaped."""

    def run(spark, d):
        path = scratch(spark, kind)
        rdf.write_rdf(from_tables(spark, d, ("documents",)).pattern(p=EX + "text"), path, kind=kind, per_document=2000)
        return rdf.read_rdf(spark, path, kind).triples().select("s", F.col("o.lang").alias("lang"), F.col("o.lex").alias("value"))

    return run


for _kind in ("ntriples", "rdfxml", "jsonld"):
    QUERIES[f"io_{_kind}_texts"], ORACLES[f"io_{_kind}_texts"] = _texts(_kind), _TEXT


def _quads(spark, d) -> FrameGraph:
    """Orders by status in named graphs; those of status P are in that of O as well."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    names = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("P"), F.lit("O"))).otherwise(F.array("o_orderstatus"))
    rows = orders.select(key_iri("orders", "o_orderkey").alias("s"), F.lit(EX + "o_custkey").alias("p"), resource(key_iri("customer", "o_custkey")).alias("o"), F.explode(names).alias("n"))
    return FrameGraph(rows.select("s", "p", "o", F.concat(F.lit(EX + "graph/"), "n").alias("g")))


@register("io_nquads", f"SELECT {ORDER} AS s, {ORDER_CUSTOMER} AS value, '{EX}graph/' || o_orderstatus AS g FROM orders UNION ALL SELECT {ORDER}, {ORDER_CUSTOMER}, '{EX}graph/O' FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    path = scratch(spark, "nquads")
    rdf.write_rdf(_quads(spark, d).df, path, kind="nquads")
    return rdf.read_rdf(spark, path, "nquads").df.select("s", F.col("o.lex").alias("value"), "g")


@register("quads_pattern_is_a_set", f"SELECT {ORDER} AS s, {ORDER_CUSTOMER} AS value FROM orders")
def _(spark, d):
    return _quads(spark, d).pattern(p=EX + "o_custkey").select("s", F.col("o.lex").alias("value"))


@register("io_merge", f"SELECT {ORDER} AS s, o_orderstatus AS value FROM orders UNION ALL SELECT {ORDER}, o_orderpriority FROM orders")
def _(spark, d):
    """Two files that share triples are merged as sets."""
    g, first, second = from_tables(spark, d, ("orders",)), scratch(spark, "first"), scratch(spark, "second")
    both = g.pattern(p=EX + "o_orderstatus").unionByName(g.pattern(p=EX + "o_orderpriority"))
    rdf.write_rdf(both, first)
    rdf.write_rdf(g.pattern(p=EX + "o_orderstatus"), second)
    return rdf.read_rdf(spark, [first, second], "ntriples").triples().select("s", F.col("o.lex").alias("value"))


@register("io_lax", f"SELECT {ORDER} AS s FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, d):
    """Lines that are no triples are skipped in lax mode: those of status F are cut."""
    path = scratch(spark, "lax")
    cut = rdf.to_lines(from_tables(spark, d, ("orders",)).pattern(p=EX + "o_orderstatus")).select(F.when(F.col("value").contains('"F"'), F.expr("substring(value, 1, length(value) - 3)")).otherwise(F.col("value")).alias("value"))
    cut.write.text(path)
    return rdf.read_rdf(spark, path, "ntriples", mode="lax").triples().select("s")


@register("contains_triple", "SELECT true AS there, false AS absent FROM region WHERE r_regionkey = 1")
def _(spark, d):
    g = from_tables(spark, d, ("nation", "region"))
    at = EX + "nation/0", EX + "n_regionkey"
    region = g.object_for(spark.createDataFrame([(at[0],)], "node string"), at[1]).first()["value"]["lex"]
    return spark.createDataFrame([(g.contains(*at, iri(region)), g.contains(*at, iri(EX + "region/none")))], "there boolean, absent boolean")


@register("closure_of_node", f"SELECT DISTINCT x.s, x.p, x.value FROM (SELECT {ORDER} AS s, '{EX}o_custkey' AS p, {ORDER_CUSTOMER} AS value, o_custkey AS c FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT {CUSTOMER}, '{EX}c_nationkey', {CUSTOMER_NATION}, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) x")
def _(spark, d):
    """What is reached from dear orders through resources; arcs to resources alone are shown, types left out."""
    g = from_tables(spark, d, ("orders", "customer"))
    dear = g.pattern(p=EX + "o_totalprice").where(F.col("o.num") > 300000).select(F.col("s").alias("node"))
    t = g.closure_of(dear)
    return t.where((F.col("o.k") == "iri") & (F.col("p") != TYPE)).select("s", "p", F.col("o.lex").alias("value"))


@register("incoming_from_list", f"SELECT {ORDER_CUSTOMER} AS node, {ORDER} AS s FROM orders")
def _(spark, d):
    listed, _rest = from_tables(spark, d, ("orders", "customer")).incoming_from_list([EX + "o_custkey"])
    return listed.select("node", "s")


def _reified(spark, d) -> FrameGraph:
    """Each customer's segment with a reifier, of whose confidence something is said."""
    customer = spark.read.parquet(f"{d}/customer.parquet")
    me, by = key_iri("customer", "c_custkey"), F.concat(F.lit(EX + "claim/"), F.col("c_custkey").cast("string"))
    seg = term("literal", F.col("c_mktsegment"), XSD + "string")
    quoted = F.concat(F.lit("<<( <"), me, F.lit(f'> <{EX}c_mktsegment> "'), F.col("c_mktsegment"), F.lit('" )>>'))
    arcs = F.array(
        F.struct(me.alias("s"), F.lit(EX + "c_mktsegment").alias("p"), seg.alias("o")),
        F.struct(by.alias("s"), F.lit(RDF + "reifies").alias("p"), term("triple", F.when(F.col("c_custkey") % 3 > 0, quoted)).alias("o")),
        F.struct(by.alias("s"), F.lit(EX + "sure").alias("p"), term("literal", (F.col("c_custkey") % 2).cast("string"), XSD + "integer").alias("o")),
    )
    return FrameGraph(customer.select(F.explode(arcs).alias("a")).select("a.*").where(F.col("o.lex").isNotNull()))


@register("shacl_reifiers", f"SELECT {CUSTOMER} AS focus, CASE WHEN c_custkey % 3 = 0 THEN 'reificationRequired' ELSE 'reifierShape' END AS component FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def _(spark, d):
    seg = S("urn:seg", p("c_mktsegment"), (("subjectsOf", EX + "c_mktsegment"),), (C("reifier", ("urn:sure", True)),))
    sure = S("urn:sure", constraints=(C("property", ("urn:value",)),))
    value = S("urn:value", p("sure"), constraints=(C("hasValue", (Term("literal", "1", XSD + "integer"),)),))
    return shacl.validate(_reified(spark, d), shacl.Schema.of(seg, sure, value)).select("focus", "component")


@register("reifiers_of", f"SELECT '{EX}claim/1' AS node FROM customer WHERE c_custkey = 1")
def _(spark, d):
    g = _reified(spark, d)
    seg = g.pattern(s=EX + "customer/1", p=EX + "c_mktsegment").first()["o"]["lex"]
    return g.reifiers_of(f'<<( <{EX}customer/1> <{EX}c_mktsegment> "{seg}" )>>')


@register("rdf_lists", f"SELECT {ORDER} AS head, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS position, l_linenumber AS value FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey AS o_orderkey FROM lineitem)")
def _(spark, d):
    """Each order's line numbers as an RDF list, read back with positions."""
    from pyspark.sql.window import Window

    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    cell = lambda n: F.when(n == 1, key_iri("orders", "l_orderkey")).otherwise(F.concat(F.lit("_:c"), F.col("l_orderkey").cast("string"), F.lit("x"), n.cast("string")))
    last = F.count("*").over(Window.partitionBy("l_orderkey")) == F.col("k")
    placed = rows.withColumn("k", k).withColumn("last", last)
    value = term("literal", F.col("l_linenumber").cast("string"), XSD + "integer", "", F.col("l_linenumber"))
    rest = F.when(F.col("last"), resource(F.lit(RDF + "nil"))).otherwise(resource(cell(F.col("k") + 1)))
    arcs = F.array(F.struct(F.lit(RDF + "first").alias("p"), value.alias("o")), F.struct(F.lit(RDF + "rest").alias("p"), rest.alias("o")))
    g = FrameGraph(placed.select(cell(F.col("k")).alias("s"), F.explode(arcs).alias("a")).select("s", "a.p", "a.o"))
    heads = rows.select(key_iri("orders", "l_orderkey").alias("node")).distinct()
    return lists(g, heads).select("head", F.col("position").cast("bigint").alias("position"), F.col("value.num").cast("int").alias("value"))


# SHACL from text, other modes and targets

_SHAPES = f"""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <{XSD}> . @prefix : <{EX}> .
:CustomerShape a sh:NodeShape ; sh:targetClass :Customer ;
  sh:property [ sh:path :c_acctbal ; sh:minInclusive 0.0 ; sh:severity sh:Warning ; sh:message "balance"@en, "saldo"@de ] ;
  sh:property [ sh:path :c_mktsegment ; sh:in ( "BUILDING" "MACHINERY" "FURNITURE" ) ] ;
  sh:property [ sh:path [ sh:inversePath :o_custkey ] ; sh:maxCount 12 ] ;
  sh:not [ sh:path :c_name ; sh:pattern "9$" ] .
"""
_SHAPES_SQL = f"""
SELECT {CUSTOMER} AS focus, 'minInclusive' AS component, 'Warning' AS severity FROM customer WHERE c_acctbal < 0
UNION ALL SELECT {CUSTOMER}, 'in', 'Violation' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
UNION ALL SELECT {ORDER_CUSTOMER}, 'maxCount', 'Violation' FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey HAVING count(*) > 12
UNION ALL SELECT {CUSTOMER}, 'not', 'Violation' FROM customer WHERE c_name LIKE '%9'
"""


@register("shacl_text", _SHAPES_SQL)
def _(spark, d):
    return shacl.validate(from_tables(spark, d, ("customer", "orders")), shacl.parse_schema(*turtle.parse(_SHAPES))).select("focus", "component", "severity")


@register("shacl_messages", f"SELECT {CUSTOMER} AS focus, 'balance' AS en, 'saldo' AS de FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    schema = shacl.parse_schema(*turtle.parse(_SHAPES))
    report = shacl.validate(from_tables(spark, d, ("customer", "orders")), schema).where("component = 'minInclusive'")
    return shacl.with_messages(report, schema).select("focus", F.col("messages")["en"].alias("en"), F.col("messages")["de"].alias("de"))


@register("shacl_report_back", _SHAPES_SQL)
def _(spark, d):
    """The report as triples, written, read and turned into rows again."""
    path = scratch(spark, "report")
    rdf.write_rdf(shacl.report_triples(shacl.validate(from_tables(spark, d, ("customer", "orders")), shacl.parse_schema(*turtle.parse(_SHAPES)))), path)
    return shacl.read_report(rdf.read_rdf(spark, path, "ntriples")).select("focus", "component", "severity")


@register("shacl_conforms", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal < -100000) = 0 AS rich, (SELECT count(*) FROM customer WHERE c_acctbal < 0) = 0 AS solvent")
def _(spark, d):
    g = from_tables(spark, d, ("customer",))
    ok = [conforms(shacl.validate(g, shacl.Schema.of(S("urn:s", p("c_acctbal"), (("subjectsOf", EX + "c_acctbal"),), (C("minInclusive", (Term("literal", x, XSD + "double"),)),))))) for x in ("-100000", "0")]
    return spark.createDataFrame([tuple(ok)], "rich boolean, solvent boolean")


def _classes(spark, d) -> FederatedGraph:
    """The customers and suppliers with a hierarchy of three levels above them, of which one is a shape itself."""
    rows = [(EX + "Customer", SUBCLASS, iri(EX + "Partner")), (EX + "Supplier", SUBCLASS, iri(EX + "Partner")), (EX + "Partner", SUBCLASS, iri(EX + "Agent"))]
    return FederatedGraph(from_tables(spark, d, ("customer", "supplier")), hierarchy=FrameGraph.of(spark, rows))


def _by_class(kind: str, cls: str, mode: str):
    def run(spark, d):
        shape = S("urn:s", targets=((kind, EX + cls),), constraints=(C("property", ("urn:b",)),))
        balance = S("urn:b", p("c_acctbal"), constraints=(C("minCount", (1,)), C("maxCount", (1,)), C("minInclusive", (Term("literal", "0", XSD + "double"),))))
        return shacl.validate(_classes(spark, d), shacl.Schema.of(shape, balance), mode).select("focus", "component")

    return run


_AGENTS = f"SELECT {CUSTOMER} AS focus, 'minInclusive' AS component FROM customer WHERE c_acctbal < 0 UNION ALL SELECT {SUPPLIER}, 'minCount' FROM supplier"
for _name, _kind, _cls, _mode, _sql in (
    ("shacl_target_class_spec", "class", "Agent", "spec", _AGENTS),
    ("shacl_target_class_native", "class", "Customer", "native", f"SELECT {CUSTOMER} AS focus, 'minInclusive' AS component FROM customer WHERE c_acctbal < 0"),
    ("shacl_implicit_class", "implicit", "Partner", "native", _AGENTS),
    ("shacl_implicit_class_spec", "implicit", "Agent", "spec", _AGENTS),
):
    QUERIES[_name], ORACLES[_name] = _by_class(_kind, _cls, _mode), _sql


def _plain_spec(tables, cls: str, *constraints, path=None, graph=from_tables):
    def run(spark, d):
        shape = S("urn:s", targets=(("class", EX + cls),), constraints=(C("property", ("urn:p",)),))
        return shacl.validate(graph(spark, d, tables), shacl.Schema.of(shape, S("urn:p", path, constraints=constraints)), "spec").select("focus", "component")

    return run


QUERIES["shacl_max_count_spec"] = _plain_spec(("customer", "orders"), "Customer", C("maxCount", (12,)), path=Inv(p("o_custkey")))
ORACLES["shacl_max_count_spec"] = f"SELECT {ORDER_CUSTOMER} AS focus, 'maxCount' AS component FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey HAVING count(*) > 12"
QUERIES["shacl_lengths_spec"] = _plain_spec(("documents",), "Documents", C("minLength", (2000,)), C("maxLength", (4000,)), path=p("text"))
ORACLES["shacl_lengths_spec"] = f"SELECT '{EX}documents/' || doc_id AS focus, 'minLength' AS component FROM documents WHERE length(text) < 2000 UNION ALL SELECT '{EX}documents/' || doc_id, 'maxLength' FROM documents WHERE length(text) > 4000"
@register("shacl_class_spec", f"SELECT {CUSTOMER} AS focus, 'class' AS component, {CUSTOMER_NATION} AS value FROM customer")
def _(spark, d):
    """Customers are agents two levels up, nations aren't."""
    above = FrameGraph.of(spark, [(EX + "Customer", SUBCLASS, iri(EX + "Partner")), (EX + "Partner", SUBCLASS, iri(EX + "Agent"))])
    shape = S("urn:s", Alt((p("o_custkey"), p("c_nationkey"))), (("subjectsOf", EX + "o_custkey"), ("subjectsOf", EX + "c_nationkey")), (C("class", (EX + "Agent",)),))
    return shacl.validate(FederatedGraph(from_tables(spark, d, ("orders", "customer", "nation")), hierarchy=above), shacl.Schema.of(shape), "spec").select("focus", "component", "value")


@register("shacl_deactivated", f"SELECT {CUSTOMER} AS focus, 'minInclusive' AS component FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    node = S("urn:n", targets=(("class", EX + "Customer"),), constraints=(C("property", ("urn:a",)), C("property", ("urn:b",))))
    a = S("urn:a", p("c_acctbal"), constraints=(C("minInclusive", (Term("literal", "0", XSD + "double"),)),))
    b = S("urn:b", p("c_name"), constraints=(C("maxLength", (1,)),), deactivated=True)
    off = S("urn:off", p("c_name"), (("class", EX + "Customer"),), (C("maxLength", (1,)),), deactivated=True)
    return shacl.validate(from_tables(spark, d, ("customer",)), shacl.Schema.of(node, a, b, off)).select("focus", "component")


@register("shacl_single_focus", f"SELECT {CUSTOMER} AS focus FROM customer WHERE c_acctbal < 0 AND c_nationkey = 3")
def _(spark, d):
    """Only some focus nodes are looked at: customers of one nation."""
    g = from_tables(spark, d, ("customer",))
    some = g.pattern(p=EX + "c_nationkey", o=iri(EX + "nation/3")).select(F.col("s").alias("node"))
    schema = shacl.Schema.of(S("urn:s", p("c_acctbal"), (("class", EX + "Customer"),), (C("minInclusive", (Term("literal", "0", XSD + "double"),)),)))
    return shacl.Validator(g, schema).validate(only=["urn:s"], nodes=some).select("focus")


# ShEx from text

_SHEXC = f"""
PREFIX : <{EX}> PREFIX xsd: <{XSD}>
start = @:OrderShape
:OrderShape {{ :o_orderstatus [ "F" "O" ] ; :o_totalprice xsd:double MININCLUSIVE 50000 ; :o_custkey @:CustomerShape }}
:CustomerShape {{ :c_mktsegment [ "B"~ "M"~ ] ; :c_acctbal xsd:double MINEXCLUSIVE 0 }}
"""
_SHEXJ = f"""{{"type": "Schema", "start": "{EX}OrderShape", "shapes": [
{{"type": "Shape", "id": "{EX}OrderShape", "expression": {{"type": "EachOf", "expressions": [
  {{"type": "TripleConstraint", "predicate": "{EX}o_orderstatus", "valueExpr": {{"type": "NodeConstraint", "values": [{{"value": "F"}}, {{"value": "O"}}]}}}},
  {{"type": "TripleConstraint", "predicate": "{EX}o_totalprice", "valueExpr": {{"type": "NodeConstraint", "datatype": "{XSD}double", "mininclusive": 50000}}}},
  {{"type": "TripleConstraint", "predicate": "{EX}o_custkey", "valueExpr": "{EX}CustomerShape"}}]}}}},
{{"type": "Shape", "id": "{EX}CustomerShape", "expression": {{"type": "EachOf", "expressions": [
  {{"type": "TripleConstraint", "predicate": "{EX}c_mktsegment", "valueExpr": {{"type": "NodeConstraint", "values": [{{"type": "LiteralStem", "stem": "B"}}, {{"type": "LiteralStem", "stem": "M"}}]}}}},
  {{"type": "TripleConstraint", "predicate": "{EX}c_acctbal", "valueExpr": {{"type": "NodeConstraint", "datatype": "{XSD}double", "minexclusive": 0}}}}]}}}}]}}"""
_SHEXR = f"""
@prefix sx: <http://www.w3.org/ns/shex#> . @prefix : <{EX}> . @prefix xsd: <{XSD}> .
<http://e/schema> a sx:Schema ; sx:start :OrderShape ; sx:shapes ( :OrderShape :CustomerShape ) .
:OrderShape a sx:Shape ; sx:expression [ a sx:EachOf ; sx:expressions (
  [ a sx:TripleConstraint ; sx:predicate :o_orderstatus ; sx:valueExpr [ a sx:NodeConstraint ; sx:values ( "F" "O" ) ] ]
  [ a sx:TripleConstraint ; sx:predicate :o_totalprice ; sx:valueExpr [ a sx:NodeConstraint ; sx:datatype xsd:double ; sx:mininclusive 50000 ] ]
  [ a sx:TripleConstraint ; sx:predicate :o_custkey ; sx:valueExpr :CustomerShape ] ) ] .
:CustomerShape a sx:Shape ; sx:expression [ a sx:EachOf ; sx:expressions (
  [ a sx:TripleConstraint ; sx:predicate :c_mktsegment ; sx:valueExpr [ a sx:NodeConstraint ; sx:values ( [ a sx:LiteralStem ; sx:stem "B" ] [ a sx:LiteralStem ; sx:stem "M" ] ) ] ]
  [ a sx:TripleConstraint ; sx:predicate :c_acctbal ; sx:valueExpr [ a sx:NodeConstraint ; sx:datatype xsd:double ; sx:minexclusive 0 ] ] ) ] .
"""
_SHEX_SQL = f"SELECT {ORDER} AS node, CASE WHEN coalesce(o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000 AND (c_mktsegment LIKE 'B%' OR c_mktsegment LIKE 'M%') AND c_acctbal > 0, false) THEN 'conformant' ELSE 'nonconformant' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


def _shex_text(load, shapemap: str = "{ FOCUS a :Orders }@START"):
    def run(spark, d):
        g = from_tables(spark, d, ("orders", "customer"))
        schema = load()
        schema.check()
        rows = shex.shape_map(g, shex_text.parse_shapemap(shapemap, {"": EX}))
        return shex.Validator(g, schema).validate(rows).select("node", "status")

    return run


for _name, _load in (
    ("shexc", lambda: shex_text.parse_shexc(_SHEXC)),
    ("shexj", lambda: shex_text.parse_shexj(_SHEXJ)),
    ("shexr", lambda: parse_shexr(turtle.parse(_SHEXR)[0])),
    ("shexc_printed", lambda: shex_text.parse_shexc(shex_text.print_shexc(shex_text.parse_shexc(_SHEXC)))),
):
    QUERIES[f"shex_text_{_name}"], ORACLES[f"shex_text_{_name}"] = _shex_text(_load), _SHEX_SQL
QUERIES["shex_selector_sparql"] = _shex_text(lambda: shex_text.parse_shexc(_SHEXC), f'SPARQL "SELECT ?s WHERE {{ ?s <{EX}o_orderpriority> ?o }}"@START')
ORACLES["shex_selector_sparql"] = _SHEX_SQL
QUERIES["shex_selector_object"] = _shex_text(lambda: shex_text.parse_shexc(_SHEXC), "{ _ :o_custkey FOCUS }@:CustomerShape")
ORACLES["shex_selector_object"] = f"SELECT DISTINCT {ORDER_CUSTOMER} AS node, CASE WHEN coalesce((c_mktsegment LIKE 'B%' OR c_mktsegment LIKE 'M%') AND c_acctbal > 0, false) THEN 'conformant' ELSE 'nonconformant' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


@register("shex_external", f"SELECT {ORDER} AS node, CASE WHEN coalesce(c_acctbal > 1000, false) THEN 'conformant' ELSE 'nonconformant' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    g = from_tables(spark, d, ("orders", "customer"))
    schema = shex_text.parse_shexc(f"PREFIX : <{EX}> :S {{ :o_custkey @:E }} :E EXTERNAL")
    rich = g.pattern(p=EX + "c_acctbal").where(F.col("o.num") > 1000).select(F.col("s").alias("fk"))
    # the nodes that an external shape doesn't hold for
    known = lambda label, nodes: nodes.join(rich, "fk", "left_anti").select("fk")
    return shex.Validator(g, schema, [known]).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + "Orders")), EX + "S")])).select("node", "status")


@register("shex_to_sparql", f"SELECT {CUSTOMER} AS node FROM customer WHERE (c_mktsegment LIKE 'B%' OR c_mktsegment LIKE 'M%') AND c_acctbal > 0")
def _(spark, d):
    """The validator's conforming customers; that the schema's SELECT names the same predicates is in the tests."""
    g = from_tables(spark, d, ("customer",))
    schema = shex_text.parse_shexc(_SHEXC.replace("start = @:OrderShape", ""))
    got = shex.Validator(g, schema).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + "Customer")), EX + "CustomerShape")]))
    return got.where("status = 'conformant'").select("node")


# profiles and conversions

_TAP = """shapeID,propertyID,mandatory,repeatable,valueNodeType,valueDataType,valueConstraint,valueConstraintType,valueShape
:Customer,:c_mktsegment,true,false,literal,xsd:string,BUILDING MACHINERY AUTOMOBILE,picklist,
,:c_acctbal,true,false,literal,xsd:double,-500,minInclusive,
,:c_name,true,false,literal,xsd:string,[0-4]$,pattern,
"""
_TAP_GOOD = "c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_acctbal >= -500 AND regexp_matches(c_name, '[0-4]$')"


@register("dctap_to_shex", f"SELECT {CUSTOMER} AS node, CASE WHEN {_TAP_GOOD} THEN 'conformant' ELSE 'nonconformant' END AS status FROM customer")
def _(spark, d):
    g = from_tables(spark, d, ("customer",))
    schema = dctap.to_shex(dctap.parse(_TAP), {"": EX, "xsd": XSD})
    return shex.Validator(g, schema).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + "Customer")), EX + "Customer")])).select("node", "status")


@register("dctap_to_shacl", f"SELECT {CUSTOMER} AS focus, 'in' AS component FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') UNION ALL SELECT {CUSTOMER}, 'minInclusive' FROM customer WHERE c_acctbal < -500 UNION ALL SELECT {CUSTOMER}, 'pattern' FROM customer WHERE NOT regexp_matches(c_name, '[0-4]$')")
def _(spark, d):
    from dataclasses import replace

    schema = dctap.to_shacl(dctap.parse(_TAP), {"": EX, "xsd": XSD})
    schema.shapes[EX + "Customer"] = replace(schema.shapes[EX + "Customer"], targets=(("class", EX + "Customer"),))
    return shacl.validate(from_tables(spark, d, ("customer",)), schema).select("focus", "component")


@register("shacl_to_shex", f"SELECT {CUSTOMER} AS node, CASE WHEN c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'conformant' ELSE 'nonconformant' END AS status FROM customer")
def _(spark, d):
    text = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <{EX}> . :T a sh:NodeShape ; sh:targetClass :Customer ;
      sh:property [ sh:path :c_acctbal ; sh:minInclusive 0.0 ; sh:minCount 1 ; sh:maxCount 1 ] ; sh:property [ sh:path :c_mktsegment ; sh:in ( "BUILDING" "FURNITURE" ) ; sh:minCount 1 ; sh:maxCount 1 ] ."""
    g, schema = from_tables(spark, d, ("customer",)), convert.shacl_to_shex(shacl.parse_schema(*turtle.parse(text)))
    return shex.Validator(g, schema).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + "Customer")), EX + "T")])).select("node", "status")


# SPARQL: optional variables, named graphs, functions

_TAGGED = "(SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS seg FROM customer)"
sparql_query("sparql_optional_chain", "SELECT ?c ?o ?p WHERE { ?c a :Customer OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER (?t > 350000) } OPTIONAL { ?o :o_orderpriority ?p } }", ("customer", "orders"),
             f"WITH a AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000) SELECT {CUSTOMER} AS c, {ORDER} AS o, o_orderpriority AS p FROM a JOIN orders USING (o_orderkey) UNION ALL SELECT {CUSTOMER}, '{EX}orders/' || b.o_orderkey, o_orderpriority FROM a CROSS JOIN orders b WHERE a.o_orderkey IS NULL")
sparql_query("sparql_optional_join", "SELECT ?c ?n ?r WHERE { ?c a :Supplier OPTIONAL { ?c :s_acctbal ?b ; :s_nationkey ?n FILTER (?b > 0) } ?n :n_regionkey ?r }", ("supplier", "nation"),
             f"SELECT {SUPPLIER} AS c, {NATION} AS n, {NATION_REGION} AS r FROM supplier JOIN nation ON CASE WHEN s_acctbal > 0 THEN s_nationkey = n_nationkey ELSE true END")
sparql_query("sparql_two_optionals", "SELECT ?c ?v WHERE { ?c a :Supplier OPTIONAL { ?c :s_acctbal ?b FILTER (?b > 3000) ?c :s_nationkey ?v } OPTIONAL { ?c :s_nationkey ?v } }", ("supplier",),
             f"SELECT {SUPPLIER} AS c, '{EX}nation/' || s_nationkey AS v FROM supplier")
sparql_query("sparql_minus_optional", "SELECT ?c ?n WHERE { ?c a :Supplier OPTIONAL { ?c :s_acctbal ?b ; :s_nationkey ?n FILTER (?b > 0) } MINUS { ?n :n_regionkey :none } MINUS { ?n :n_name 'NATION_1' } }", ("supplier", "nation"),
             f"SELECT {SUPPLIER} AS c, CASE WHEN s_acctbal > 0 THEN '{EX}nation/' || s_nationkey END AS n FROM supplier WHERE NOT (s_acctbal > 0 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_1'))")
sparql_query("sparql_numbers", "SELECT ?o (ABS(?t - 100000) AS ?a) (FLOOR(?t) AS ?f) (CEIL(?t) AS ?u) (ROUND(?t) AS ?r) WHERE { ?o :o_totalprice ?t FILTER (?t > 200000 && ?t / 2 < 150000) }", ("orders",),
             f"SELECT {ORDER} AS o, abs(o_totalprice - 100000) AS a, floor(o_totalprice) AS f, ceil(o_totalprice) AS u, floor(o_totalprice + 0.5) AS r FROM orders WHERE o_totalprice > 200000 AND o_totalprice / 2 < 150000", a="double", f="double", u="double", r="double")
sparql_query("sparql_hashes", "SELECT ?c (SHA1(?n) AS ?a) (SHA256(?n) AS ?b) (MD5(?n) AS ?m) WHERE { ?c :c_name ?n }", ("customer",), f"SELECT {CUSTOMER} AS c, sha1(c_name) AS a, sha256(c_name) AS b, md5(c_name) AS m FROM customer")
sparql_query("sparql_conditionals", "SELECT ?c (COALESCE(?o, ?c) AS ?x) (IF(BOUND(?o), 'has', 'none') AS ?y) WHERE { ?c a :Customer OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus 'P' } FILTER (?c IN (:none) || ISIRI(?c)) }", ("customer", "orders"),
             f"SELECT {CUSTOMER} AS c, coalesce('{EX}orders/' || o_orderkey, {CUSTOMER}) AS x, CASE WHEN o_orderkey IS NULL THEN 'none' ELSE 'has' END AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sparql_query("sparql_constructors", "SELECT ?c (STR(IRI(CONCAT('http://x/', ?n))) AS ?i) (LANG(STRLANG(?n, 'en')) AS ?l) (STR(DATATYPE(STRDT(?n, xsd:token))) AS ?d) WHERE { ?c :c_mktsegment ?n }", ("customer",), f"SELECT {CUSTOMER} AS c, 'http://x/' || c_mktsegment AS i, 'en' AS l, '{XSD}token' AS d FROM customer")
sparql_query("sparql_strings", "SELECT ?c (LCASE(?n) AS ?a) (STRBEFORE(?n, '#') AS ?b) (REPLACE(?n, '0+', '-') AS ?r) (CONTAINS(?n, '7') AS ?h) (ENCODE_FOR_URI(?n) AS ?e) WHERE { ?c :c_name ?n FILTER (STRENDS(?n, '5')) }", ("customer",),
             f"SELECT {CUSTOMER} AS c, lower(c_name) AS a, CASE WHEN position('#' IN c_name) > 0 THEN split_part(c_name, '#', 1) ELSE '' END AS b, regexp_replace(c_name, '0+', '-', 'g') AS r, (c_name LIKE '%7%')::VARCHAR AS h, replace(c_name, '#', '%23') AS e FROM customer WHERE c_name LIKE '%5'")
sparql_query("sparql_day_and_time", "SELECT ?o (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?m) WHERE { ?o :o_orderdate ?d }", ("orders",), f"SELECT {ORDER} AS o, day(o_orderdate) AS a, hour(o_orderdate) AS h, minute(o_orderdate) AS m FROM orders", a="bigint", h="bigint", m="bigint")
sparql_query("sparql_cartesian_large", "SELECT ?a ?b WHERE { ?a :r_name ?n . ?b :o_orderstatus 'P' }", ("region", "orders"), f"SELECT {REGION} AS a, {ORDER} AS b FROM region, orders WHERE o_orderstatus = 'P'")


def _describe(spark, d):
    return sparql.query(from_tables(spark, d, ("customer",)), PREFIX + "DESCRIBE ?x WHERE { ?x :c_acctbal ?b FILTER (?b > 9500) }").where(F.col("p").isin(EX + "c_name", EX + "c_nationkey")).select("s", "p", F.col("o.lex").alias("value"))


QUERIES["sparql_describe_rows"] = _describe
ORACLES["sparql_describe_rows"] = f"SELECT {CUSTOMER} AS s, '{EX}c_name' AS p, c_name AS value FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT {CUSTOMER}, '{EX}c_nationkey', {CUSTOMER_NATION} FROM customer WHERE c_acctbal > 9500"


@register("sparql_graph_variable", f"SELECT '{EX}graph/' || o_orderstatus AS g, {ORDER} AS o FROM orders UNION ALL SELECT '{EX}graph/O', {ORDER} FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    return sparql.plain(sparql.query(_quads(spark, d), PREFIX + "SELECT ?g ?o WHERE { GRAPH ?g { ?o :o_custkey ?c } }"))


@register("sparql_from", f"SELECT {ORDER} AS o FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(spark, d):
    return sparql.plain(sparql.query(_quads(spark, d), PREFIX + f"SELECT ?o FROM <{EX}graph/F> FROM <{EX}graph/P> WHERE {{ ?o :o_custkey ?c }}"))


@register("sparql_from_named", f"SELECT '{EX}graph/P' AS g, {ORDER} AS o FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    return sparql.plain(sparql.query(_quads(spark, d), PREFIX + f"SELECT ?g ?o FROM NAMED <{EX}graph/P> WHERE {{ GRAPH ?g {{ ?o :o_custkey ?c }} }}"))


@register("sparql_service", f"SELECT {ORDER} AS o, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def _(spark, d):
    text = PREFIX + "SELECT ?o ?n WHERE { ?o :o_custkey ?c ; :o_orderstatus 'P' SERVICE <http://e/customers> { ?c :c_name ?n } }"
    return sparql.plain(sparql.query(from_tables(spark, d, ("orders",)), text, services={"http://e/customers": from_tables(spark, d, ("customer",))}))


@register("sparql_federated", f"SELECT {CUSTOMER} AS x, c_acctbal AS b FROM customer UNION ALL SELECT {SUPPLIER}, s_acctbal FROM supplier")
def _(spark, d):
    graphs = [from_tables(spark, d, (t,)) for t in ("customer", "supplier")]
    got = sparql.federated_query(graphs, PREFIX + "SELECT ?x ?b WHERE { { ?x :c_acctbal ?b } UNION { ?x :s_acctbal ?b } }")
    return got.select(F.col("x.lex").alias("x"), F.col("b.num").alias("b"))


# two-sided versions of what a query with few rows or one answer leaves open


@register("shacl_datatype_mixed", f"SELECT {CUSTOMER} AS focus, 'datatype' AS component, c_name AS value FROM customer")
def _(spark, d):
    node = S("urn:n", targets=(("class", EX + "Customer"),), constraints=(C("property", ("urn:p",)),))
    return shacl.validate(from_tables(spark, d, ("customer",)), shacl.Schema.of(node, S("urn:p", Alt((p("c_name"), p("c_acctbal"))), constraints=(C("datatype", (XSD + "double",)),)))).select("focus", "component", "value")


@register("shacl_less_than_numbers", f"SELECT {PART} AS focus, 'lessThan' AS component FROM part WHERE NOT p_size < p_partkey")
def _(spark, d):
    node = S("urn:n", targets=(("class", EX + "Part"),), constraints=(C("property", ("urn:p",)),))
    return shacl.validate(from_tables(spark, d, ("part",)), shacl.Schema.of(node, S("urn:p", p("p_size"), constraints=(C("lessThan", (EX + "p_partkey",)),)))).select("focus", "component")


@register("shex_closed", f"SELECT {SUPPLIER} AS node, CASE WHEN s_acctbal >= 2000 THEN 'conformant' ELSE 'nonconformant' END AS status FROM supplier")
def _(spark, d):
    """The balance is no EXTRA: one below the least is a triple too many."""
    g = from_tables(spark, d, ("supplier",))
    schema = shex_text.parse_shexc(f"PREFIX : <{EX}> :S CLOSED EXTRA <{TYPE}> {{ :s_name . ; :s_suppkey . ; :s_nationkey IRI ; :s_acctbal LITERAL MININCLUSIVE 2000 ? }}")
    return shex.Validator(g, schema).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + "Supplier")), EX + "S")])).select("node", "status")


@register("schema_compare_tables", f"SELECT '{EX}' || c AS predicate, CASE WHEN c LIKE 'c%' THEN 'only_first' WHEN c LIKE 's%' THEN 'only_second' ELSE 'common' END AS status FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment'), ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal'), ('n_nationkey'), ('n_name'), ('n_regionkey')) v(c)")
def _(spark, d):
    """The predicates that two graphs use."""
    used = lambda *t: from_tables(spark, d, t).triples().where(F.col("p") != TYPE).select(F.col("p").alias("predicate"))
    return stats.compare_schemas(used("customer", "nation"), used("supplier", "nation"))


@register("recorded_rows", f"SELECT {SUPPLIER} AS s, '{EX}s_acctbal' AS p FROM supplier WHERE s_acctbal IS NOT NULL")
def _(spark, d):
    from .operators.graph import RecordingGraph

    g = RecordingGraph(from_tables(spark, d, ("supplier", "nation")))
    shacl.validate(g, shacl.Schema.of(S("urn:p", p("s_acctbal"), (("subjectsOf", EX + "s_acctbal"),), (C("minCount", (1,)),))))
    return g.visited().triples().select("s", "p")


@register("merge_rows", f"SELECT {ORDER} AS s, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT {ORDER}, 'late' FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    """A merge with itself changes nothing; some triples go, and others come twice but are there once."""
    lifted = from_tables(spark, d, ("orders",))
    g = FrameGraph(lifted.pattern(p=EX + "o_orderstatus"))
    late = lifted.pattern(p=EX + "o_orderstatus", o=literal("P")).select("s", "p", F.col("o").withField("lex", F.lit("late")).alias("o"))
    return g.merge(g).remove(lifted.pattern(p=EX + "o_orderstatus", o=literal("F"))).add(late).add(late).triples().select("s", F.col("o.lex").alias("value"))


@register("class_property_partition", " UNION ALL ".join(f"SELECT '{EX}{t.capitalize()}' AS class, '{EX}{c}' AS property, count({c}) AS triples, count({c}) AS entities FROM {t}" for t, cs in (("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), ("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))) for c in cs))
def _(spark, d):
    return stats.class_property_partition(from_tables(spark, d, ("customer", "supplier")))


@register("graph_stats_large", "SELECT n * 7 AS triples, n AS subjects, 7::BIGINT AS predicates, (SELECT count(DISTINCT o_orderkey) + count(DISTINCT o_custkey) + count(DISTINCT o_orderstatus) + count(DISTINCT o_totalprice) + count(DISTINCT o_orderdate) + count(DISTINCT o_orderpriority) + 1 FROM orders) AS objects FROM (SELECT count(*) AS n FROM orders)")
def _(spark, d):
    return stats.graph_stats(from_tables(spark, d, ("orders",)))


@register("usage_large", f"SELECT {CUSTOMER} AS node, 6::BIGINT AS as_subject, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS as_object FROM customer")
def _(spark, d):
    u = stats.usage(from_tables(spark, d, ("customer", "orders")))
    return u.where(F.col("node").startswith(EX + "customer/"))


# property graphs: text formats and sinks


@register("pg_results", "SELECT 'c' || c_custkey AS element_id, 'CustomerType' AS type_name, true AS expected, (regexp_matches(c_mktsegment, '^(B|M)') AND c_nationkey >= 5 AND c_nationkey < 20) AS conforms FROM customer")
def _(spark, d):
    """Validated, written as CSV and read again."""
    from .catalog import _PGS, _property_graph

    path = scratch(spark, "pg-results")
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("element_id"), F.lit("CustomerType").alias("type_name"), F.lit(True).alias("expected"))
    pg.write_results(_property_graph(spark, d).validate(pg.parse_schema(_PGS), ids), path, "csv")
    return spark.read.option("header", True).schema("element_id string, type_name string, expected boolean, conforms boolean, agrees boolean").csv(path).drop("agrees")


@register("shex_results", _SHEX_SQL)
def _(spark, d):
    """Statuses written as CSV and read again."""
    path = scratch(spark, "shex-results")
    g = from_tables(spark, d, ("orders", "customer"))
    got = shex.Validator(g, shex_text.parse_shexc(_SHEXC)).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + "Orders")), "START")]))
    shex.write_results(got, path, "csv")
    return spark.read.option("header", True).csv(path).select("node", "status")


# generation


@register("generate_selected", f"SELECT '{EX}Person-' || (i + 1) AS s, count(*) AS n FROM generate_series(0, 19999) g(i), generate_series(1, 4) h(k) GROUP BY i")
def _(spark, d):
    """Of five optional properties two are used by each entity, beside a type and a name."""
    own = tuple(generate.Property(EX + f"extra{k}", low=0, high=1) for k in range(5))
    shape = generate.Shape(EX + "Person", (generate.Property(EX + "name", generator="person"), *own), optional=2)
    return generate.generate(spark, [shape], 20_000, "max").groupBy("s").agg(F.count(F.lit(1)).alias("n"))


# more of ShEx: included expressions, abstract shapes, imports, digits, materialisation


def _shex_focus(schema_text: str, focus: str, tables, label: str = "S", resolve=None):
    def run(spark, d):
        g = from_tables(spark, d, tables)
        schema = shex_text.load(f"PREFIX : <{EX}> PREFIX xsd: <{XSD}> " + schema_text, resolve=resolve)
        schema.check()
        return shex.Validator(g, schema).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + focus)), EX + label)])).select("node", "status")

    return run


def _status(node: str, source: str, good: str) -> str:
    return f"SELECT {node} AS node, CASE WHEN {good} THEN 'conformant' ELSE 'nonconformant' END AS status FROM {source}"


for _name, _text, _focus, _tables, _sql, _resolve in (
    ("shex_include", ":Base { $:common ( :c_acctbal MININCLUSIVE 0 ; :c_name . ) } :S { &:common ; :c_mktsegment [ 'BUILDING' 'MACHINERY' ] }".replace(":c_acctbal MIN", ":c_acctbal LITERAL MIN"), "Customer", ("customer",), _status(CUSTOMER, "customer", "c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')"), None),
    ("shex_abstract", "ABSTRACT :S { :c_name . } :Rich EXTENDS @:S { :c_acctbal LITERAL MININCLUSIVE 5000 } :Builder EXTENDS @:S { :c_mktsegment [ 'BUILDING' ] }", "Customer", ("customer",), _status(CUSTOMER, "customer", "c_acctbal >= 5000 OR c_mktsegment = 'BUILDING'"), None),
    ("shex_import", "IMPORT <http://e/other> :S { :o_custkey @:Known }", "Orders", ("orders", "customer"), _status(ORDER, "orders LEFT JOIN customer ON o_custkey = c_custkey", "coalesce(c_acctbal < 3000, false)"), lambda ref: f"PREFIX : <{EX}> :Known {{ :c_acctbal LITERAL MAXEXCLUSIVE 3000 }}"),
    ("shex_digits", ":S { :o_custkey @:C } :C { :c_custkey xsd:integer TOTALDIGITS 3 }", "Orders", ("orders", "customer"), _status(ORDER, "orders LEFT JOIN customer ON o_custkey = c_custkey", "coalesce(c_custkey < 1000, false)"), None),
):
    QUERIES[_name], ORACLES[_name] = _shex_focus(_text, _focus, _tables, resolve=_resolve), _sql


@register("shex_materialize", f"SELECT {CUSTOMER} AS s, '{EX}label' AS p, c_name AS value FROM customer WHERE c_acctbal >= 9000")
def _(spark, d):
    """What Map actions take from one shape is put in place by another."""
    g = from_tables(spark, d, ("customer",))
    key = "%<http://shex.io/extensions/Map/#>{ name %}"
    source = shex_text.parse_shexc(f"PREFIX : <{EX}> :S {{ :c_name . {key} ; :c_acctbal LITERAL MININCLUSIVE 9000 }}")
    target = shex_text.parse_shexc(f"PREFIX : <{EX}> :T {{ :label . {key} }}")
    state = shex.map_actions(g, source, shex.shape_map(g, [(("focus", TYPE, iri(EX + "Customer")), EX + "S")]), EX + "S")
    return shex.materialize(target, EX + "T", state).select("s", "p", F.col("o.lex").alias("value"))


@register("shex_test_actions", f"SELECT {CUSTOMER} AS focus, c_mktsegment AS output FROM customer WHERE c_acctbal >= 9000")
def _(spark, d):
    from .plans import shex_actions

    g = from_tables(spark, d, ("customer",))
    schema = shex_text.parse_shexc(f"PREFIX : <{EX}> :S {{ :c_mktsegment . %<{shex_actions.TEST}>{{ print(o) %}} ; :c_acctbal LITERAL MININCLUSIVE 9000 }}")
    return shex_actions.run(g, schema, shex.shape_map(g, [(("focus", TYPE, iri(EX + "Customer")), EX + "S")]), EX + "S").select("focus", "output")


@register("shex_explain", f"SELECT {CUSTOMER} AS node, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS fitting FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    g = from_tables(spark, d, ("customer", "orders"))
    schema = shex_text.parse_shexc(f"PREFIX : <{EX}> :S {{ ^:o_custkey @:F * }} :F {{ :o_orderstatus [ 'F' ] }}")
    got = shex.Validator(g, schema).explain(EX + "S", shex.shape_map(g, [(("focus", TYPE, iri(EX + "Customer")), EX + "S")]))
    return got.select("node", F.col("values").alias("n"), "fitting")


@register("shex_to_sparql_run", f"SELECT {ORDER} AS o, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    """The SELECT that a schema is turned into, run."""
    schema = shex_text.parse_shexc(f"PREFIX : <{EX}> start = @:O :O {{ :o_orderstatus [ 'F' 'O' ] ; :o_custkey @:C }} :C {{ :c_mktsegment [ 'BUILDING' 'MACHINERY' ] }}")
    got = sparql.plain(sparql.query(from_tables(spark, d, ("orders", "customer")), convert.shex_to_sparql(schema)))
    return got.select(F.col("this").alias("o"), F.col("v3").alias("seg"))


# more of property graphs, profiles, services, generation and reports


@register("pg_cardinality", "SELECT 'n' || o_custkey AS id, count(*) BETWEEN 8 AND 12 AS conforms FROM orders GROUP BY o_custkey")
def _(spark, d):
    """Each customer's orders as a list of values, of which there must be eight to twelve."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    held = orders.groupBy("o_custkey").agg(F.flatten(F.collect_list(pg.value_column("i", F.col("o_orderkey")))).alias("v"))
    nodes = held.select(F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("id"), F.array(F.lit("C")).cast("array<string>").alias("labels"), F.create_map(F.lit("orders"), F.col("v")).alias("props"))
    return pg.PropertyGraph(nodes, spark.createDataFrame([], pg.EDGES)).conforming_nodes(pg.parse_schema("CREATE NODE TYPE ( T : C { orders: INTEGER {8,12} })"), "T")


@register("pg_merge", "SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    """A graph merged with another that says more of some of its nodes: theirs win."""
    customer = spark.read.parquet(f"{d}/customer.parquet")
    made = lambda df, c: pg.PropertyGraph(df.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.lit("C")).cast("array<string>").alias("labels"), F.create_map(F.lit("segment"), pg.value_column("s", c)).alias("props")), spark.createDataFrame([], pg.EDGES))
    both = made(customer, F.col("c_mktsegment")).merge(made(customer.where("c_acctbal < 0"), F.lit("debtor")))
    return both.nodes.select("id", F.col("props")["segment"][0]["s"].alias("segment"))


@register("dctap_rows", "SELECT * FROM (VALUES (':Customer', ':c_mktsegment'), (':Customer', ':c_acctbal'), (':Customer', ':c_name')) v(shape, property)")
def _(spark, d):
    """A profile written as CSV: blank shape ids continue the shape before."""
    path = scratch(spark, "tap")
    spark.createDataFrame([(_TAP.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    return dctap.read_table(spark, path).select(F.col("shapeID").alias("shape"), F.col("propertyID").alias("property"))


@register("service_partitions", "SELECT * FROM (VALUES ('Customer', 'c_name'), ('Customer', 'c_acctbal'), ('Orders', 'o_custkey')) v(class, property)")
def _(spark, d):
    """A service description's class and property partitions."""
    text = f"""@prefix sd: <http://www.w3.org/ns/sparql-service-description#> . @prefix void: <http://rdfs.org/ns/void#> . @prefix : <{EX}> .
    :s a sd:Service ; sd:endpoint :sparql ; sd:defaultDataset [ sd:defaultGraph [ void:classPartition
      [ void:class :Customer ; void:propertyPartition [ void:property :c_name ], [ void:property :c_acctbal ] ],
      [ void:class :Orders ; void:propertyPartition [ void:property :o_custkey ] ] ] ] ."""
    found = service.parse_service(turtle.parse(text)[0])
    rows = [(c.name.removeprefix(EX), q.name.removeprefix(EX)) for ds in found.datasets for c in ds.class_partitions for q in c.properties]
    return spark.createDataFrame(rows, "class string, property string")


@register("generate_seeded", "SELECT 0::BIGINT AS differ, true AS other_seed_differs")
def _(spark, d):
    """Runs with one seed agree, those with another don't; whole graphs of 20,000 entities."""
    shape = [generate.Shape(EX + "P", (generate.Property(EX + "n", XSD + "integer"), generate.Property(EX + "d", XSD + "date")))]
    a, b, c = (generate.generate(spark, shape, 20_000, seed=x).select("s", "p", F.col("o.lex").alias("v")) for x in (1, 1, 2))
    differ = a.exceptAll(b).agg(F.count(F.lit(1)).alias("differ"))
    return differ.join(F.broadcast(a.exceptAll(c).agg((F.count(F.lit(1)) > 1000).alias("other_seed_differs"))))


@register("shacl_report_sorted", f"SELECT {CUSTOMER} AS focus, row_number() OVER (ORDER BY {CUSTOMER}) AS place FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    """The place of each result in the report by node, from its sort keys."""
    from pyspark.sql.window import Window

    report = shacl.sort_report(shacl.validate(from_tables(spark, d, ("customer",)), shacl.Schema.of(S("urn:s", p("c_acctbal"), (("class", EX + "Customer"),), (C("minInclusive", (literal(0.0),)),)))), "Node")
    # a report by one key: its order is that of the window
    return report.select("focus", F.row_number().over(Window.orderBy("focus")).alias("place"))


@register("shacl_sparql_pairs", f"SELECT {LINE} AS focus FROM {lines('l_tax')} JOIN {lines('l_discount')} d USING (l_orderkey, l_linenumber) WHERE NOT l_tax < l_discount")
def _(spark, d):
    """A pair of properties compared by a SPARQL constraint."""
    text = "SELECT $this ?value WHERE { $this $PATH ?value . $this <%sl_discount> ?other FILTER (!(?value < ?other)) }" % EX
    shape = S("urn:s", p("l_tax"), (("class", EX + "Lineitem"),), (C("sparql", (text,)),))
    return shacl.validate(from_tables(spark, d, ("lineitem",)), shacl.Schema.of(shape)).select("focus")
