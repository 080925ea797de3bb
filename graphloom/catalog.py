"""The registered queries of the graph engine, each with the SQL that gives the same rows from the base tables.

Every query runs over whole tables. The graph is the lifted one: patterns read only the columns that
they need, and no triples are made but where a query asks for all predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.terms import LANG_STRING, TYPE, XSD, Term, iri, literal, term
from .operators import generate, stats
from .operators.graph import FrameGraph, LiftedGraph
from .operators.paths import Alt, Inv, NotIn, Opt, Plus, Pred, Seq, Star, pairs
from .plans import pgschema as pg
from .plans import shacl, shex, sparql
from .sources.lift import EX, from_tables, key_iri

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

C, S = shacl.Constraint, shacl.Shape
INT, DOUBLE, STRING = XSD + "integer", XSD + "double", XSD + "string"


def p(name: str) -> Pred:
    return Pred(EX + name)


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def key(table: str, *cols: str) -> str:
    """The SQL of an entity's IRI."""
    return f"'{EX}{table}/' || " + " || '-' || ".join(f"{c}::VARCHAR" for c in cols)


CUSTOMER, ORDER, NATION, REGION, SUPPLIER, PART = (key(*x) for x in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")))
LINE = key("lineitem", "l_orderkey", "l_linenumber")


def lines(*cols: str) -> str:
    """The SQL of line items as a set: their key may name several rows."""
    return f"(SELECT DISTINCT l_orderkey, l_linenumber, {', '.join(cols)} FROM lineitem)"


ORDER_CUSTOMER, CUSTOMER_NATION, NATION_REGION = key("customer", "o_custkey"), key("nation", "c_nationkey"), key("region", "n_regionkey")

# scans and navigation


@register("scan_pattern_p", f"SELECT {ORDER} AS s, o_orderstatus AS value FROM orders")
def _(spark, d):
    return from_tables(spark, d, ("orders",)).pattern(p=EX + "o_orderstatus").select("s", F.col("o.lex").alias("value"))


@register("scan_pattern_po", f"SELECT {ORDER} AS s FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return from_tables(spark, d, ("orders",)).pattern(p=EX + "o_orderstatus", o=literal("F")).select("s")


@register("scan_all_triples", "SELECT p, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{EX}{c}' AS p FROM {t} WHERE {c} IS NOT NULL" for t, cs in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("region", ("r_regionkey", "r_name"))) for c in cs) + f" UNION ALL SELECT '{TYPE}' FROM nation UNION ALL SELECT '{TYPE}' FROM region) GROUP BY p")
def _(spark, d):
    return from_tables(spark, d, ("nation", "region")).triples().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@register("arcs_outgoing", f"SELECT {CUSTOMER} AS node, p, 1 AS n FROM customer, (VALUES " + ", ".join(f"('{x}')" for x in (*(EX + c for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), TYPE)) + ") v(p)")
def _(spark, d):
    return from_tables(spark, d, ("customer",)).outgoing_arcs().select("node", "p", F.size("values").alias("n"))


@register("arcs_incoming", f"SELECT {CUSTOMER_NATION} AS node, '{EX}c_nationkey' AS p, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT '{EX}Customer', '{TYPE}', count(*) FROM customer")
def _(spark, d):
    return from_tables(spark, d, ("customer",)).incoming().groupBy("node", "p").agg(F.count(F.lit(1)).alias("n"))


@register("arcs_from_list", " UNION ALL ".join(f"SELECT {CUSTOMER} AS s, '{pr}' AS p, {str(pr in (EX + 'c_name', EX + 'c_nationkey')).lower()} AS listed FROM customer" for pr in (*(EX + c for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), TYPE)))
def _(spark, d):
    a, b = from_tables(spark, d, ("customer",)).outgoing_from_list([EX + "c_name", EX + "c_nationkey"])
    return a.select("s", "p", F.lit(True).alias("listed")).unionByName(b.select("s", "p", F.lit(False).alias("listed")))


@register("instances_of", f"SELECT {SUPPLIER} AS node FROM supplier")
def _(spark, d):
    return from_tables(spark, d).instances_of(EX + "Supplier")


@register("object_for", f"SELECT {ORDER} AS node, {ORDER_CUSTOMER} AS value FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    g = from_tables(spark, d, ("orders", "customer"))
    some = g.pattern(p=EX + "o_orderstatus", o=literal("O")).select(F.col("s").alias("node"))
    return g.object_for(some, EX + "o_custkey").select("node", F.col("value.lex").alias("value"))


@register("node_info_depth2", f"SELECT {ORDER} AS root, 1 AS depth, '{EX}o_custkey' AS p, {ORDER_CUSTOMER} AS value FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT {ORDER}, 2, '{EX}c_nationkey', {CUSTOMER_NATION} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def _(spark, d):
    g = from_tables(spark, d, ("orders", "customer"))
    some = g.pattern(p=EX + "o_orderpriority", o=literal("1-URGENT")).select(F.col("s").alias("node"))
    return g.neighbourhood(some, 2, predicates=[EX + "o_custkey", EX + "c_nationkey"]).select("root", "depth", "p", F.col("value.lex").alias("value"))


# paths


def _path(spark, d, path, tables, seeds=None):
    g = from_tables(spark, d, tables)
    return pairs(g, path, seeds(g) if seeds else None).select("start", F.col("end.lex").alias("end_node"))


@register("path_sequence", f"SELECT DISTINCT {LINE} AS start, n_name AS end_node FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return _path(spark, d, Seq((p("l_orderkey"), p("o_custkey"), p("c_nationkey"), p("n_name"))), ("lineitem", "orders", "customer", "nation"))


@register("path_inverse", f"SELECT {ORDER_CUSTOMER} AS start, {ORDER} AS end_node FROM orders")
def _(spark, d):
    return _path(spark, d, Inv(p("o_custkey")), ("orders",))


@register("path_alternative", f"SELECT {CUSTOMER} AS start, {CUSTOMER_NATION} AS end_node FROM customer UNION SELECT {CUSTOMER}, c_mktsegment FROM customer")
def _(spark, d):
    return _path(spark, d, Alt((p("c_nationkey"), p("c_mktsegment"))), ("customer",))


@register("path_zero_or_one", f"SELECT {NATION} AS start, {NATION} AS end_node FROM nation UNION SELECT {NATION}, {NATION_REGION} FROM nation")
def _(spark, d):
    return _path(spark, d, Opt(p("n_regionkey")), ("nation",), lambda g: g.pattern(p=EX + "n_regionkey").select(F.col("s").alias("start")))


@register("path_one_or_more", f"WITH RECURSIVE e AS (SELECT {CUSTOMER} AS a, {CUSTOMER_NATION} AS b FROM customer UNION SELECT {NATION}, {NATION_REGION} FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS start, b AS end_node FROM r")
def _(spark, d):
    return _path(spark, d, Plus(Alt((p("c_nationkey"), p("n_regionkey")))), ("customer", "nation"))


@register("path_zero_or_more", f"WITH RECURSIVE e AS (SELECT {CUSTOMER} AS a, {CUSTOMER_NATION} AS b FROM customer UNION SELECT {NATION}, {NATION_REGION} FROM nation), r AS (SELECT {CUSTOMER} AS a, {CUSTOMER} AS b FROM customer UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS start, b AS end_node FROM r")
def _(spark, d):
    return _path(spark, d, Star(Alt((p("c_nationkey"), p("n_regionkey")))), ("customer", "nation"), lambda g: g.pattern(p=EX + "c_custkey").select(F.col("s").alias("start")))


@register("path_negated", f"SELECT {REGION} AS start, r_name AS end_node FROM region")
def _(spark, d):
    return _path(spark, d, NotIn((EX + "r_regionkey", TYPE)), ("region",))


# SHACL


def _shacl(spark, d, tables, *shapes, mode="native", columns=("focus", "component")):
    return shacl.validate(from_tables(spark, d, tables), shacl.Schema.of(*shapes), mode).select(*columns)


def _property(target: str, path, *constraints, mode="native", tables=None, columns=("focus", "component"), extra=()):
    """A query: instances of a class, and what is wrong with the values of a path."""

    def run(spark, d):
        node = S("urn:node", targets=(("class", EX + target.capitalize()),), constraints=(C("property", ("urn:property",)),))
        return _shacl(spark, d, tables or (target,), node, S("urn:property", path, constraints=constraints), *extra, mode=mode, columns=columns)

    return run


QUERIES["shacl_min_count"] = _property("customer", Inv(p("o_custkey")), C("minCount", (6,)), tables=("customer", "orders"))
ORACLES["shacl_min_count"] = f"SELECT {CUSTOMER} AS focus, 'minCount' AS component FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 6"
QUERIES["shacl_max_count"] = _property("customer", Inv(p("o_custkey")), C("maxCount", (12,)), tables=("customer", "orders"))
ORACLES["shacl_max_count"] = f"SELECT {ORDER_CUSTOMER} AS focus, 'maxCount' AS component FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) > 12"
QUERIES["shacl_node_kind"] = _property("supplier", Alt((p("s_nationkey"), p("s_name"))), C("nodeKind", ("IRI",)), columns=("focus", "component", "value"))
ORACLES["shacl_node_kind"] = f"SELECT {SUPPLIER} AS focus, 'nodeKind' AS component, s_name AS value FROM supplier"
for _name, _test in (("minInclusive", "l_quantity < 10"), ("minExclusive", "l_quantity <= 10"), ("maxInclusive", "l_quantity > 10"), ("maxExclusive", "l_quantity >= 10")):
    _snake = "".join("_" + c.lower() if c.isupper() else c for c in _name)
    QUERIES[f"shacl_{_snake}"] = _property("lineitem", p("l_quantity"), C(_name, (literal(10.0),)))
    ORACLES[f"shacl_{_snake}"] = f"SELECT {LINE} AS focus, '{_name}' AS component FROM {lines('l_quantity')} WHERE {_test}"
QUERIES["shacl_lengths"] = _property("part", p("p_name"), C("minLength", (10,)), C("maxLength", (12,)))
ORACLES["shacl_lengths"] = f"SELECT {PART} AS focus, 'minLength' AS component FROM part WHERE strlen(p_name) < 10 UNION ALL SELECT {PART}, 'maxLength' FROM part WHERE strlen(p_name) > 12"
QUERIES["shacl_pattern"] = _property("customer", p("c_name"), C("pattern", ("#0*[0-9]*7$", "")))
ORACLES["shacl_pattern"] = f"SELECT {CUSTOMER} AS focus, 'pattern' AS component FROM customer WHERE NOT regexp_matches(c_name, '#0*[0-9]*7$')"
QUERIES["shacl_in"] = _property("customer", p("c_mktsegment"), C("in", ((literal("BUILDING"), literal("MACHINERY")),)), columns=("focus", "component", "value"))
ORACLES["shacl_in"] = f"SELECT {CUSTOMER} AS focus, 'in' AS component, c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"
QUERIES["shacl_has_value"] = _property("orders", p("o_orderstatus"), C("hasValue", (literal("F"),)))
ORACLES["shacl_has_value"] = f"SELECT {ORDER} AS focus, 'hasValue' AS component FROM orders WHERE o_orderstatus <> 'F'"
QUERIES["shacl_class"] = _property("lineitem", Alt((p("l_partkey"), p("l_suppkey"))), C("class", (EX + "Part",)), tables=("lineitem", "part"), columns=("focus", "component", "value"))
ORACLES["shacl_class"] = f"SELECT DISTINCT {LINE} AS focus, 'class' AS component, {key('supplier', 'l_suppkey')} AS value FROM lineitem UNION ALL SELECT DISTINCT {LINE}, 'class', {key('part', 'l_partkey')} FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"
QUERIES["shacl_equals"] = _property("lineitem", p("l_returnflag"), C("equals", (EX + "l_linestatus",)), columns=("focus", "component", "value"))
ORACLES["shacl_equals"] = f"SELECT focus, 'equals' AS component, value FROM ((SELECT {LINE} AS focus, l_returnflag AS value FROM lineitem EXCEPT SELECT {LINE}, l_linestatus FROM lineitem) UNION ALL (SELECT {LINE}, l_linestatus FROM lineitem EXCEPT SELECT {LINE}, l_returnflag FROM lineitem))"
QUERIES["shacl_disjoint"] = _property("lineitem", p("l_tax"), C("disjoint", (EX + "l_discount",)))
ORACLES["shacl_disjoint"] = f"SELECT {LINE} AS focus, 'disjoint' AS component FROM {lines('l_tax')} JOIN {lines('l_discount')} d USING (l_orderkey, l_linenumber) WHERE l_tax = l_discount"
QUERIES["shacl_less_than"] = _property("lineitem", p("l_tax"), C("lessThan", (EX + "l_discount",)))
ORACLES["shacl_less_than"] = f"SELECT {LINE} AS focus, 'lessThan' AS component FROM {lines('l_tax')} JOIN {lines('l_discount')} d USING (l_orderkey, l_linenumber) WHERE NOT l_tax < l_discount"
QUERIES["shacl_less_than_or_equals"] = _property("lineitem", p("l_tax"), C("lessThanOrEquals", (EX + "l_discount",)))
ORACLES["shacl_less_than_or_equals"] = f"SELECT {LINE} AS focus, 'lessThanOrEquals' AS component FROM {lines('l_tax')} JOIN {lines('l_discount')} d USING (l_orderkey, l_linenumber) WHERE NOT l_tax <= l_discount"

_RICH = S("urn:rich", p("c_acctbal"), constraints=(C("minInclusive", (literal(5000.0),)),))
_BUILDS = S("urn:builds", p("c_mktsegment"), constraints=(C("hasValue", (literal("BUILDING"),)),))


def _logical(name: str, *args):
    def run(spark, d):
        node = S("urn:node", targets=(("class", EX + "Customer"),), constraints=(C(name, args),))
        return _shacl(spark, d, ("customer",), node, _RICH, _BUILDS)

    return run


for _name, _args, _test in (
    ("and", (("urn:rich", "urn:builds"),), "NOT (c_acctbal >= 5000 AND c_mktsegment = 'BUILDING')"),
    ("or", (("urn:rich", "urn:builds"),), "NOT (c_acctbal >= 5000 OR c_mktsegment = 'BUILDING')"),
    ("xone", (("urn:rich", "urn:builds"),), "(c_acctbal >= 5000) = (c_mktsegment = 'BUILDING')"),
    ("not", ("urn:rich",), "c_acctbal >= 5000"),
    ("node", ("urn:rich",), "c_acctbal < 5000"),
):
    QUERIES[f"shacl_{_name}"] = _logical(_name, *_args)
    ORACLES[f"shacl_{_name}"] = f"SELECT {CUSTOMER} AS focus, '{_name}' AS component FROM customer WHERE {_test}"


@register("shacl_nested_property", f"SELECT {ORDER_CUSTOMER} AS focus, 'minInclusive' AS component FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def _(spark, d):
    node = S("urn:node", targets=(("class", EX + "Orders"),), constraints=(C("property", ("urn:to",)),))
    to = S("urn:to", p("o_custkey"), constraints=(C("property", ("urn:balance",)),))
    return _shacl(spark, d, ("orders", "customer"), node, to, S("urn:balance", p("c_acctbal"), constraints=(C("minInclusive", (literal(0.0),)),)))


@register("shacl_qualified", f"SELECT {CUSTOMER} AS focus, 'qualifiedMinCount' AS component FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey HAVING count(o_orderkey) < 2 UNION ALL SELECT {CUSTOMER}, 'qualifiedMaxCount' FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey HAVING count(o_orderkey) > 6")
def _(spark, d):
    node = S("urn:node", targets=(("class", EX + "Customer"),), constraints=(C("property", ("urn:orders",)),))
    orders = S("urn:orders", Inv(p("o_custkey")), constraints=(C("qualified", ("urn:done", 2, 6, ())),))
    return _shacl(spark, d, ("customer", "orders"), node, orders, S("urn:done", p("o_orderstatus"), constraints=(C("hasValue", (literal("F"),)),)))


@register("shacl_qualified_disjoint", f"SELECT {CUSTOMER} AS focus, 'qualifiedMinCount' AS component FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND NOT o_totalprice >= 100000 GROUP BY c_custkey HAVING count(o_orderkey) < 1")
def _(spark, d):
    node = S("urn:node", targets=(("class", EX + "Customer"),), constraints=(C("property", ("urn:orders",)),))
    orders = S("urn:orders", Inv(p("o_custkey")), constraints=(C("qualified", ("urn:done", 1, None, ("urn:large",))),))
    done = S("urn:done", p("o_orderstatus"), constraints=(C("hasValue", (literal("F"),)),))
    return _shacl(spark, d, ("customer", "orders"), node, orders, done, S("urn:large", p("o_totalprice"), constraints=(C("minInclusive", (literal(100000.0),)),)))


@register("shacl_closed", f"SELECT {SUPPLIER} AS focus, 'closed' AS component, '<{EX}s_nationkey>' AS path FROM supplier")
def _(spark, d):
    node = S("urn:node", targets=(("class", EX + "Supplier"),), constraints=(C("property", ("urn:name",)), C("closed", ((TYPE, EX + "s_suppkey", EX + "s_acctbal"),))))
    return _shacl(spark, d, ("supplier",), node, S("urn:name", p("s_name")), columns=("focus", "component", "path"))


def _tagged(spark, d) -> LiftedGraph:
    """Sources with their documents' ids as literals in the documents' languages."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    value = term("literal", F.col("doc_id").cast("string"), LANG_STRING, F.col("lang"), F.lit(None), F.lit(None))
    return LiftedGraph(spark, {EX + "document": [(docs, key_iri("source", "source"), value)]}, {}, [docs])


SOURCE = key("source", "source")


@register("shacl_unique_lang", f"SELECT {SOURCE} AS focus, 'uniqueLang' AS component FROM documents GROUP BY source, lang HAVING count(*) > 1")
def _(spark, d):
    shape = S("urn:s", p("document"), targets=(("subjectsOf", EX + "document"),), constraints=(C("uniqueLang", (True,)),))
    return shacl.validate(_tagged(spark, d), shacl.Schema.of(shape)).select("focus", "component")


@register("shacl_language_in", f"SELECT {SOURCE} AS focus, 'languageIn' AS component, doc_id::VARCHAR AS value FROM documents WHERE lang NOT IN ('en', 'de')")
def _(spark, d):
    shape = S("urn:s", p("document"), targets=(("subjectsOf", EX + "document"),), constraints=(C("languageIn", (("en", "DE"),)),))
    return shacl.validate(_tagged(spark, d), shacl.Schema.of(shape)).select("focus", "component", "value")


@register("shacl_targets", f"SELECT {key('nation', 'n_nationkey')} AS focus, 'objectsOf' AS shape FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT {SUPPLIER}, 'subjectsOf' FROM supplier UNION ALL SELECT '{EX}region/1', 'node' UNION ALL SELECT {REGION}, 'class' FROM region")
def _(spark, d):
    never = (C("nodeKind", ("Literal",)),)
    shapes = (S(n, targets=(t,), constraints=never) for n, t in (("objectsOf", ("objectsOf", EX + "c_nationkey")), ("subjectsOf", ("subjectsOf", EX + "s_acctbal")), ("node", ("node", iri(EX + "region/1"))), ("class", ("class", EX + "Region"))))
    found = _shacl(spark, d, ("nation", "customer", "supplier", "region"), *shapes, columns=("focus", "source_shape"))
    return found.withColumnRenamed("source_shape", "shape")


@register("shacl_sparql", f"SELECT {ORDER} AS focus, 'sparql' AS component FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 40 * c_acctbal AND c_acctbal > 0")
def _(spark, d):
    text = "SELECT $this WHERE { $this <%so_custkey> ?c . ?c <%sc_acctbal> ?b . $this <%so_totalprice> ?t FILTER (?t > 40 * ?b && ?b > 0) }" % (EX, EX, EX)
    return _shacl(spark, d, ("orders", "customer"), S("urn:s", targets=(("class", EX + "Orders"),), constraints=(C("sparql", (text,)),)))


@register("shacl_report_by_severity", "SELECT 'Violation' AS severity, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'Info', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark, d):
    node = S("urn:node", targets=(("class", EX + "Customer"),), constraints=(C("property", ("urn:a",)), C("property", ("urn:b",))))
    a = S("urn:a", p("c_acctbal"), constraints=(C("minInclusive", (literal(0.0),)),))
    b = S("urn:b", p("c_mktsegment"), constraints=(C("in", ((literal("BUILDING"),),)),), severity="Info")
    return shacl.by_severity(shacl.validate(from_tables(spark, d, ("customer",)), shacl.Schema.of(node, a, b)))


# SPARQL

PREFIX = f"PREFIX : <{EX}> PREFIX xsd: <{XSD}> "


def _sparql(text: str, tables, **types):
    """types: variable -> type of its column; text otherwise."""

    def run(spark, d):
        df = sparql.query(from_tables(spark, d, tables), PREFIX + text)
        if dict(df.dtypes).get("result") == "boolean":
            return df
        out = []
        for c in df.columns:
            kind = types.get(c, "text")
            out.append((F.col(f"{c}.lex") if kind == "text" else F.col(f"{c}.num") if kind == "double" else F.col(f"{c}.num").cast("bigint") if kind == "bigint" else F.col(f"{c}.ts")).alias(c))
        return df.select(*out)

    return run


def sparql_query(name: str, text: str, tables, sql: str, **types):
    QUERIES[name] = _sparql(text, tables, **types)
    ORACLES[name] = sql


sparql_query("sparql_bgp", "SELECT ?c ?name ?n WHERE { ?c a :Customer ; :c_name ?name ; :c_nationkey ?x . ?x :n_name ?n }", ("customer", "nation"), f"SELECT {CUSTOMER} AS c, c_name AS name, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
sparql_query("sparql_filter", "SELECT ?l WHERE { ?l :l_quantity ?q ; :l_discount ?d FILTER (?q * 2 > 60 && (?d = 0.05 || ?d >= 0.09)) }", ("lineitem",), f"SELECT {LINE} AS l FROM {lines('l_quantity')} JOIN {lines('l_discount')} d USING (l_orderkey, l_linenumber) WHERE l_quantity * 2 > 60 AND (l_discount = 0.05 OR l_discount >= 0.09)")
sparql_query("sparql_optional", "SELECT ?c ?o WHERE { ?c a :Customer OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER (?t > 300000) } }", ("customer", "orders"), f"SELECT {CUSTOMER} AS c, {ORDER} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
sparql_query("sparql_union", "SELECT ?x ?n WHERE { { ?x :c_name ?n } UNION { ?x :s_name ?n } }", ("customer", "supplier"), f"SELECT {CUSTOMER} AS x, c_name AS n FROM customer UNION ALL SELECT {SUPPLIER}, s_name FROM supplier")
sparql_query("sparql_minus", "SELECT ?c WHERE { ?c a :Customer MINUS { ?o :o_custkey ?c ; :o_orderstatus 'P' } }", ("customer", "orders"), f"SELECT {CUSTOMER} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sparql_query("sparql_exists", "SELECT ?c WHERE { ?c a :Customer FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER (?t > 250000) } }", ("customer", "orders"), f"SELECT {CUSTOMER} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sparql_query("sparql_not_exists", "SELECT ?c WHERE { ?c a :Customer FILTER NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER (?t > 400000) } }", ("customer", "orders"), f"SELECT {CUSTOMER} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sparql_query("sparql_group", "SELECT ?n (COUNT(?o) AS ?k) (MAX(?t) AS ?top) (COUNT(DISTINCT ?s) AS ?states) WHERE { ?o :o_custkey ?c ; :o_totalprice ?t ; :o_orderstatus ?s . ?c :c_nationkey/:n_name ?n } GROUP BY ?n", ("orders", "customer", "nation"), "SELECT n_name AS n, count(*) AS k, max(o_totalprice) AS top, count(DISTINCT o_orderstatus) AS states FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", k="bigint", top="double", states="bigint")
sparql_query("sparql_having", "SELECT ?p (COUNT(*) AS ?k) WHERE { ?l :l_partkey ?p } GROUP BY ?p HAVING (COUNT(*) > 40)", ("lineitem",), f"SELECT {key('part', 'l_partkey')} AS p, count(*) AS k FROM {lines('l_partkey')} GROUP BY l_partkey HAVING count(*) > 40", k="bigint")
sparql_query("sparql_sum", "SELECT ?f (SUM(?n) AS ?lines) WHERE { ?l :l_returnflag ?f ; :l_linenumber ?n } GROUP BY ?f", ("lineitem",), f"SELECT l_returnflag AS f, sum(l_linenumber)::BIGINT AS lines FROM {lines('l_returnflag')} GROUP BY l_returnflag", lines="bigint")
sparql_query("sparql_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x :n_regionkey ?r ; :n_name ?n } GROUP BY ?r", ("nation",), f"SELECT {NATION_REGION} AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sparql_query("sparql_topk", "SELECT ?o ?t WHERE { ?o :o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 50 OFFSET 10", ("orders",), f"SELECT {ORDER} AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, {ORDER} LIMIT 50 OFFSET 10", t="double")
sparql_query("sparql_distinct", "SELECT DISTINCT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", ("orders",), "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
sparql_query("sparql_values_bind", "SELECT ?c ?seg ?short ?n WHERE { VALUES ?seg { 'BUILDING' 'MACHINERY' } ?c :c_mktsegment ?seg ; :c_name ?name BIND (SUBSTR(?seg, 1, 3) AS ?short) BIND (STRLEN(?name) AS ?n) }", ("customer",), f"SELECT {CUSTOMER} AS c, c_mktsegment AS seg, substr(c_mktsegment, 1, 3) AS short, length(c_name) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", n="bigint")
sparql_query("sparql_subselect", "SELECT ?c ?k WHERE { ?c :c_mktsegment 'BUILDING' { SELECT ?c (COUNT(*) AS ?k) WHERE { ?o :o_custkey ?c } GROUP BY ?c } }", ("customer", "orders"), f"SELECT {CUSTOMER} AS c, k FROM customer JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", k="bigint")
sparql_query("sparql_path", "SELECT ?c ?r WHERE { ?c a :Customer ; (:c_nationkey|:n_regionkey)+ ?r . ?r a :Region }", ("customer", "nation", "region"), f"SELECT {CUSTOMER} AS c, {NATION_REGION} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql_query("sparql_functions", "SELECT ?c (UCASE(?seg) AS ?u) (STRAFTER(?name, '#') AS ?num) (MD5(?seg) AS ?h) (IF(?b < 0, 'debt', 'fine') AS ?state) WHERE { ?c :c_mktsegment ?seg ; :c_name ?name ; :c_acctbal ?b FILTER (REGEX(?name, '1$') && STRSTARTS(?seg, 'B')) }", ("customer",), f"SELECT {CUSTOMER} AS c, upper(c_mktsegment) AS u, CASE WHEN position('#' IN c_name) > 0 THEN substr(c_name, position('#' IN c_name) + 1) ELSE '' END AS num, md5(c_mktsegment) AS h, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state FROM customer WHERE regexp_matches(c_name, '1$') AND starts_with(c_mktsegment, 'B')")
sparql_query("sparql_dates", "SELECT ?y ?m (COUNT(*) AS ?k) WHERE { ?o :o_orderdate ?d BIND (YEAR(?d) AS ?y) BIND (MONTH(?d) AS ?m) } GROUP BY ?y ?m", ("orders",), "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS k FROM orders GROUP BY 1, 2", y="bigint", m="bigint", k="bigint")
sparql_query("sparql_cartesian", "SELECT ?a ?b WHERE { ?a a :Region . ?b a :Nation }", ("region", "nation"), f"SELECT {REGION} AS a, {NATION} AS b FROM region, nation")
sparql_query("sparql_ask", "ASK { ?o :o_totalprice ?t FILTER (?t > 1000) }", ("orders",), "SELECT count(*) > 0 AS result FROM orders WHERE o_totalprice > 1000")


@register("sparql_construct", f"SELECT DISTINCT {NATION_REGION} AS s, '{EX}hasCustomer' AS p, {CUSTOMER} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    made = sparql.query(from_tables(spark, d, ("customer", "nation")), PREFIX + "CONSTRUCT { ?r :hasCustomer ?c } WHERE { ?c :c_nationkey/:n_regionkey ?r }")
    return made.select("s", "p", F.col("o.lex").alias("o"))


# ShEx

TC, NC = shex.TripleConstraint, shex.NodeConstraint


def _shex(tables, focus, shapes: dict, label: str = "S"):
    def run(spark, d):
        g = from_tables(spark, d, tables)
        got = shex.Validator(g, shex.Schema(shapes)).validate(shex.shape_map(g, [(("focus", TYPE, iri(EX + focus)), label)]))
        return got.select("node", "shape", "status")

    return run


def shex_query(name: str, tables, focus: str, shapes: dict, node: str, source: str, good: str):
    QUERIES[name] = _shex(tables, focus, shapes)
    ORACLES[name] = f"SELECT {node} AS node, 'S' AS shape, CASE WHEN {good} THEN 'conformant' ELSE 'nonconformant' END AS status FROM {source}"


_COUNTED = "(SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"
shex_query("shex_cardinality", ("customer", "orders"), "Customer", {"S": shex.ShapeDef(TC(EX + "o_custkey", None, 5, 15, True))}, CUSTOMER, _COUNTED, "n BETWEEN 5 AND 15")
shex_query("shex_empty_bag", ("customer", "orders"), "Customer", {"S": shex.ShapeDef(shex.OneOf((TC(EX + "o_custkey", None, 0, 0, True), TC(EX + "l_partkey", None, 1, None))))}, CUSTOMER, _COUNTED, "n = 0")
shex_query("shex_value_set", ("orders",), "Orders", {"S": shex.ShapeDef(TC(EX + "o_orderpriority", NC(values=(literal("1-URGENT"), shex.Stem("literal", "2-")))))}, ORDER, "orders", "o_orderpriority = '1-URGENT' OR starts_with(o_orderpriority, '2-')")
shex_query("shex_facets", ("customer",), "Customer", {"S": shex.ShapeDef(shex.EachOf((TC(EX + "c_acctbal", NC(datatype=DOUBLE, facets=(("mininclusive", 0.0), ("maxexclusive", 8000.0)))), TC(EX + "c_name", NC(kind="literal", facets=(("pattern", ("[02468]$", "")), ("minlength", 5)))))))}, CUSTOMER, "customer", "c_acctbal >= 0 AND c_acctbal < 8000 AND regexp_matches(c_name, '[02468]$')")
shex_query("shex_closed_extra", ("supplier",), "Supplier", {"S": shex.ShapeDef(shex.EachOf((TC(EX + "s_name"), TC(EX + "s_suppkey"), TC(EX + "s_nationkey", NC(kind="iri")), TC(EX + "s_acctbal", NC(facets=(("mininclusive", 2000.0),)), 1, 1))), closed=True, extra=(TYPE, EX + "s_acctbal"))}, SUPPLIER, "supplier", "s_acctbal >= 2000")
shex_query("shex_each_one_of", ("orders",), "Orders", {"S": shex.ShapeDef(shex.EachOf((shex.OneOf((TC(EX + "o_orderstatus", NC(values=(literal("F"),))), TC(EX + "o_comment"))), TC(EX + "o_totalprice", NC(facets=(("maxinclusive", 200000.0),))))))}, ORDER, "orders", "o_orderstatus = 'F' AND o_totalprice <= 200000")
shex_query("shex_and_or_not", ("customer",), "Customer", {"S": shex.ShapeAnd((shex.Ref("A"), shex.ShapeOr((shex.Ref("B"), shex.ShapeNot(shex.Ref("D")))))), "A": shex.ShapeDef(TC(EX + "c_acctbal", NC(facets=(("mininclusive", 0.0),)))), "B": shex.ShapeDef(TC(EX + "c_mktsegment", NC(values=(literal("BUILDING"),)))), "D": shex.ShapeDef(TC(EX + "c_acctbal", NC(facets=(("mininclusive", 5000.0),))))}, CUSTOMER, "customer", "c_acctbal >= 0 AND (c_mktsegment = 'BUILDING' OR NOT c_acctbal >= 5000)")
shex_query("shex_inverse", ("nation", "customer"), "Nation", {"S": shex.ShapeDef(TC(EX + "c_nationkey", shex.Ref("C"), 1, None, True)), "C": shex.ShapeDef(TC(EX + "c_acctbal", NC(facets=(("mininclusive", -990.0),))))}, NATION, "nation", "EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -990)")
shex_query("shex_ref", ("orders", "customer"), "Orders", {"S": shex.ShapeDef(TC(EX + "o_custkey", shex.Ref("C"))), "C": shex.ShapeDef(TC(EX + "c_mktsegment", NC(values=(literal("BUILDING"), literal("AUTOMOBILE")))))}, ORDER, "orders LEFT JOIN customer ON o_custkey = c_custkey", "coalesce(c_mktsegment IN ('BUILDING', 'AUTOMOBILE'), false)")
shex_query("shex_repeated_predicate", ("customer", "orders"), "Customer", {"S": shex.ShapeDef(shex.EachOf((TC(EX + "o_custkey", shex.Ref("F"), 0, 3, True), TC(EX + "o_custkey", shex.Ref("B"), 2, None, True)))), "F": shex.ShapeDef(TC(EX + "o_orderstatus", NC(values=(literal("F"),)))), "B": shex.ShapeDef(TC(EX + "o_totalprice", NC(facets=(("mininclusive", 50000.0),))))}, CUSTOMER, "(SELECT c_custkey, count(*) FILTER (o_orderkey IS NOT NULL AND o_orderstatus = 'F' AND o_totalprice >= 50000) AS fb, count(*) FILTER (o_orderkey IS NOT NULL AND o_orderstatus = 'F' AND o_totalprice < 50000) AS f, count(*) FILTER (o_orderkey IS NOT NULL AND o_orderstatus <> 'F' AND o_totalprice >= 50000) AS b, count(*) FILTER (o_orderkey IS NOT NULL AND o_orderstatus <> 'F' AND o_totalprice < 50000) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)", "x = 0 AND f <= 3 AND b + fb >= 2")
shex_query("shex_recursive", ("orders", "customer"), "Customer", {"S": shex.ShapeDef(shex.EachOf((TC(EX + "c_acctbal", NC(facets=(("mininclusive", -500.0),))), TC(EX + "o_custkey", shex.Ref("O"), 0, None, True)))), "O": shex.ShapeDef(shex.EachOf((TC(EX + "o_totalprice", NC(facets=(("mininclusive", 1000.0),))), TC(EX + "o_custkey", shex.Ref("S")))))}, CUSTOMER, "customer", "c_acctbal >= -500 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 1000)")
shex_query("shex_extends", ("customer",), "Customer", {"S": shex.ShapeDef(TC(EX + "c_acctbal", NC(facets=(("mininclusive", 0.0),))), extends=("B",)), "B": shex.ShapeDef(TC(EX + "c_mktsegment", NC(values=(literal("BUILDING"), literal("MACHINERY")))))}, CUSTOMER, "customer", "c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")


@register("shex_map_actions", f"SELECT {CUSTOMER} AS focus, 'name' AS key, c_name AS value FROM customer WHERE c_acctbal >= 9000")
def _(spark, d):
    g = from_tables(spark, d, ("customer",))
    shape = shex.ShapeDef(shex.EachOf((TC(EX + "c_name", actions=(("http://shex.io/extensions/Map/#", " name "),)), TC(EX + "c_acctbal", NC(facets=(("mininclusive", 9000.0),))))))
    nodes = shex.shape_map(g, [(("focus", TYPE, iri(EX + "Customer")), "S")])
    return shex.map_actions(g, shex.Schema({"S": shape}), nodes, "S").select("focus", "key", F.col("value.lex").alias("value"))


# property graphs


def _property_graph(spark, d) -> pg.PropertyGraph:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    rec = lambda **kv: F.map_filter(F.create_map(*(x for k, (kind, c) in kv.items() for x in (F.lit(k), pg.value_column(kind, F.col(c))))), lambda k, v: F.lit(True))
    labels = lambda n: F.array(F.lit(n)).cast("array<string>")
    nodes = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), labels("Customer").alias("labels"), rec(name=("s", "c_name"), segment=("s", "c_mktsegment"), nation=("i", "c_nationkey")).alias("props"))
    orders = t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), labels("Order").alias("labels"), rec(status=("s", "o_orderstatus"), date=("d", "o_orderdate")).alias("props"))
    edges = t("orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"), labels("placedBy").alias("labels"), rec(priority=("s", "o_orderpriority")).alias("props"))
    return pg.PropertyGraph(nodes.unionByName(orders), edges)


_PGS = """
CREATE NODE TYPE ( CustomerType : Customer { name: STRING, segment: STRING CHECK REGEX "^(B|M)", nation: INTEGER CHECK (>= 5 AND < 20) }) ;
CREATE NODE TYPE ( OrderType : Order { status: STRING CHECK = "F" OR = "O", date: DATE CHECK < 1997-01-01 }) ;
CREATE NODE TYPE ( AnyType : Customer | Order { status: STRING, date: DATE || name: STRING, segment: STRING, nation: INTEGER CHECK > 12 }) ;
CREATE EDGE TYPE (:OrderType) -[ PlacedType : placedBy { priority: STRING CHECK REGEX "^[12]" } ]-> (:CustomerType)
"""
_GOOD_CUSTOMER = "regexp_matches(c_mktsegment, '^(B|M)') AND c_nationkey >= 5 AND c_nationkey < 20"
_GOOD_ORDER = "o_orderstatus IN ('F', 'O') AND o_orderdate::DATE < DATE '1997-01-01'"


@register("pg_node_types", f"SELECT 'c' || c_custkey AS id, {_GOOD_CUSTOMER} AS conforms FROM customer UNION ALL SELECT 'o' || o_orderkey, false FROM orders")
def _(spark, d):
    return _property_graph(spark, d).conforming_nodes(pg.parse_schema(_PGS), "CustomerType")


@register("pg_check_expr", f"SELECT 'o' || o_orderkey AS id, {_GOOD_ORDER} AS conforms FROM orders UNION ALL SELECT 'c' || c_custkey, false FROM customer")
def _(spark, d):
    return _property_graph(spark, d).conforming_nodes(pg.parse_schema(_PGS), "OrderType")


@register("pg_union_types", "SELECT 'o' || o_orderkey AS id, true AS conforms FROM orders UNION ALL SELECT 'c' || c_custkey, c_nationkey > 12 FROM customer")
def _(spark, d):
    return _property_graph(spark, d).conforming_nodes(pg.parse_schema(_PGS.replace("{ status: STRING, date: DATE || name", "{ (status: STRING, date: DATE) || (name").replace("CHECK > 12 })", "CHECK > 12) })")), "AnyType")


@register("pg_edge_types", f"SELECT 'e' || o_orderkey AS id, coalesce({_GOOD_ORDER} AND {_GOOD_CUSTOMER} AND regexp_matches(o_orderpriority, '^[12]'), false) AS conforms FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return _property_graph(spark, d).conforming_edges(pg.parse_schema(_PGS), "PlacedType")


@register("pg_typemap_mismatch", f"SELECT 'c' || c_custkey AS element_id, 'CustomerType' AS type_name FROM customer WHERE ({_GOOD_CUSTOMER}) <> (c_acctbal > 0)")
def _(spark, d):
    expected = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("element_id"), F.lit("CustomerType").alias("type_name"), (F.col("c_acctbal") > 0).alias("expected"))
    return _property_graph(spark, d).validate(pg.parse_schema(_PGS), expected).where(~F.col("agrees")).select("element_id", "type_name")


# statistics, comparison, generation


@register("graph_stats", "SELECT (SELECT count(*) FROM nation) * 4 + (SELECT count(*) FROM region) * 3 AS triples, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS subjects, 6::BIGINT AS predicates, (SELECT count(DISTINCT x) FROM (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region)) + (SELECT count(DISTINCT x) FROM (SELECT n_nationkey AS x FROM nation UNION SELECT r_regionkey FROM region)) + (SELECT count(DISTINCT n_regionkey) FROM nation) + 2 AS objects")
def _(spark, d):
    return stats.graph_stats(from_tables(spark, d, ("nation", "region")))


@register("void_class_partition", " UNION ALL ".join(f"SELECT '{EX}{t.capitalize()}' AS class, count(*) AS instances FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders")) + f" UNION ALL SELECT '{EX}Lineitem', count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem")
def _(spark, d):
    return stats.class_counts(from_tables(spark, d))


@register("void_property_partition", " UNION ALL ".join(f"SELECT '{EX}{c}' AS property, count(*) AS triples, count(*) AS subjects, count(DISTINCT {c}) AS objects FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + f" UNION ALL SELECT '{TYPE}', count(*), count(*), 1 FROM orders")
def _(spark, d):
    return stats.property_partition(from_tables(spark, d, ("orders",)))


@register("usage_counts", f"SELECT {NATION} AS node, 4::BIGINT AS as_subject, 0::BIGINT AS as_object FROM nation UNION ALL SELECT {NATION_REGION}, 0, count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT '{EX}Nation', 0, count(*) FROM nation")
def _(spark, d):
    return stats.usage(from_tables(spark, d, ("nation",)))


@register("conformance_metrics", "SELECT n * 5 AS triples, n * 2 AS valid, n * 2 * 100.0::DOUBLE / (n * 5) AS validity, 1::BIGINT AS lost, 1 * 100.0::DOUBLE / 3 AS translation_loss FROM (SELECT count(*) AS n FROM customer)")
def _(spark, d):
    schema = spark.createDataFrame([(EX + "Customer", EX + "c_name", 1), (EX + "Customer", EX + "c_acctbal", None), (EX + "Customer", EX + "c_comment", 1)], "class string, property string, most int")
    return stats.conformance_metrics(from_tables(spark, d, ("customer",)), schema)


@register("generate_balanced", f"SELECT '{EX}Person-' || (i + 1) AS s, p, CASE WHEN p = 'type' THEN 1 WHEN p = 'name' THEN 1 ELSE (i % 4)::INTEGER END AS n FROM generate_series(0, 499) g(i), (VALUES ('type'), ('name'), ('mail')) v(p) WHERE NOT (p = 'mail' AND i % 4 = 0) UNION ALL SELECT '{EX}City-' || (i + 1), 'type', 1 FROM generate_series(0, 499) g(i)")
def _(spark, d):
    person = generate.Shape(EX + "Person", (generate.Property(EX + "name", generator="person"), generate.Property(EX + "mail", low=0, high=3, pattern="??##@ex.org")))
    made = generate.generate(spark, [person, generate.Shape(EX + "City")], 1000)
    name = F.regexp_replace(F.regexp_extract("p", "[#/]([^#/]*)$", 1), "^22-rdf.*", "")
    return made.groupBy("s", name.alias("p")).agg(F.count(F.lit(1)).cast("int").alias("n"))
