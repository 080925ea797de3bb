"""Property graphs and PG-Schema: labels, records and checks as Columns over node and edge tables.

nodes: id, labels (sorted, distinct), props MAP<key, ARRAY<STRUCT<t, s, i, d, b>>>; edges: also src and dst.
A type's label part is a set of label sets, its property part a set of record types; both are made on
the driver once for each type, and an element conforms if its labels are one of the sets and its
record fits one of the record types. mode 'native': labels match exactly, and combining records drops
`open`; 'spec' keeps open labels and open records.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<t:string,s:string,i:bigint,d:date,b:boolean>"
PROPS = f"map<string,array<{VALUE}>>"
NODES = f"id string, labels array<string>, props {PROPS}"
EDGES = f"id string, src string, dst string, labels array<string>, props {PROPS}"


class PgError(ValueError):
    pass


# values of a record
def value(x) -> tuple:
    if isinstance(x, bool):
        return ("b", None, None, None, x)
    if isinstance(x, int):
        return ("i", None, x, None, None)
    if isinstance(x, dt.date):
        return ("d", None, None, x, None)
    return ("s", str(x), None, None, None)


def value_column(kind: str, c: Column) -> Column:
    """An array of one value of a column; kind: s, i, d or b."""
    typed = {"s": "string", "i": "bigint", "d": "date", "b": "boolean"}
    fields = [F.lit(kind).alias("t")] + [(c if k == kind else F.lit(None)).cast(typ).alias(k) for k, typ in typed.items()]
    return F.array(F.struct(*fields))


# schema
@dataclass(frozen=True)
class Cond:
    op: str  # true false = > < >= <= regex and or not
    args: tuple = ()


@dataclass(frozen=True)
class ValueType:
    kind: str  # s i d b any and or check
    low: int = 1
    high: int | None = 1
    check: Cond | None = None
    parts: tuple = ()


@dataclass(frozen=True)
class Record:
    fields: tuple = ()  # (key, ValueType), sorted
    open: bool = False


@dataclass(frozen=True)
class Labels:
    """name, ref, and, or, any."""

    kind: str
    name: str = ""
    parts: tuple = ()


@dataclass(frozen=True)
class Props:
    """field, each, one, none."""

    kind: str
    key: str = ""
    type: ValueType | None = None
    optional: bool = False
    parts: tuple = ()


@dataclass(frozen=True)
class NodeType:
    labels: Labels | None = None
    props: Props | None = None
    open: bool = False


@dataclass(frozen=True)
class EdgeType:
    source: NodeType
    own: NodeType
    target: NodeType


@dataclass
class PgSchema:
    nodes: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)
    graphs: dict = field(default_factory=dict)

    def semantics(self, t: NodeType, seen: tuple = ()) -> tuple[set[frozenset], set[Record]]:
        """The label sets and record types of a type."""
        labels, from_labels = self._labels(t.labels, seen) if t.labels else ({frozenset()}, {Record()})
        records = self._records(t.props) if t.props else {Record()}
        combined = {self._combine(a, b) for a, b in product(from_labels, records)}
        return labels, {Record(r.fields, r.open or t.open) for r in combined}

    def _labels(self, e: Labels, seen: tuple):
        if e.kind == "name":
            return {frozenset([e.name])}, {Record()}
        if e.kind == "ref":
            if e.name in seen:
                raise PgError(f"{e.name} refers to itself")
            if e.name not in self.nodes:
                raise PgError(f"no type {e.name}")
            return self.semantics(self.nodes[e.name], (*seen, e.name))
        a, b = (self._labels(p, seen) for p in e.parts)
        if e.kind == "or":
            return a[0] | b[0], a[1] | b[1]
        return {x | y for x, y in product(a[0], b[0])}, {self._combine(x, y) for x, y in product(a[1], b[1])}

    def _records(self, e: Props) -> set[Record]:
        if e.kind == "none":
            return {Record()}
        if e.kind == "field":
            own = Record(((e.key, e.type),))
            return {own, Record()} if e.optional else {own}
        parts = [self._records(p) for p in e.parts]
        return set().union(*parts) if e.kind == "one" else {reduce(self._combine, c) for c in product(*parts)}

    mode: str = "native"

    def _combine(self, a: Record, b: Record) -> Record:
        fields = dict(a.fields)
        for k, t in b.fields:
            fields[k] = ValueType("and", parts=(fields[k], t)) if k in fields and fields[k] != t else t
        return Record(tuple(sorted(fields.items(), key=lambda x: x[0])), (a.open or b.open) and self.mode != "native")


# conformance as Columns
def cond_column(c: Cond, v: Column) -> Column:
    """Whether a value passes; null where the types don't fit, which counts as failing."""
    if c.op in ("true", "false"):
        return F.lit(c.op == "true")
    if c.op in ("and", "or"):
        a, b = (cond_column(x, v) for x in c.args)
        both = a.isNotNull() & b.isNotNull()
        return F.when(both, a & b if c.op == "and" else a | b)
    if c.op == "not":
        return ~cond_column(c.args[0], v)
    if c.op == "regex":
        return F.when(v["t"] == "s", v["s"].rlike(c.args[0]))
    t, *fields = value(c.args[0])
    k = {"s": "s", "i": "i", "d": "d", "b": "b"}[t]
    x, y = v[k], F.lit(next(f for f in fields if f is not None))
    return F.when(v["t"] == t, {"=": x == y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[c.op])


def type_column(t: ValueType, values: Column) -> Column:
    size = F.coalesce(F.size(values), F.lit(0))
    if t.kind == "any":
        own = F.lit(True)
    elif t.kind == "check":
        own = F.lit(True)
    elif t.kind in ("and", "or"):
        a, b = (type_column(p, values) for p in t.parts)
        return a & b if t.kind == "and" else a | b
    else:
        own = (size >= t.low) & F.forall(values, lambda v: v["t"] == t.kind)
        own = own if t.high is None else own & (size <= t.high)
    if t.check is not None:
        own = own & F.forall(values, lambda v: F.coalesce(cond_column(t.check, v), F.lit(False)))
    return F.coalesce(own, F.lit(False))


def record_column(r: Record, props: Column) -> Column:
    keys = [k for k, _ in r.fields]
    tests = [F.coalesce(F.array_contains(F.map_keys(props), k), F.lit(False)) & type_column(t, props[k]) for k, t in r.fields]
    if not r.open:
        tests.append(F.size(F.array_except(F.map_keys(props), F.array(*map(F.lit, keys)).cast("array<string>"))) == 0)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def element_column(schema: PgSchema, t: NodeType, labels: Column, props: Column) -> Column:
    sets, records = schema.semantics(t)
    if schema.mode != "native" and t.open:
        fits = [F.size(F.array_except(F.array(*map(F.lit, sorted(s))).cast("array<string>"), labels)) == 0 for s in sets]
        label_ok = reduce(lambda a, b: a | b, fits)
    else:
        label_ok = F.concat_ws("\x1f", F.array_sort(labels)).isin(*sorted("\x1f".join(sorted(s)) for s in sets))
    return label_ok & reduce(lambda a, b: a | b, [record_column(r, props) for r in sorted(records, key=repr)])


@dataclass
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, nodes=(), edges=()) -> PropertyGraph:
        """nodes: (id, labels, {key: value or list}); edges: (id, src, dst, labels, record)."""
        flat = lambda r: {k: [value(x) for x in dict.fromkeys(v if isinstance(v, (list, tuple)) else [v])] for k, v in r.items()}
        n = spark.createDataFrame([(i, sorted(set(ls)), flat(r)) for i, ls, r in nodes], NODES)
        e = spark.createDataFrame([(i, a, b, sorted(set(ls)), flat(r)) for i, a, b, ls, r in edges], EDGES)
        return cls(n, e)

    def merge(self, other: PropertyGraph) -> PropertyGraph:
        """By name: the second graph's element wins where both have one."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b.select("id"), "id", "left_anti").unionByName(b)

        return PropertyGraph(both(self.nodes, other.nodes), both(self.edges, other.edges))

    def conforming_nodes(self, schema: PgSchema, name: str, only: DataFrame | None = None) -> DataFrame:
        """id, conforms of every node for a node type; only: the ids to look at."""
        nodes = self.nodes if only is None else self.nodes.join(only, "id", "left_semi")
        return nodes.select("id", element_column(schema, schema.nodes[name], F.col("labels"), F.col("props")).alias("conforms"))

    def conforming_edges(self, schema: PgSchema, name: str, only: DataFrame | None = None) -> DataFrame:
        """id, conforms of every edge: its source, itself and its target; only: the ids to look at."""
        t = schema.edges[name]
        edges = self.edges if only is None else self.edges.join(only, "id", "left_semi")
        ends = self.nodes.select(F.col("id").alias("nid"), element_column(schema, t.source, F.col("labels"), F.col("props")).alias("as_source"), element_column(schema, t.target, F.col("labels"), F.col("props")).alias("as_target"))
        own = edges.select("id", "src", "dst", element_column(schema, t.own, F.col("labels"), F.col("props")).alias("own"))
        a = own.join(ends.select(F.col("nid").alias("src"), "as_source"), "src", "left")
        b = a.join(ends.select(F.col("nid").alias("dst"), "as_target"), "dst", "left")
        return b.select("id", F.coalesce(F.col("own") & F.col("as_source") & F.col("as_target"), F.lit(False)).alias("conforms"))

    def validate(self, schema: PgSchema, typemap: DataFrame) -> DataFrame:
        """element_id, type_name, expected, conforms, agrees; a missing element is an error."""
        names = sorted(r["type_name"] for r in typemap.select("type_name").distinct().collect())
        parts = []
        for name in names:
            if name not in schema.nodes and name not in schema.edges:
                raise PgError(f"no type {name}")
            # a type is tested on the elements that the map gives it
            ids = typemap.where(F.col("type_name") == name).select(F.col("element_id").alias("id")).distinct()
            found = (self.conforming_nodes if name in schema.nodes else self.conforming_edges)(schema, name, ids)
            parts.append(found.select("id", F.lit(name).alias("of"), "conforms"))
        if not parts:
            return self.nodes.sparkSession.createDataFrame([], "element_id string, type_name string, expected boolean, conforms boolean, agrees boolean")
        known = reduce(DataFrame.unionByName, parts)
        joined = typemap.join(known, (F.col("element_id") == F.col("id")) & (F.col("type_name") == F.col("of")), "left")
        missing = F.raise_error(F.concat(F.lit("no element "), F.col("element_id"))).cast("boolean")
        conforms = F.when(F.col("id").isNull(), missing).otherwise(F.col("conforms"))
        return joined.select("element_id", "type_name", "expected", conforms.alias("conforms"), (conforms == F.col("expected")).alias("agrees"))


def write_results(results: DataFrame, path: str, kind: str = "json") -> None:
    """Validation results as JSON lines or CSV with a header, one part for each partition."""
    if kind not in ("json", "csv"):
        raise PgError(f"no such sink: {kind}")
    (results.write.json(path) if kind == "json" else results.write.option("header", True).csv(path))


# text formats
_TOKEN = re.compile(
    r"""\s+|//[^\n]*|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<date>\d{4}-\d{2}-\d{2})|(?P<number>-?\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\)-\[|\]->|-\[|->|\|\||>=|<=|[(){}\[\]:;,&|@?+*=><!-])""",
    re.X,
)


class _Tokens:
    def __init__(self, text: str):
        self.all, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PgError(f"unexpected {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup == "op" and m[0] == ")-[":
                self.all += [("op", ")"), ("op", "-[")]
            elif m.lastgroup:
                self.all.append((m.lastgroup, m[0]))
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.all[self.at + ahead][1] if self.at + ahead < len(self.all) else ""

    def kind(self) -> str:
        return self.all[self.at][0] if self.at < len(self.all) else "end"

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if want is not None and got.upper() != want.upper():
            raise PgError(f"expected {want!r}, found {got!r}")
        self.at += 1
        return got

    def accept(self, *words: str) -> bool:
        if self.peek().upper() in words:
            self.at += 1
            return True
        return False

    def single(self):
        kind, raw = self.kind(), self.take()
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", raw[1:-1])
        if kind == "number":
            return int(raw)
        if kind == "date":
            return dt.date.fromisoformat(raw)
        if raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        raise PgError(f"{raw!r} is no value")


def parse_graph(text: str) -> tuple[list, list]:
    """Nodes `(n {L, M} [ k: v, k: [v, w] ])` and edges `(a) -(e {l} [ .. ])-> (b)`."""
    t, nodes, edges = _Tokens(text), [], []

    def names() -> list:
        out = []
        if t.accept("{"):
            while not t.accept("}"):
                out.append(t.take())
                t.accept(",", "&")
        return out

    def record() -> dict:
        out: dict = {}
        if t.accept("["):
            while not t.accept("]"):
                key = t.single() if t.kind() == "string" else t.take()
                t.take(":")
                if t.accept("["):
                    values = []
                    while not t.accept("]"):
                        values.append(t.single())
                        t.accept(",")
                else:
                    values = [t.single()]
                out[key] = out.get(key, []) + values
                t.accept(",")
        return out

    while t.kind() != "end":
        t.take("(")
        name = t.take()
        if t.accept(")") and t.peek() == "-":
            t.take("-")
            t.take("(")
            own = t.take()
            labels, fields = names(), record()
            t.take(")")
            t.take("->")
            t.take("(")
            target = t.take()
            t.take(")")
            edges.append((own, name, target, labels, fields))
        else:
            if t.all[t.at - 1][1] == ")":
                nodes.append((name, [], {}))
            else:
                labels, fields = names(), record()
                t.take(")")
                nodes.append((name, labels, fields))
        t.accept(";", ",")
    return nodes, edges


def parse_typemap(text: str) -> list[tuple[str, str, bool]]:
    """`n: T, m:!T` as (element, type, expected)."""
    t, out = _Tokens(text), []
    while t.kind() != "end":
        name = t.take()
        t.take(":")
        negative = t.accept("!")
        out.append((name, t.take(), not negative))
        t.accept(",", ";")
    return out


def parse_schema(text: str, mode: str = "native") -> PgSchema:
    t, out = _Tokens(text), PgSchema()
    out.mode = mode

    def labels(least: int = 0) -> Labels:
        if t.accept("("):
            left = labels()
            t.take(")")
        elif t.accept("["):
            left = labels()
            t.take("]")
        elif t.accept("@"):
            left = Labels("ref", t.take())
        else:
            left = Labels("name", t.take())
        while (t.peek() == "|" and least < 3) or (t.peek() == "&" and least < 2):
            op = t.take()
            left = Labels("and" if op == "&" else "or", parts=(left, labels(2 if op == "&" else 3)))
        return left

    def cond(least: int = 0) -> Cond:
        if t.accept("NOT"):
            left = Cond("not", (cond(3),))
        elif t.accept("("):
            left = cond()
            t.take(")")
        elif t.peek().upper() in ("TRUE", "FALSE"):
            left = Cond(t.take().lower())
        elif t.accept("REGEX"):
            left = Cond("regex", (t.single(),))
        else:
            op = t.take()
            if op not in ("=", ">", "<", ">=", "<="):
                raise PgError(f"{op!r} is no condition")
            left = Cond(op, (t.single(),))
        while (t.peek().upper() == "OR" and least < 2) or (t.peek().upper() == "AND" and least < 1):
            op = t.take().lower()
            left = Cond(op, (left, cond(1 if op == "and" else 2)))
        return left

    def simple() -> ValueType:
        word = t.take().upper()
        if word == "CHECK":
            return ValueType("check", check=cond())
        kinds = {"STRING": "s", "INTEGER": "i", "INT": "i", "DATE": "d", "BOOL": "b", "BOOLEAN": "b", "ANY": "any"}
        if word not in kinds:
            raise PgError(f"no such type: {word}")
        low, high = 1, 1
        if kinds[word] != "any":
            if t.accept("?"):
                low, high = 0, 1
            elif t.accept("+"):
                low, high = 1, None
            elif t.accept("*"):
                low, high = 0, None
            elif t.accept("{"):
                low = int(t.take())
                t.take(",")
                top = t.take()
                high = None if top == "*" else int(top)
                t.take("}")
        return ValueType(kinds[word], low, high, cond() if t.accept("CHECK") else None)

    def type_spec() -> ValueType:
        left = simple()
        if t.peek() in ("&", "|"):
            op = t.take()
            return ValueType("and" if op == "&" else "or", parts=(left, type_spec()))
        return left

    def props(least: int = 0) -> Props:
        if t.accept("("):
            left = props()
            t.take(")")
        else:
            optional = t.accept("OPTIONAL")
            key = t.single() if t.kind() == "string" else t.take()
            t.take(":")
            left = Props("field", key, type_spec(), optional)
        while (t.peek() == "||" and least < 3) or (t.peek() == "," and least < 2):
            op = t.take()
            left = Props("each" if op == "," else "one", parts=(left, props(2 if op == "," else 3)))
        return left

    def body() -> NodeType:
        ls = labels() if t.accept(":") else None
        open_ = t.accept("OPEN")
        ps = None
        if t.accept("{"):
            ps = Props("none") if t.peek() == "}" else props()
            t.take("}")
        return NodeType(ls, ps, open_)

    def named() -> tuple[str, NodeType]:
        name = t.take() if t.kind() == "name" and t.peek(1) in (":", "{", ")", "]->") else ""
        return name, body()

    while t.kind() != "end":
        t.take("CREATE")
        what = t.take().upper()
        if what == "NODE":
            t.take("TYPE")
            t.take("(")
            name, own = named()
            t.take(")")
            out.nodes[name or f"node{len(out.nodes)}"] = own
        elif what == "EDGE":
            t.take("TYPE")
            t.take("(")
            source = body()
            t.take(")")
            t.take("-[")
            name, own = named()
            t.take("]->")
            t.take("(")
            target = body()
            t.take(")")
            out.edges[name or f"edge{len(out.edges)}"] = EdgeType(source, own, target)
        elif what == "GRAPH":
            # read, but without a meaning of its own
            t.take("TYPE")
            name = t.take()
            mode_ = t.take() if t.peek().upper() in ("STRICT", "LOOSE") else ""
            t.take("{")
            elements = []
            while not t.accept("}"):
                elements.append(t.take())
            out.graphs[name] = (mode_, tuple(elements))
        else:
            raise PgError(f"CREATE {what} isn't known")
        t.accept(";")
    # an endpoint names a type where there is one, and a label otherwise
    named_types = set(out.nodes)

    def settle(e: NodeType) -> NodeType:
        ls = e.labels
        if ls is not None and ls.kind == "name" and ls.name in named_types:
            return NodeType(Labels("ref", ls.name), e.props, e.open)
        return e

    out.edges = {k: EdgeType(settle(e.source), e.own, settle(e.target)) for k, e in out.edges.items()}
    return out


def show(schema: PgSchema, name: str) -> str:
    """A type's label sets and record types as text."""
    sets, records = schema.semantics(schema.nodes[name] if name in schema.nodes else schema.edges[name].own)
    lines = ["labels: " + " | ".join("{" + ", ".join(sorted(s)) + "}" for s in sorted(sets, key=sorted))]
    lines += ["record: {" + ", ".join(f"{k}: {t.kind}" for k, t in r.fields) + "}" + (" open" if r.open else "") for r in sorted(records, key=repr)]
    return "\n".join(lines)
