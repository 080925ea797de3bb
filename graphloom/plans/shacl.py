"""SHACL: shapes as dataclasses, validation as DataFrame plans.

A shape's focus nodes are a DataFrame (fk, focus): fk is the text key of the term. Value nodes are
(fk, value). All tests that look at a value alone are one projection: an array of (component, violated) that is
filtered and exploded. Counts share one aggregation. Class, pair, logical and shape components are
semi, anti and left joins. Each referenced shape is evaluated on the set of value nodes at once.

mode 'native' follows the documented native engine: a class target or sh:class knows direct types
(sh:class also one level of subclasses), lengths are bytes. mode 'spec' follows subclasses
transitively and counts characters. A shape that refers to itself is taken to hold where it is met again.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import KEY, RDF, RDFS, SH, SUBCLASS, TYPE, Term, compare, constant, ill_typed, iri, is_term, key_of, regex, resource
from ..operators.graph import Graph, spread
from ..operators.paths import Alt, Inv, Opt, Plus, Pred, Seq, Star, pairs, reach, text_of

COLUMNS = ("focus", "component", "severity", "source_shape", "path", "value", "message")
NODE_KINDS = {
    "IRI": ("iri",), "BlankNode": ("bnode",), "Literal": ("literal",), "BlankNodeOrIRI": ("bnode", "iri"), "IRIOrLiteral": ("iri", "literal"), "BlankNodeOrLiteral": ("bnode", "literal"),
}
#: Subclasses that are joined by broadcast, after a count.
FEW_CLASSES = 100_000
SEVERITIES = ("Trace", "Debug", "Info", "Warning", "Violation")


class ShaclError(ValueError):
    pass


@dataclass(frozen=True)
class Constraint:
    """A component and its arguments; shapes are given by id."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Shape:
    id: str
    path: object = None
    targets: tuple = ()  # (kind, value): node, class, subjectsOf, objectsOf, implicit
    constraints: tuple = ()
    severity: str = "Violation"
    messages: tuple = ()  # (language, text)
    deactivated: bool = False


@dataclass(frozen=True)
class Schema:
    shapes: dict = field(default_factory=dict)
    prefixes: dict = field(default_factory=dict)

    @classmethod
    def of(cls, *shapes: Shape) -> Schema:
        return cls({s.id: s for s in shapes})

    def references(self) -> dict[str, list[tuple[str, str]]]:
        """shape -> (shape, polarity) of its components; `not` flips it."""
        out = {}
        for s in self.shapes.values():
            out[s.id] = []
            for c in s.constraints:
                if c.name in ("and", "or", "xone"):
                    out[s.id] += [(x, "+") for x in c.args[0]]
                elif c.name in ("node", "property", "qualified"):
                    out[s.id].append((c.args[0], "+"))
                elif c.name == "not":
                    out[s.id].append((c.args[0], "-"))
        return out

    def negative_cycles(self) -> list[str]:
        """Shapes that reach themselves through a `not`."""
        refs = self.references()

        def reaches(at: str, to: str, seen: set) -> bool:
            return any(n == to or (n not in seen and reaches(n, to, seen | {n})) for n, _ in refs.get(at, ()))

        return sorted({s for s, rs in refs.items() for n, sign in rs if sign == "-" and (n == s or reaches(n, s, set()))})


class Validator:
    def __init__(self, graph: Graph, schema: Schema, mode: str = "native"):
        self.graph, self.schema, self.mode = graph, schema, mode
        self.stack: list[str] = []

    # focus and value nodes
    def _resources(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).alias("fk"), resource(F.col(name)).alias("focus"))

    def _terms(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(key_of(F.col(name)).alias("fk"), F.col(name).alias("focus"))

    def subclasses(self, cls: str) -> DataFrame:
        """node: the class's subclasses, one level (native) or all (spec)."""
        if self.mode == "native":
            return self.graph.pattern(p=SUBCLASS, o=iri(cls)).select(F.col("s").alias("node"))
        edges = self.graph.pattern(p=SUBCLASS).where(F.col("o.k") != "literal").select(F.col("o.lex").alias("start"), F.col("s").alias("end"))
        seed = self.graph.spark.createDataFrame([(cls, cls)], "start string, end string")
        return reach(edges, seed).select(F.col("end").alias("node")).where(F.col("node") != cls)

    def instances(self, cls: str, levels: bool) -> DataFrame:
        """node: instances of a class, and of its subclasses."""
        direct = self.graph.pattern(p=TYPE, o=iri(cls)).select(F.col("s").alias("node"))
        if not levels or not self.graph.may_have(SUBCLASS):
            return direct
        sub = self.subclasses(cls).withColumnRenamed("node", "sub")
        if sub.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES:
            # all instances of a class would meet in one task
            sub = F.broadcast(sub.distinct())
        below = self.graph.pattern(p=TYPE).where(F.col("o.k") == "iri").join(sub, F.col("o.lex") == F.col("sub")).select(F.col("s").alias("node"))
        return direct.unionByName(below)

    def focus_nodes(self, shape: Shape) -> DataFrame:
        kinds = {kind for kind, _ in shape.targets}
        if kinds and kinds <= {"class", "implicit", "subjectsOf"} and not (len(shape.targets) == 1 and kinds == {"class"}):
            # resources are told apart by their text, and terms are made of them afterwards
            names = [self.graph.bag(v).select("s") if k == "subjectsOf" else self.instances(v, k == "implicit" or self.mode != "native") for k, v in shape.targets]
            return self._resources(reduce(DataFrame.union, names).toDF("node").distinct(), "node")
        parts = []
        for kind, value in shape.targets:
            if kind == "node":
                if value.k == "bnode":
                    raise ShaclError("a blank node can't be a target node")
                one = self.graph.spark.range(1).select(constant(value).alias("focus"))
                parts.append(self._terms(one, "focus"))
            elif kind == "class":
                parts.append(self._resources(self.instances(value, self.mode != "native"), "node"))
            elif kind == "implicit":
                parts.append(self._resources(self.instances(value, True), "node"))
            elif kind == "subjectsOf":
                parts.append(self._resources(self.graph.pattern(p=value), "s"))
            elif kind == "objectsOf":
                parts.append(self._terms(self.graph.pattern(p=value), "o"))
            else:
                raise ShaclError(f"no such target: {kind}")
        if not parts:
            return None
        kind = shape.targets[0][0]
        if len(parts) == 1 and (kind == "node" or (kind == "class" and self.mode == "native" and self.graph.sets)):
            return parts[0]
        return reduce(DataFrame.unionByName, parts).dropDuplicates(["fk"])

    def objects(self, focus: DataFrame, path, cls: str | None = None, once: bool = True) -> DataFrame:
        """fk, value: the set of values of each focus node. cls: the class whose instances, all of them, are the focus nodes. once: each value once."""
        if isinstance(path, str):
            path = Pred(path)
        if isinstance(path, Pred):
            triples = self.graph.pattern(p=path.iri) if once else self.graph.bag(path.iri)
            found = triples.select(F.col("s").alias("start"), F.col("o").alias("end"))
            if cls is not None and self.graph.covers(cls, path.iri):
                return found.select(F.col("start").alias("fk"), F.col("end").alias("value"))
            joined = focus.select("fk").join(found, F.col("fk") == F.col("start")).select("fk", F.col("end").alias("value"))
            return joined if self.graph.sets or not once else joined.distinct()
        if cls is not None and isinstance(path, Alt) and all(isinstance(x, Pred) and self.graph.covers(cls, x.iri) for x in path.parts):
            return pairs(self.graph, path).select(F.col("start").alias("fk"), F.col("end").alias("value"))
        seeds = focus.where(F.col("focus.k") != "literal").select(F.col("fk").alias("start"))
        found = pairs(self.graph, path, seeds, strict=self.mode == "native")
        return focus.select("fk").join(found, F.col("fk") == F.col("start")).select("fk", F.col("end").alias("value"))

    # evaluation
    def failing(self, shape_id: str, nodes: DataFrame) -> DataFrame:
        """fk: which of the nodes (fk, focus) don't conform to a shape."""
        if shape_id in self.stack:
            return nodes.select("fk").limit(0)
        found = self.check(self._shape(shape_id), nodes)
        return nodes.select("fk").limit(0) if found is None else found.select(F.col("focus").alias("fk")).distinct()

    def _shape(self, shape_id: str) -> Shape:
        if shape_id not in self.schema.shapes:
            raise ShaclError(f"no shape {shape_id}")
        return self.schema.shapes[shape_id]

    def _rows(self, shape: Shape, df: DataFrame, component, value: Column | None = None, path: Column | None = None, message: Column | None = None) -> DataFrame:
        """Violations from (fk, ...)."""
        text = dict(shape.messages).get("", next((m for _, m in sorted(shape.messages)), ""))
        own = F.lit(text_of(shape.path) if shape.path is not None else None)
        return df.select(
            F.col("fk").alias("focus"),
            (F.concat(F.lit(""), component) if isinstance(component, Column) else F.lit(component)).alias("component"),
            F.lit(shape.severity).alias("severity"),
            F.lit(shape.id).alias("source_shape"),
            (own if path is None else path).cast("string").alias("path"),
            (F.lit(None) if value is None else value).cast("string").alias("value"),
            (F.lit(text) if message is None else F.coalesce(message, F.lit(text))).alias("message"),
        )

    def check(self, shape: Shape, focus: DataFrame, cls: str | None = None) -> DataFrame | None:
        """The violations of the focus nodes (all instances of cls, if it is given); None where the shape can have none."""
        if shape.deactivated:
            return None
        self.stack.append(shape.id)
        try:
            values = focus.select("fk", F.col("focus").alias("value")) if shape.path is None else self.objects(focus, shape.path, cls)
            out = []
            tests = [(c.name, t) for c in shape.constraints if (t := self._value_test(c)) is not None]
            if tests:
                marks = F.array(*(F.struct(F.lit(n).alias("component"), F.coalesce(t, F.lit(True)).alias("bad")) for n, t in tests))
                bad = values.select("fk", "value", F.explode(F.filter(marks, lambda x: x["bad"])).alias("x"))
                out.append(self._rows(shape, bad, F.col("x.component"), F.col("value.lex")))
            counts = [c for c in shape.constraints if (c.name == "minCount" and c.args[0] > 0) or c.name == "maxCount"]
            if counts:
                n = values.groupBy("fk").agg(F.count("*").alias("n"))
                # without a least count, only nodes with values matter
                counted = focus.select("fk").join(n, "fk", "left") if any(c.name == "minCount" for c in counts) else n
                size = F.coalesce("n", F.lit(0))
                marks = F.array(*(F.when((size < c.args[0]) if c.name == "minCount" else (size > c.args[0]), F.lit(c.name)) for c in counts))
                out.append(self._rows(shape, counted.select("fk", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("c")), F.col("c")))
            for c in shape.constraints:
                found = self._other(shape, c, focus, values, cls)
                if found is not None:
                    out.append(found)
            return reduce(DataFrame.unionByName, out) if out else None
        finally:
            self.stack.pop()

    def _value_test(self, c: Constraint) -> Column | None:
        """What is wrong with a value that its component sees alone; null counts as wrong."""
        v, a = F.col("value"), c.args
        unfit = v["k"].isin("bnode", "triple")
        if c.name == "datatype":
            return (v["k"] != "literal") | (v["dt"] != a[0]) | ill_typed(v)
        if c.name == "nodeKind":
            return ~v["k"].isin(*NODE_KINDS[a[0]])
        if c.name in ("minExclusive", "minInclusive", "maxExclusive", "maxInclusive"):
            op = {"minExclusive": ">", "minInclusive": ">=", "maxExclusive": "<", "maxInclusive": "<="}[c.name]
            return ~F.coalesce(compare(v, op, constant(a[0])), F.lit(False))
        if c.name in ("minLength", "maxLength"):
            n = F.octet_length(v["lex"]) if self.mode == "native" else F.length(v["lex"])
            return unfit | (n < a[0] if c.name == "minLength" else n > a[0])
        if c.name == "pattern":
            return unfit | ~v["lex"].rlike(regex(*a))
        if c.name == "languageIn":
            lang = F.lower(v["lang"])
            fits = [(lang == x.lower()) | lang.startswith(x.lower() + "-") for x in a[0]]
            return (v["lang"] == "") | ~reduce(lambda x, y: x | y, fits)
        if c.name == "in":
            return ~key_of(v).isin(*(_key(t) for t in a[0]))
        return None

    def _nodes(self, shape: Shape, focus: DataFrame, values: DataFrame) -> DataFrame:
        """The value nodes as focus nodes; a node shape's own are its focus nodes."""
        if shape.path is None:
            return focus.select("fk", "focus")
        return values.select(key_of(F.col("value")).alias("fk"), F.col("value").alias("focus")).dropDuplicates(["fk"])

    def _other(self, shape: Shape, c: Constraint, focus: DataFrame, values: DataFrame, cls: str | None) -> DataFrame | None:
        v, a = F.col("value"), c.args
        keyed = values.withColumn("vk", key_of(v))
        if c.name == "class":
            known = self.instances(a[0], True).select(F.col("node").alias("vk"))
            return self._rows(shape, keyed.join(known, "vk", "left_anti"), c.name, F.col("value.lex"))
        if c.name == "hasValue":
            have = values.where(is_term(v, a[0])).select("fk").distinct()
            return self._rows(shape, focus.select("fk").join(have, "fk", "left_anti"), c.name)
        if c.name == "uniqueLang" and a[0]:
            twice = values.where(F.col("value.lang") != "").groupBy("fk", F.col("value.lang").alias("lang")).agg(F.count("*").alias("n")).where("n > 1")
            return self._rows(shape, twice, c.name)
        if c.name in ("lessThan", "lessThanOrEquals"):
            other = self.objects(focus, a[0], cls).select("fk", F.col("value").alias("other"))
            fits = compare(v, "<" if c.name == "lessThan" else "<=", F.col("other"))
            return self._rows(shape, values.join(other, "fk").where(~F.coalesce(fits, F.lit(False))), c.name, F.col("value.lex"))
        if c.name in ("equals", "disjoint"):
            # which sides have the value, in one grouping that makes sets of both; it holds texts as keys alone
            mine = values if shape.path is None else self.objects(focus, shape.path, cls, once=False)
            sides = [df.select("fk", *(F.col(f"value.{f}") for f in KEY), F.lit(k).alias("side")) for k, df in ((1, mine), (2, self.objects(focus, a[0], cls, once=False)))]
            held = spread(sides[0].unionByName(sides[1]), "fk", "lex").groupBy("fk", *KEY).agg(F.bit_or("side").alias("sides"))
            return self._rows(shape, held.where(F.col("sides") == 3 if c.name == "disjoint" else F.col("sides") != 3), c.name, F.col("lex"))
        if c.name == "property":
            inner = self.check(self._shape(a[0]), self._nodes(shape, focus, values), cls if shape.path is None else None)
            if inner is None or shape.path is None:
                return inner
            # a result for each parent of a value node
            return keyed.select("vk").join(inner, F.col("vk") == F.col("focus")).select(*inner.columns)
        if c.name in ("node", "and", "not", "or", "xone"):
            nodes = self._nodes(shape, focus, values)
            fails = [self.failing(s, nodes).select(F.col("fk").alias("vk"), F.lit(1).alias(f"f{i}")) for i, s in enumerate(a[0] if c.name in ("and", "or", "xone") else (a[0],))]
            marked = keyed
            for f in fails:
                marked = marked.join(f, "vk", "left")
            bad = sum((F.coalesce(F.col(f"f{i}"), F.lit(0)) for i in range(len(fails))), F.lit(0))
            wrong = {"node": bad > 0, "and": bad > 0, "not": bad == 0, "or": bad == len(fails), "xone": bad != len(fails) - 1}[c.name]
            return self._rows(shape, marked.where(wrong), c.name, F.col("value.lex"))
        if c.name == "qualified":
            inner, least, most, siblings = a
            nodes = self._nodes(shape, focus, values)
            fit = keyed.join(self.failing(inner, nodes).withColumnRenamed("fk", "vk"), "vk", "left_anti")
            for s in siblings:
                fit = fit.join(self.failing(s, nodes).withColumnRenamed("fk", "vk"), "vk", "left_semi")
            counted = focus.select("fk").join(fit.groupBy("fk").agg(F.count("*").alias("n")), "fk", "left")
            n = F.coalesce("n", F.lit(0))
            marks = F.array(F.when(n < least, F.lit("qualifiedMinCount")) if least is not None else F.lit(None), F.when(n > most, F.lit("qualifiedMaxCount")) if most is not None else F.lit(None))
            return self._rows(shape, counted.select("fk", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("c")), F.col("c"))
        if c.name == "closed":
            allowed = set(a[0]) | set(self._defined(shape))
            extra = self.graph.triples().where(~F.col("p").isin(*allowed)) if allowed else self.graph.triples()
            found = focus.select("fk").join(extra, F.col("fk") == F.col("s"))
            return self._rows(shape, found, c.name, F.col("o.lex"), F.concat(F.lit("<"), F.col("p"), F.lit(">")))
        if c.name == "reifier":
            return self._reifier(shape, a, focus)
        if c.name == "sparql":
            return self._sparql(shape, a, focus)
        return None

    def _defined(self, shape: Shape) -> list[str]:
        props = [self._shape(c.args[0]) for c in shape.constraints if c.name == "property"]
        return [p.path.iri if isinstance(p.path, Pred) else p.path for p in props if isinstance(p.path, (Pred, str))]

    def _reifier(self, shape: Shape, a, focus: DataFrame) -> DataFrame:
        """Each triple of the path must have a reifier (if required), and reifiers must conform."""
        inner, required = a
        predicate = shape.path.iri if isinstance(shape.path, Pred) else shape.path
        text = F.concat(F.lit("<<( "), _quoted(resource(F.col("s"))), F.lit(f" <{predicate}> "), _quoted(F.col("o")), F.lit(" )>>"))
        own = focus.select("fk").join(self.graph.pattern(p=predicate), F.col("fk") == F.col("s")).select("fk", F.col("o").alias("value"), text.alias("triple"))
        reified = self.graph.pattern(p=RDF + "reifies").select(F.col("s").alias("reifier"), F.col("o.lex").alias("of"))
        out = []
        if required:
            out.append(self._rows(shape, own.join(reified, F.col("triple") == F.col("of"), "left_anti"), "reificationRequired", F.col("value.lex")))
        if inner is not None:
            joined = own.join(reified, F.col("triple") == F.col("of"))
            fails = self.failing(inner, self._resources(joined.select("reifier").distinct(), "reifier"))
            out.append(self._rows(shape, joined.join(fails.withColumnRenamed("fk", "reifier"), "reifier", "left_semi"), "reifierShape", F.col("reifier")))
        return reduce(DataFrame.unionByName, out) if out else None

    def _sparql(self, shape: Shape, a, focus: DataFrame) -> DataFrame:
        """A SELECT constraint: translated once and joined with all focus nodes."""
        from .sparql import query

        text = a[0].replace("$PATH", text_of(shape.path) if shape.path is not None else "")
        rows = query(self.graph, text, dict(self.schema.prefixes))
        rows = rows.select(key_of(F.col("this")).alias("fk"), *(F.col(c) for c in rows.columns if c != "this"))
        if "failure" in rows.columns and not rows.where(F.col("failure.lex") == "true").isEmpty():
            raise ShaclError(f"the query of {shape.id} reports a failure")
        hit = rows.join(focus.select("fk"), "fk", "left_semi")
        value = F.col("value.lex") if "value" in rows.columns else F.col("fk")
        path = F.concat(F.lit("<"), F.col("path.lex"), F.lit(">")) if "path" in rows.columns else None
        return self._rows(shape, hit, "sparql", value, path, F.col("message.lex") if "message" in rows.columns else None)

    def validate(self, only: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
        """All violations. only: some shapes; nodes (node): focus nodes to look at, for revalidation."""
        parts = []
        for shape in self.schema.shapes.values():
            if only is not None and shape.id not in only:
                continue
            focus = self.focus_nodes(shape) if not shape.deactivated else None
            if focus is None:
                continue
            if nodes is not None:
                focus = focus.join(nodes.select(F.col("node").alias("fk")).distinct(), "fk", "left_semi")
            whole = shape.targets[0][1] if nodes is None and self.mode == "native" and len(shape.targets) == 1 and shape.targets[0][0] == "class" else None
            found = self.check(shape, focus, whole)
            if found is not None:
                parts.append(found)
        if not parts:
            return self.graph.spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
        return reduce(DataFrame.unionByName, parts)


def _key(t: Term) -> str:
    return t.lex if t.k != "literal" else f'"{t.lex}"^^{t.dt}@{t.lang}'


def _quoted(t: Column) -> Column:
    plain = F.concat(F.lit('"'), t["lex"], F.lit('"'))
    typed = F.when(t["lang"] != "", F.concat(plain, F.lit("@"), t["lang"])).when(t["dt"].endswith("#string"), plain).otherwise(F.concat(plain, F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["k"] == "iri", F.concat(F.lit("<"), t["lex"], F.lit(">"))).when(t["k"] == "literal", typed).otherwise(t["lex"])


def conforms(report: DataFrame) -> bool:
    """No result of any severity."""
    return report.isEmpty()


def by_severity(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count("*").alias("n"))


def sort_report(report: DataFrame, *keys: str) -> DataFrame:
    """Keys: Node, Severity, Shape, Component, Source, Path, Value, Details."""
    names = {"node": "focus", "severity": "severity", "shape": "source_shape", "source": "source_shape", "component": "component", "path": "path", "value": "value", "details": "message"}
    return report.orderBy(*(names[k.lower()] for k in keys or ("Node",)))


def report_triples(report: DataFrame) -> DataFrame:
    """The report as (s, p, o): a result node for each row, and the conforms flag."""
    from ..functions.terms import XSD, term
    from ..operators.graph import fresh_bnode

    node = fresh_bnode(*(F.coalesce(F.col(c), F.lit("\x00")) for c in COLUMNS))
    name = lambda c: resource(F.concat(F.lit(SH), c))
    text = lambda c: F.when(F.col(c).isNotNull(), term("literal", F.col(c), XSD + "string"))
    arcs = F.array(
        F.struct(F.lit(TYPE).alias("p"), resource(F.lit(SH + "ValidationResult")).alias("o")),
        F.struct(F.lit(SH + "focusNode").alias("p"), resource(F.col("focus")).alias("o")),
        F.struct(F.lit(SH + "resultSeverity").alias("p"), name(F.col("severity")).alias("o")),
        F.struct(F.lit(SH + "sourceConstraintComponent").alias("p"), name(F.concat(F.upper(F.substring("component", 1, 1)), F.substring("component", 2, 99), F.lit("ConstraintComponent"))).alias("o")),
        F.struct(F.lit(SH + "sourceShape").alias("p"), resource(F.col("source_shape")).alias("o")),
        F.struct(F.lit(SH + "resultPath").alias("p"), text("path").alias("o")),
        F.struct(F.lit(SH + "value").alias("p"), text("value").alias("o")),
        F.struct(F.lit(SH + "resultMessage").alias("p"), F.when(F.col("message") != "", text("message")).alias("o")),
    )
    rows = report.select(node.alias("s"), F.explode(arcs).alias("x")).select("s", "x.p", "x.o").where(F.col("o").isNotNull())
    root = report.agg((F.count("*") == 0).cast("string").alias("ok")).select(F.lit("_:report").alias("s"), F.lit(SH + "conforms").alias("p"), term("literal", F.col("ok"), XSD + "boolean").alias("o"))
    links = report.select(F.lit("_:report").alias("s"), F.lit(SH + "result").alias("p"), resource(node).alias("o")).distinct()
    return rows.unionByName(root).unionByName(links)


def read_report(graph: Graph) -> DataFrame:
    """The rows of a report given as triples."""
    about = {SH + n: c for n, c in (("focusNode", "focus"), ("sourceConstraintComponent", "component"), ("resultSeverity", "severity"), ("sourceShape", "source_shape"), ("resultPath", "path"), ("value", "value"), ("resultMessage", "message"))}
    arcs = graph.triples().where(F.col("p").isin(*about))
    local = F.regexp_replace(F.replace("component", F.lit(SH), F.lit("")), "ConstraintComponent$", "")
    wide = arcs.groupBy("s").agg(*(F.max(F.when(F.col("p") == name, F.col("o.lex"))).alias(c) for name, c in about.items()))
    rows = wide.where(F.col("focus").isNotNull()).withColumn("component", F.concat(F.lower(F.substring(local, 1, 1)), F.substring(local, 2, 99)))
    return rows.withColumns({"severity": F.replace("severity", F.lit(SH), F.lit("")), "message": F.coalesce("message", F.lit(""))}).select(*COLUMNS)


def with_messages(report: DataFrame, schema: Schema) -> DataFrame:
    """The report with `messages`: language -> text of the source shape's messages ("" has none); several of a language are joined."""
    known = []
    for s in schema.shapes.values():
        texts: dict[str, str] = {}
        for language, text in s.messages:
            texts[language] = f"{texts[language]} {text}" if language in texts else text
        known.append((s.id, texts))
    table = report.sparkSession.createDataFrame(known, "source_shape string, messages map<string,string>")
    # a row for each shape of the schema
    return report.join(F.broadcast(table), "source_shape", "left")


# shapes graphs
class _Index:
    def __init__(self, triples):
        self.by_s = defaultdict(lambda: defaultdict(list))
        self.all = list(triples)
        for s, p, o in self.all:
            self.by_s[s][p].append(o)

    def get(self, s: str, p: str) -> list[Term]:
        return self.by_s[s][SH + p] if s in self.by_s else []

    def one(self, s: str, p: str) -> Term | None:
        found = self.get(s, p)
        return found[0] if found else None

    def items(self, head: Term) -> list[Term]:
        out, at = [], head.lex
        while at != RDF + "nil":
            if not self.by_s[at][RDF + "first"]:
                raise ShaclError("a list is broken")
            out.append(self.by_s[at][RDF + "first"][0])
            at = self.by_s[at][RDF + "rest"][0].lex
        return out


def parse_path(ix: _Index, t: Term):
    if t.k == "iri":
        return Pred(t.lex)
    for name, make in (("inversePath", Inv), ("zeroOrMorePath", Star), ("oneOrMorePath", Plus), ("zeroOrOnePath", Opt)):
        if inner := ix.one(t.lex, name):
            return make(parse_path(ix, inner))
    if alternative := ix.one(t.lex, "alternativePath"):
        return Alt(tuple(parse_path(ix, x) for x in ix.items(alternative)))
    return Seq(tuple(parse_path(ix, x) for x in ix.items(t)))


def parse_schema(triples, prefixes: dict | None = None) -> Schema:
    """The shapes of a shapes graph, given as driver triples (s, p, Term). A worklist over shape candidates."""
    ix = _Index(triples)
    todo = set()
    for s, p, o in ix.all:
        if p == TYPE and o.lex in (SH + "NodeShape", SH + "PropertyShape", SH + "Shape"):
            todo.add(s)
        if p in (SH + "targetNode", SH + "targetClass", SH + "targetSubjectsOf", SH + "targetObjectsOf"):
            todo.add(s)
        if p in (SH + "node", SH + "property", SH + "not", SH + "qualifiedValueShape", SH + "reifierShape"):
            todo.add(o.lex)
        if p in (SH + "and", SH + "or", SH + "xone"):
            todo |= {x.lex for x in ix.items(o)}
    return Schema({s: _parse_shape(ix, s) for s in sorted(todo)}, prefixes or {})


def _parse_shape(ix: _Index, s: str) -> Shape:
    get, one = (lambda p: ix.get(s, p)), (lambda p: ix.one(s, p))
    targets = [("node", t) for t in get("targetNode")]
    for kind in ("class", "subjectsOf", "objectsOf"):
        for t in get("target" + kind[0].upper() + kind[1:]):
            if t.k != "iri":
                raise ShaclError(f"target{kind} must be an IRI")
            targets.append((kind, t.lex))
    types = {t.lex for t in ix.by_s[s][TYPE]}
    if RDFS + "Class" in types and types & {SH + "NodeShape", SH + "PropertyShape"}:
        targets.append(("implicit", s))
    out = []
    for name in ("class", "datatype", "equals", "disjoint", "lessThan", "lessThanOrEquals", "node", "property", "not"):
        out += [Constraint(name, (t.lex,)) for t in get(name)]
    for name in ("minCount", "maxCount", "minLength", "maxLength"):
        out += [Constraint(name, (int(t.lex),)) for t in get(name)]
    for name in ("minExclusive", "minInclusive", "maxExclusive", "maxInclusive", "hasValue"):
        out += [Constraint(name, (t,)) for t in get(name)]
    out += [Constraint("nodeKind", (t.lex.removeprefix(SH),)) for t in get("nodeKind")]
    flags = one("flags")
    out += [Constraint("pattern", (t.lex, flags.lex if flags else "")) for t in get("pattern")]
    out += [Constraint("languageIn", (tuple(x.lex for x in ix.items(t)),)) for t in get("languageIn")]
    out += [Constraint("in", (tuple(ix.items(t)),)) for t in get("in")]
    out += [Constraint(name, (tuple(x.lex for x in ix.items(t)),)) for name in ("and", "or", "xone") for t in get(name)]
    out += [Constraint("uniqueLang", (True,)) for t in get("uniqueLang") if t.lex in ("true", "1")]
    if (t := one("closed")) and t.lex in ("true", "1"):
        ignored = one("ignoredProperties")
        out.append(Constraint("closed", (tuple(x.lex for x in ix.items(ignored)) if ignored else (),)))
    for t in get("qualifiedValueShape"):
        low, high, apart = one("qualifiedMinCount"), one("qualifiedMaxCount"), one("qualifiedValueShapesDisjoint")
        siblings = ()
        if apart and apart.lex in ("true", "1"):
            parents = [p for p in list(ix.by_s) if any(x.lex == s for x in ix.get(p, "property"))]
            siblings = tuple(sorted({q.lex for p in parents for x in ix.get(p, "property") for q in ix.get(x.lex, "qualifiedValueShape")} - {t.lex}))
        out.append(Constraint("qualified", (t.lex, int(low.lex) if low else None, int(high.lex) if high else None, siblings)))
    reifier, required = one("reifierShape"), one("reificationRequired")
    if reifier or (required and required.lex in ("true", "1")):
        out.append(Constraint("reifier", (reifier.lex if reifier else None, bool(required and required.lex in ("true", "1")))))
    for t in get("sparql"):
        if select := ix.one(t.lex, "select"):
            out.append(Constraint("sparql", (select.lex,)))
    path, severity, off = one("path"), one("severity"), one("deactivated")
    messages = tuple((m.lang, m.lex) for m in get("message"))
    return Shape(s, parse_path(ix, path) if path else None, tuple(targets), tuple(out), severity.lex.removeprefix(SH) if severity else "Violation", messages, bool(off and off.lex in ("true", "1")))


def validate(graph: Graph, schema: Schema, mode: str = "native") -> DataFrame:
    return Validator(graph, schema, mode).validate()
