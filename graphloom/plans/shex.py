"""ShEx: schemas as dataclasses and conformance as DataFrame plans.

Everything is evaluated for sets of nodes: `failing(expression, nodes)` gives the nodes that don't
conform. A shape counts, for each node, the triples that fit each of its constraints; whether the
counts fit the expression is interval arithmetic on Columns. Where triples may fit several constraints (one
predicate in several, or EXTENDS), the few candidates of a node go through an assignment search,
grouped by which constraints they fit. Recursive references are a greatest fixpoint: all pairs are
assumed to hold, failing ones are removed until nothing changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Term, constant, ill_typed, key_of, resource
from ..operators.graph import Graph, spread
from ..operators.paths import shared_checkpoints
from . import rbe

LANGUAGE_STEM, IRI_STEM, LITERAL_STEM = "lang", "iri", "literal"


class ShexError(ValueError):
    pass


@dataclass(frozen=True)
class NodeConstraint:
    kind: str | None = None  # iri, bnode, nonliteral, literal
    datatype: str | None = None
    facets: tuple = ()  # (name, value)
    values: tuple | None = None  # Term, or Stem


@dataclass(frozen=True)
class Stem:
    """Values that begin with a stem ('' is a wildcard), but for the exclusions (Terms, texts or Stems)."""

    kind: str
    stem: str
    exclusions: tuple = ()
    exact: bool = False  # a language tag itself


@dataclass(frozen=True)
class Ref:
    label: str


@dataclass(frozen=True)
class ShapeAnd:
    parts: tuple


@dataclass(frozen=True)
class ShapeOr:
    parts: tuple


@dataclass(frozen=True)
class ShapeNot:
    inner: object


@dataclass(frozen=True)
class External:
    pass


@dataclass(frozen=True)
class TripleConstraint:
    predicate: str
    value: object = None
    low: int = 1
    high: int | None = 1
    inverse: bool = False
    actions: tuple = ()


@dataclass(frozen=True)
class EachOf:
    parts: tuple
    low: int = 1
    high: int | None = 1


@dataclass(frozen=True)
class OneOf:
    parts: tuple
    low: int = 1
    high: int | None = 1


@dataclass(frozen=True)
class Include:
    label: str


@dataclass(frozen=True)
class ShapeDef:
    expr: object = None
    closed: bool = False
    extra: tuple = ()
    extends: tuple = ()


@dataclass
class Schema:
    shapes: dict = field(default_factory=dict)
    start: object = None
    abstract: set = field(default_factory=set)
    triple_exprs: dict = field(default_factory=dict)
    prefixes: dict = field(default_factory=dict)
    imports: list = field(default_factory=list)
    start_actions: tuple = ()

    def references(self) -> dict[str, set[tuple[str, bool]]]:
        """label -> labels that it refers to, and whether under a NOT or EXTRA."""
        out = {}

        def walk(e, neg: bool, acc: set):
            if isinstance(e, Ref):
                acc.add((e.label, neg))
            elif isinstance(e, (ShapeAnd, ShapeOr, EachOf, OneOf)):
                for p in e.parts:
                    walk(p, neg, acc)
            elif isinstance(e, ShapeNot):
                walk(e.inner, not neg, acc)
            elif isinstance(e, ShapeDef):
                acc.update((x, neg) for x in e.extends)
                walk(e.expr, neg, acc)
            elif isinstance(e, TripleConstraint):
                walk(e.value, neg, acc)
            elif isinstance(e, Include):
                walk(self.triple_exprs.get(e.label), neg, acc)

        for label, e in self.shapes.items():
            out[label] = set()
            walk(e, False, out[label])
        return out

    def components(self) -> dict[str, frozenset]:
        """label -> the labels of its strongly connected component (Tarjan)."""
        refs = {k: {x for x, _ in v if x in self.shapes} for k, v in self.references().items()}
        index, low, stack, on, out = {}, {}, [], set(), {}

        def visit(v):
            index[v] = low[v] = len(index)
            stack.append(v)
            on.add(v)
            for w in refs[v]:
                if w not in index:
                    visit(w)
                    low[v] = min(low[v], low[w])
                elif w in on:
                    low[v] = min(low[v], index[w])
            if low[v] == index[v]:
                group = set()
                while True:
                    w = stack.pop()
                    on.discard(w)
                    group.add(w)
                    if w == v:
                        break
                for w in group:
                    out[w] = frozenset(group)

        for v in refs:
            if v not in index:
                visit(v)
        return out

    def check(self) -> None:
        """References and included expressions exist, no expression includes itself, and no cycle goes through a negation."""
        for label in self.triple_exprs:
            self._included(label, ())
        for e in self.shapes.values():
            for label in _includes(e):
                self._included(label, ())
        refs, groups = self.references(), self.components()
        for label, found in refs.items():
            for other, negative in found:
                if other not in self.shapes:
                    raise ShexError(f"no shape {other}")
                if negative and other in groups[label]:
                    raise ShexError(f"a negation lies on the cycle of {label}")

    def _included(self, label: str, above: tuple) -> None:
        if label in above:
            raise ShexError(f"the expression {label} includes itself")
        if label not in self.triple_exprs:
            raise ShexError(f"no expression {label}")
        for other in _includes(self.triple_exprs[label]):
            self._included(other, (*above, label))

    def recursive(self, label: str) -> bool:
        return len(self.components()[label]) > 1 or any(x == label for x, _ in self.references()[label])

    def descendants(self, label: str) -> list[str]:
        def base(e) -> ShapeDef | None:
            return e if isinstance(e, ShapeDef) else next((b for p in e.parts if (b := base(p))), None) if isinstance(e, ShapeAnd) else None

        direct = [k for k, e in self.shapes.items() if (b := base(e)) is not None and label in b.extends]
        return list(dict.fromkeys([*direct, *(d for k in direct for d in self.descendants(k))]))


def _includes(e) -> list[str]:
    """The labels that an expression includes itself, without following them or its references."""
    if isinstance(e, Include):
        return [e.label]
    if isinstance(e, (ShapeAnd, ShapeOr, EachOf, OneOf)):
        return [x for p in e.parts for x in _includes(p)]
    return _includes(e.inner) if isinstance(e, ShapeNot) else _includes(e.expr) if isinstance(e, ShapeDef) else _includes(e.value) if isinstance(e, TripleConstraint) else []


# conditions on a value alone
def value_condition(e, v: Column) -> Column | None:
    """The Column of an expression that looks at the value alone; None if it needs its neighbours."""
    if e is None:
        return F.lit(True)
    if isinstance(e, NodeConstraint):
        tests = []
        if e.kind:
            tests.append(v["k"].isin(*{"iri": ["iri"], "bnode": ["bnode"], "literal": ["literal"], "nonliteral": ["iri", "bnode"]}[e.kind]))
        if e.datatype:
            tests.append((v["k"] == "literal") & (v["dt"] == e.datatype) & ~ill_typed(v))
        tests += [_facet(n, x, v) for n, x in e.facets]
        if e.values is not None:
            tests.append(reduce(lambda a, b: a | b, [_in_value_set(x, v) for x in e.values], F.lit(False)))
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))
    if isinstance(e, (ShapeAnd, ShapeOr)):
        parts = [value_condition(p, v) for p in e.parts]
        if any(p is None for p in parts):
            return None
        return reduce((lambda a, b: a & b) if isinstance(e, ShapeAnd) else (lambda a, b: a | b), parts)
    if isinstance(e, ShapeNot):
        inner = value_condition(e.inner, v)
        return None if inner is None else ~inner
    if isinstance(e, ShapeDef) and e.expr is None and not e.closed and not e.extends:
        return F.lit(True)
    return None


def _facet(name: str, x, v: Column) -> Column:
    n = F.octet_length(v["lex"])
    if name in ("length", "minlength", "maxlength"):
        return {"length": n == x, "minlength": n >= x, "maxlength": n <= x}[name]
    if name == "pattern":
        from ..functions.terms import regex

        return v["lex"].rlike(regex(*x))
    if name in ("mininclusive", "minexclusive", "maxinclusive", "maxexclusive"):
        return {"mininclusive": v["num"] >= x, "minexclusive": v["num"] > x, "maxinclusive": v["num"] <= x, "maxexclusive": v["num"] < x}[name]
    exact = v["lex"].rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$") & ~v["dt"].endswith("#double") & ~v["dt"].endswith("#float")
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(v["lex"], r"^[+-]", ""), r"\..*$", ""), r"^0+(?=[0-9])", "")
    part = F.regexp_replace(F.regexp_replace(v["lex"], r"^[^.]*\.?", ""), r"0+$", "")
    if name == "totaldigits":
        return exact & (F.greatest(F.length(whole), F.lit(1)) + F.length(part) <= x)
    if name == "fractiondigits":
        return exact & (F.length(part) <= x)
    raise ShexError(f"no such facet: {name}")


def _in_value_set(x, v: Column) -> Column:
    if isinstance(x, Term):
        return (v["k"] == x.k) & (v["lex"] == x.lex) & ((v["dt"] == x.dt) & (v["lang"] == x.lang) if x.k == "literal" else F.lit(True))
    if x.stem == "":
        fits = F.lit(True)
    elif x.kind == LANGUAGE_STEM:
        tag = F.lower(v["lang"])
        fits = (tag == x.stem.lower()) if x.exact else (tag == x.stem.lower()) | tag.startswith(x.stem.lower() + "-")
    else:
        fits = v["lex"].startswith(x.stem) & (v["k"] == ("iri" if x.kind == IRI_STEM else "literal"))
    for out in x.exclusions:
        if isinstance(out, str):
            out = Stem(x.kind, out, exact=True) if x.kind == LANGUAGE_STEM else None
        fits = fits & ~_in_value_set(out, v)
    return fits


# validation
class Validator:
    def __init__(self, graph: Graph, schema: Schema, externals=None):
        """externals: functions (label, nodes) -> DataFrame of failing fk, or None to abstain; without an answer all fail."""
        schema.check()
        self.graph, self.schema, self.externals = graph, schema, list(externals or [])
        self.assumed: dict[str, DataFrame] = {}

    def failing(self, e, nodes: DataFrame, label: str | None = None) -> DataFrame:
        """fk of the nodes (fk, focus) that don't conform."""
        if isinstance(e, Ref):
            return self.failing_label(e.label, nodes)
        plain = value_condition(e, F.col("focus"))
        if plain is not None:
            return nodes.where(~plain).select("fk")
        if isinstance(e, ShapeAnd):
            return reduce(DataFrame.unionByName, [self.failing(p, nodes, label) for p in e.parts]).distinct()
        if isinstance(e, ShapeOr):
            out = self.failing(e.parts[0], nodes, label)
            for p in e.parts[1:]:
                out = out.join(self.failing(p, nodes, label), "fk", "left_semi")
            return out
        if isinstance(e, ShapeNot):
            return nodes.select("fk").join(self.failing(e.inner, nodes, label), "fk", "left_anti")
        if isinstance(e, External):
            for resolve in self.externals:
                found = resolve(label, nodes)
                if found is not None:
                    return found
            return nodes.select("fk")
        return self.shape_failing(e, nodes)

    def failing_label(self, label: str, nodes: DataFrame) -> DataFrame:
        if label in self.assumed:
            return nodes.select("fk").join(self.assumed[label], "fk", "left_semi")
        out = None
        # a node conforms if it conforms to the shape, unless that is abstract, or to one that extends it
        for k in [label, *self.schema.descendants(label)]:
            if k in self.schema.abstract:
                continue
            own = self._own_label(k, nodes)
            out = own if out is None else out.join(own, "fk", "left_semi")
        return nodes.select("fk") if out is None else out

    def _own_label(self, label: str, nodes: DataFrame) -> DataFrame:
        if label in self.assumed:
            return nodes.select("fk").join(self.assumed[label], "fk", "left_semi")
        if self.schema.recursive(label):
            return nodes.select("fk").join(self._fixpoint(label, nodes)[label], "fk", "left_semi")
        return self.failing(self.schema.shapes[label], nodes, label)

    def _refs(self, e, out: list) -> list:
        """(predicate, inverse, label) of the references of an expression; None for those on the node itself."""
        if isinstance(e, Ref):
            out.append((None, False, e.label))
        elif isinstance(e, (ShapeAnd, ShapeOr, EachOf, OneOf)):
            for p in e.parts:
                self._refs(p, out)
        elif isinstance(e, ShapeNot):
            self._refs(e.inner, out)
        elif isinstance(e, ShapeDef):
            out += [(None, False, x) for x in e.extends]
            self._refs(e.expr, out)
        elif isinstance(e, TripleConstraint) and e.value is not None:
            inner: list = []
            self._refs(e.value, inner)
            out += [(e.predicate, e.inverse, x) for p, _, x in inner if p is None]
        elif isinstance(e, Include):
            self._refs(self.schema.triple_exprs[e.label], out)
        return out

    def _fixpoint(self, label: str, nodes: DataFrame) -> dict[str, DataFrame]:
        """The failing nodes of each label of a cycle, over all nodes that are asked for along its references."""
        group = self.schema.components()[label]
        shared_checkpoints(nodes)
        asked = {k: None for k in group}
        asked[label] = nodes.select("fk", "focus").dropDuplicates(["fk"]).checkpoint()
        front = {label: asked[label]}
        while front:
            nxt: dict[str, list] = {}
            for k, df in front.items():
                for p, inverse, to in self._refs(self.schema.shapes[k], []):
                    if to in group:
                        nxt.setdefault(to, []).append(df if p is None else self._values(df, p, inverse).select(key_of(F.col("value")).alias("fk"), F.col("value").alias("focus")))
            front = {}
            for to, parts in nxt.items():
                new = reduce(DataFrame.unionByName, parts).dropDuplicates(["fk"])
                if asked[to] is not None:
                    new = new.join(asked[to].select("fk"), "fk", "left_anti")
                new = new.checkpoint()
                if not new.isEmpty():
                    asked[to] = new if asked[to] is None else asked[to].unionByName(new).checkpoint()
                    front[to] = new
        live = {k: v for k, v in asked.items() if v is not None}
        refs = {k: [r for r in dict.fromkeys(self._refs(self.schema.shapes[k], [])) if r[2] in group] for k in live}
        empty = nodes.select("fk").limit(0)
        known, outer = {k: empty for k in group}, self.assumed
        try:
            self.assumed = {**outer, **known}
            fresh = {k: self.failing(self.schema.shapes[k], df, k).distinct().checkpoint() for k, df in live.items()}
            while fresh := {k: v for k, v in fresh.items() if not v.isEmpty()}:
                for k, v in fresh.items():
                    known[k] = v if known[k] is empty else known[k].unionByName(v).checkpoint()
                self.assumed = {**outer, **known}
                # failing nodes only grow: those are looked at again that refer to one that has just failed
                again = {k: x for k in live if (x := self._referring(live[k], refs[k], fresh)) is not None}
                fresh = {k: self.failing(self.schema.shapes[k], x.join(known[k], "fk", "left_anti"), k).distinct().checkpoint() for k, x in again.items()}
            return known
        finally:
            self.assumed = outer

    def _referring(self, nodes: DataFrame, refs: list, fresh: dict[str, DataFrame]) -> DataFrame | None:
        """The nodes (fk, focus) that refer to a fresh one; None if no reference can."""
        parts = []
        for p, inverse, to in refs:
            if to in fresh and p is None:
                parts.append(nodes.select("fk").join(fresh[to], "fk", "left_semi"))
            elif to in fresh:
                values = self._values(nodes, p, inverse).select("fk", key_of(F.col("value")).alias("vk"))
                parts.append(values.join(fresh[to].withColumnRenamed("fk", "vk"), "vk", "left_semi").select("fk"))
        return nodes.join(reduce(DataFrame.unionByName, parts).distinct(), "fk", "left_semi") if parts else None

    # shapes
    def _values(self, nodes: DataFrame, predicate: str, inverse: bool) -> DataFrame:
        """fk, value, tid: the triples of a predicate at the nodes."""
        if inverse:
            t = self.graph.pattern(p=predicate).select(key_of(F.col("o")).alias("at"), resource(F.col("s")).alias("value"))
        else:
            t = self.graph.pattern(p=predicate).select(F.col("s").alias("at"), F.col("o").alias("value"))
        return nodes.select("fk").join(t, F.col("fk") == F.col("at")).select("fk", "value")

    def _flatten(self, e, leaves: list):
        """The expression over numbered leaves."""
        if e is None:
            return rbe.Empty()
        if isinstance(e, Include):
            return self._flatten(self.schema.triple_exprs[e.label], leaves)
        if isinstance(e, TripleConstraint):
            leaves.append(e)
            return rbe.Sym(len(leaves) - 1, e.low, e.high)
        parts = tuple(self._flatten(p, leaves) for p in e.parts)
        inner = rbe.And(parts) if isinstance(e, EachOf) else rbe.Or(parts)
        return inner if (e.low, e.high) == (1, 1) else rbe.Rep(inner, e.low, e.high)

    def _base(self, label: str) -> ShapeDef:
        e = self.schema.shapes[label]
        if isinstance(e, ShapeAnd):
            e = next((p for p in e.parts if isinstance(p, ShapeDef)), None)
        if not isinstance(e, ShapeDef):
            raise ShexError(f"{label} can't be extended")
        return e

    def _extended(self, shape: ShapeDef, leaves: list, seen: tuple = ()):
        """Own expression and those of all ancestors: each triple belongs to one of them."""
        parts = [self._flatten(shape.expr, leaves)]
        for label in shape.extends:
            if label in seen:
                raise ShexError(f"{label} extends itself")
            parts.append(self._extended(self._base(label), leaves, (*seen, label)))
        return parts[0] if len(parts) == 1 else rbe.And(tuple(parts))

    def _extra_of(self, shape: ShapeDef) -> set:
        return set(shape.extra).union(*(self._extra_of(self._base(x)) for x in shape.extends))

    def shape_failing(self, shape: ShapeDef, nodes: DataFrame) -> DataFrame:
        leaves: list[TripleConstraint] = []
        expr = self._extended(shape, leaves)
        # conditions beside the triple expression that ancestors have
        beside = [p for x in shape.extends if isinstance(self.schema.shapes[x], ShapeAnd) for p in self.schema.shapes[x].parts if not isinstance(p, ShapeDef)]
        extra = self._extra_of(shape)
        by_key: dict[tuple, list[int]] = {}
        for i, leaf in enumerate(leaves):
            by_key.setdefault((leaf.predicate, leaf.inverse), []).append(i)
        shared = any(len(x) > 1 for x in by_key.values())
        parts = []
        for (predicate, inverse), own in by_key.items():
            values = self._values(nodes, predicate, inverse)
            plain = {i: value_condition(leaves[i].value, F.col("value")) for i in own}
            far = [i for i in own if plain[i] is None]
            mask = reduce(lambda a, b: a + b, [F.lit(1 << i) if i in far else F.when(plain[i], F.lit(1 << i)).otherwise(0) for i in own]).cast("bigint")
            if far:
                # one join by the values' keys takes away what they fail, and nothing else of them goes along
                targets = values.select(key_of(F.col("value")).alias("fk"), F.col("value").alias("focus")).dropDuplicates(["fk"])
                bad = [self.failing(leaves[i].value, targets).select(F.col("fk").alias("vk"), F.lit(1 << i).cast("bigint").alias("bit")) for i in far]
                deal = (lambda df: df) if self.assumed else (lambda df: spread(df, "vk"))
                bits = deal(reduce(DataFrame.unionByName, bad)).groupBy("vk").agg(F.bit_or("bit").alias("bits"))
                keyed = deal(values.select("fk", key_of(F.col("value")).alias("vk"), mask.alias("mask")))
                rows = keyed.join(bits, "vk", "left").select("fk", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("bigint")))).alias("mask"))
            else:
                rows = values.select("fk", mask.alias("mask"))
            # what fits nothing is left out under EXTRA, and spoils the node otherwise
            parts.append(rows.where("mask <> 0") if predicate in extra and not inverse else rows)
        out = []
        if parts:
            rows = reduce(DataFrame.unionByName, parts)
            if shared:
                held = rows.groupBy("fk", "mask").agg(F.count("*").alias("n")).groupBy("fk").agg(F.collect_list(F.struct("mask", "n")).alias("groups"))
                good = held.where(_assignable(expr)(F.col("groups"))).select("fk")
                if rbe.nullable(expr):
                    # nodes without triples are fine
                    out.append(held.where(~_assignable(expr)(F.col("groups"))).select("fk"))
                else:
                    out.append(nodes.select("fk").join(good, "fk", "left_anti"))
            else:
                counted = rows.groupBy("fk").agg(*(F.count_if(F.col("mask") == (1 << i)).alias(f"w{i}") for i in range(len(leaves))), F.count_if(F.col("mask") == 0).alias("other"))
                joined = nodes.select("fk").join(counted, "fk", "left")
                fits = rbe.interval_column(expr, lambda i: F.coalesce(F.col(f"w{i}"), F.lit(0)))
                out.append(joined.where(~(fits & (F.coalesce("other", F.lit(0)) == 0))).select("fk"))
        elif not rbe.nullable(expr):
            out.append(nodes.select("fk"))
        if shape.closed:
            allowed = {p for p, inverse in by_key if not inverse} | extra
            strange = self.graph.triples().where(~F.col("p").isin(*allowed)) if allowed else self.graph.triples()
            out.append(nodes.select("fk").join(strange.select(F.col("s").alias("fk")), "fk", "left_semi"))
        out += [self.failing(p, nodes) for p in beside]
        return reduce(DataFrame.unionByName, out).distinct() if out else nodes.select("fk").limit(0)

    def explain(self, label: str, nodes: DataFrame) -> DataFrame:
        """node, predicate, inverse, least, most, values, fitting: what each constraint of a shape finds at the nodes (node: a term)."""
        own = nodes.select(key_of(F.col("node")).alias("fk"), F.col("node").alias("focus")).dropDuplicates(["fk"])
        leaves: list[TripleConstraint] = []
        self._extended(self._base(label), leaves)
        parts = []
        for leaf in leaves:
            values = self._values(own, leaf.predicate, leaf.inverse)
            fits = value_condition(leaf.value, F.col("value"))
            if fits is None:
                targets = values.select(key_of(F.col("value")).alias("fk"), F.col("value").alias("focus")).dropDuplicates(["fk"])
                bad = self.failing(leaf.value, targets).distinct().select(F.col("fk").alias("bk"), F.lit(True).alias("bad"))
                values, fits = values.join(bad, key_of(F.col("value")) == F.col("bk"), "left"), F.col("bad").isNull()
            counted = values.groupBy("fk").agg(F.count(F.lit(1)).alias("values"), F.count_if(fits).alias("fitting"))
            of = (F.lit(leaf.predicate).alias("predicate"), F.lit(leaf.inverse).alias("inverse"), F.lit(leaf.low).alias("least"), F.lit(leaf.high).cast("int").alias("most"))
            parts.append(own.join(counted, "fk", "left").select(F.col("focus.lex").alias("node"), *of, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("values", "fitting"))))
        return reduce(DataFrame.unionByName, parts)

    def validate(self, shapemap: DataFrame) -> DataFrame:
        """shapemap: node (a term), shape (a label or START). node, shape, status, reason of each pair."""
        parts = []
        for label in sorted(r["shape"] for r in shapemap.select("shape").distinct().collect()):
            own = shapemap.where(F.col("shape") == label).select(key_of(F.col("node")).alias("fk"), F.col("node").alias("focus"))
            start = self.schema.start.label if label == "START" and isinstance(self.schema.start, Ref) else label
            # dealt before they become a set: what is joined with the nodes by key goes to as many tasks; a fixpoint has many small rounds, that few tasks do sooner
            own = (own if start in self.schema.shapes and self.schema.recursive(start) else spread(own, "fk")).dropDuplicates(["fk"])
            if label == "START":
                if self.schema.start is None:
                    raise ShexError("the schema has no start")
                bad = self.failing(self.schema.start, own)
            else:
                if label not in self.schema.shapes:
                    raise ShexError(f"no shape {label}")
                bad = self.failing_label(label, own)
            marked = own.join(bad.distinct().withColumn("bad", F.lit(True)), "fk", "left")
            status = F.when(F.col("bad"), "nonconformant").otherwise("conformant")
            reason = F.when(F.col("bad"), F.lit(f"doesn't conform to {label}")).otherwise(F.lit(f"conforms to {label}"))
            parts.append(marked.select(F.col("focus.lex").alias("node"), F.lit(label).alias("shape"), status.alias("status"), reason.alias("reason")))
        return reduce(DataFrame.unionByName, parts) if parts else self.graph.spark.createDataFrame([], "node string, shape string, status string, reason string")


def conjunction(expr) -> dict[int, tuple[int, int | None]] | None:
    """The bounds of each leaf where the expression is a conjunction of leaves; None otherwise."""
    if isinstance(expr, rbe.Empty):
        return {}
    if isinstance(expr, rbe.Sym):
        return {expr.name: (expr.low, expr.high)}
    if isinstance(expr, rbe.And):
        out: dict = {}
        for p in expr.parts:
            inner = conjunction(p)
            if inner is None or out.keys() & inner.keys():
                return None
            out |= inner
        return out
    return None


def dealt(bounds: dict[int, tuple[int, int | None]], groups: list[tuple[int, int]]) -> bool:
    """Whether all triples can be dealt to leaves within their bounds: a flow, whose cost doesn't grow with the counts.

    First each leaf's least number is filled, then the rest of the triples; a triple may be moved on to make room.
    """
    total = sum(n for _, n in groups)
    roomy = {leaf: total if high is None else min(high, total) for leaf, (_, high) in bounds.items()}
    flow: dict[tuple[int, int], int] = {}
    left = [n for _, n in groups]
    held = dict.fromkeys(bounds, 0)

    def push(need: dict[int, int]) -> bool:
        """One more path from a group with triples left to a leaf that needs some."""
        queue = [("g", g) for g, n in enumerate(left) if n]
        back: dict = dict.fromkeys(queue)
        while queue:
            kind, x = at = queue.pop(0)
            if kind == "g":
                nxt = [("l", leaf) for leaf in bounds if groups[x][0] >> leaf & 1]
            elif held[x] < need[x]:
                path = []
                while at is not None:
                    path.append(at)
                    at = back[at]
                path.reverse()
                most = min([left[path[0][1]], need[x] - held[x], *(flow[path[k + 1][1], path[k][1]] for k in range(1, len(path) - 1, 2))])
                for k in range(0, len(path) - 1, 2):
                    g, leaf = path[k][1], path[k + 1][1]
                    flow[g, leaf] = flow.get((g, leaf), 0) + most
                    if k + 2 < len(path):
                        flow[path[k + 2][1], leaf] -= most
                left[path[0][1]] -= most
                held[x] += most
                return True
            else:
                nxt = [("g", g) for g in range(len(groups)) if flow.get((g, x), 0)]
            for y in nxt:
                if y not in back:
                    back[y] = at
                    queue.append(y)
        return False

    least = {leaf: low for leaf, (low, _) in bounds.items()}
    while push(least):
        pass
    if any(held[leaf] < low for leaf, low in least.items()):
        return False
    while any(left) and push(roomy):
        pass
    return not any(left)


def assign(expr, groups: list[tuple[int, int]]) -> bool:
    """Whether triples, counted by the set of leaves (a bit mask) that they fit, can be dealt to leaves so that the expression matches."""
    if any(mask == 0 and n for mask, n in groups):
        return False
    bounds = conjunction(expr)
    if bounds is not None:
        return dealt(bounds, groups)
    fixed: dict[int, int] = {}
    free = []
    for mask, n in groups:
        own = [i for i in range(mask.bit_length()) if mask >> i & 1]
        if len(own) == 1:
            fixed[own[0]] = fixed.get(own[0], 0) + n
        else:
            free.append((own, n))

    def deal(k: int, bag: dict) -> bool:
        if k == len(free):
            return rbe.interval_matches(expr, bag)
        own, n = free[k]

        def split(i: int, left: int, now: dict) -> bool:
            if i == len(own) - 1:
                return deal(k + 1, {**now, own[i]: now.get(own[i], 0) + left})
            return any(split(i + 1, left - take, {**now, own[i]: now.get(own[i], 0) + take}) for take in range(left, -1, -1))

        return split(0, n, bag)

    return deal(0, fixed)


def _assignable(expr):
    @F.pandas_udf("boolean")
    def fits(groups: pd.Series) -> pd.Series:
        return pd.Series([assign(expr, [(int(g["mask"]), int(g["n"])) for g in row]) for row in groups])

    return fits


def map_actions(graph: Graph, schema: Schema, nodes: DataFrame, label: str) -> DataFrame:
    """focus, key, value of the Map actions %Map:{ key %} of a shape's constraints, for the nodes that conform."""
    validator = Validator(graph, schema)
    own = nodes.select(key_of(F.col("node")).alias("fk"), F.col("node").alias("focus")).dropDuplicates(["fk"])
    good = own.join(validator.failing_label(label, own), "fk", "left_anti")
    leaves: list[TripleConstraint] = []
    validator._extended(validator._base(label), leaves)
    parts = []
    for leaf in leaves:
        for name, code in leaf.actions:
            if name.endswith("/Map/#") or name.lower().endswith("map"):
                parts.append(validator._values(good, leaf.predicate, leaf.inverse).select(F.col("fk").alias("focus"), F.lit(code.strip()).alias("key"), F.col("value")))
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], "focus string, key string, value struct<k:string,lex:string,dt:string,lang:string,num:double,ts:timestamp>")


def materialize(schema: Schema, label: str, state: DataFrame) -> DataFrame:
    """s, p, o: the shape's constraints with Map actions, filled from a state (focus, key, value)."""
    leaves: list[TripleConstraint] = []
    e = schema.shapes[label]
    stack = [e.expr if isinstance(e, ShapeDef) else e]
    while stack:
        x = stack.pop()
        if isinstance(x, TripleConstraint):
            leaves.append(x)
        elif isinstance(x, (EachOf, OneOf)):
            stack += list(x.parts)
    keys = [(leaf.predicate, code.strip()) for leaf in leaves for _, code in leaf.actions]
    table = state.sparkSession.createDataFrame(keys, "p string, key string")
    return state.join(F.broadcast(table), "key").select(F.col("focus").alias("s"), "p", F.col("value").alias("o")).distinct()


def shape_map(graph: Graph, rows: list[tuple]) -> DataFrame:
    """node, shape from (selector, shape): a Term, ('focus', p, object or None), ('object', subject or None, p), or ('sparql', text)."""
    from .sparql import query

    parts = []
    for selector, shape in rows:
        if isinstance(selector, Term):
            df = graph.spark.range(1).select(constant(selector).alias("node"))
        elif selector[0] == "focus":
            found = graph.pattern(p=selector[1], o=selector[2]).select("s")
            # the subjects of a set of triples with one predicate and one object are a set
            df = (found if graph.sets and selector[2] is not None else found.distinct()).select(resource(F.col("s")).alias("node"))
        elif selector[0] == "object":
            df = graph.pattern(s=selector[1], p=selector[2]).select(F.col("o").alias("node")).distinct()
        else:
            found = query(graph, selector[1])
            df = found.select(F.col(f"`{found.columns[0]}`").alias("node")).distinct()
        parts.append(df.withColumn("shape", F.lit(shape)))
    return reduce(DataFrame.unionByName, parts)


def write_results(results: DataFrame, path: str, kind: str = "csv", sort: str | None = None) -> None:
    """A result shape map (node, shape, status, details) as CSV with a header or JSON lines; sort: a column."""
    named = results.withColumnRenamed("reason", "details")
    named = named.orderBy(sort) if sort else named
    if kind not in ("json", "csv"):
        raise ShexError(f"no such sink: {kind}")
    (named.write.json(path) if kind == "json" else named.write.option("header", True).csv(path))
