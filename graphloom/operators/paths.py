"""Property paths as (start, end) DataFrames, and closures.

start is a string (a resource), end a term. Each path is a set. Closures are semi-naive: only pairs
found in the last round are extended; each round is checkpointed to the shared folder, so plans stay
small and a lost executor doesn't start the loop anew. `seeds` limits a closure to given starts.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import key_of, resource
from .graph import Graph, spread


@dataclass(frozen=True)
class Pred:
    iri: str


@dataclass(frozen=True)
class Inv:
    path: object


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Star:
    path: object


@dataclass(frozen=True)
class Plus:
    path: object


@dataclass(frozen=True)
class Opt:
    path: object


@dataclass(frozen=True)
class NotIn:
    """Any predicate but these: negated property set."""

    forward: tuple = ()
    backward: tuple = ()


#: Rounds of a closure whose results are kept apart.
COMPACT = 12


class PathError(ValueError):
    pass


def shared_checkpoints(df: DataFrame) -> None:
    """Use the session's checkpoint folder; a temporary one only where none is set and driver and executors are one process."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="graphloom-"))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the session's checkpoint folder, which driver and executors share."""
    shared_checkpoints(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The pairs (start, end) of `start` extended along edges (start, end) until nothing is new.

    Each round writes what it has found; what is known is the union of these, put together once in COMPACT rounds.
    """
    shared_checkpoints(edges)
    edges = edges.select(F.col("start").alias("end"), F.col("end").alias("next")).distinct()
    front = start.select("start", "end").distinct().checkpoint()
    found = [front]
    while True:
        known = reduce(DataFrame.unionByName, found)
        step = front.join(edges, "end").select("start", F.col("next").alias("end")).distinct()
        front = step.join(known, ["start", "end"], "left_anti").checkpoint()
        if front.isEmpty():
            return known
        found = [known.unionByName(front).checkpoint()] if len(found) >= COMPACT else [*found, front]


def nodes_of(graph: Graph) -> DataFrame:
    """start: all subjects and all objects that are resources."""
    t = graph.triples()
    return t.select(F.col("s").alias("start")).union(t.where(F.col("o.k") != "literal").select("o.lex")).distinct()


def inverse(path):
    if isinstance(path, Pred):
        return Inv(path)
    if isinstance(path, Inv):
        return path.path
    if isinstance(path, Seq):
        return Seq(tuple(inverse(p) for p in reversed(path.parts)))
    if isinstance(path, Alt):
        return Alt(tuple(map(inverse, path.parts)))
    if isinstance(path, NotIn):
        return NotIn(path.backward, path.forward)
    return type(path)(inverse(path.path))


def pairs(graph: Graph, path, seeds: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The set of (start, end) of a path. strict: an inverse must hold a predicate, as in SHACL."""
    if isinstance(path, str):
        path = Pred(path)
    if isinstance(path, Pred):
        return _set(graph, graph.pattern(p=path.iri).select(F.col("s").alias("start"), F.col("o").alias("end")))
    if isinstance(path, Inv):
        if not isinstance(path.path, Pred):
            if strict:
                raise PathError("an inverse path must hold a predicate")
            return pairs(graph, inverse(path.path), seeds)
        t = graph.pattern(p=path.path.iri).where(F.col("o.k") != "literal")
        return _set(graph, t.select(F.col("o.lex").alias("start"), resource(F.col("s")).alias("end")))
    if isinstance(path, NotIn):
        parts = []
        if path.forward or not path.backward:
            parts.append(graph.triples().where(~F.col("p").isin(*path.forward)).select(F.col("s").alias("start"), F.col("o").alias("end")))
        if path.backward:
            t = graph.triples().where(~F.col("p").isin(*path.backward) & (F.col("o.k") != "literal"))
            parts.append(t.select(F.col("o.lex").alias("start"), resource(F.col("s")).alias("end")))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.distinct()
    if isinstance(path, Alt):
        # the whole is made a set once
        parts = [graph.bag(p.iri).select(F.col("s").alias("start"), F.col("o").alias("end")) if isinstance(p, Pred) else pairs(graph, p, seeds, strict) for p in path.parts]
        return spread(reduce(DataFrame.unionByName, parts), "start", "end").distinct()
    if isinstance(path, Seq):
        if not path.parts:
            return _identity(graph, seeds)
        out = pairs(graph, path.parts[0], seeds, strict)
        # a step with one value at most makes no rows, so what it may make equal is left until rows can multiply
        single, repeats = functional(graph, path.parts[0]), False
        for p in path.parts[1:]:
            right = pairs(graph, p, None, strict).select(F.col("start").alias("middle"), F.col("end").alias("far"))
            if not functional(graph, p):
                out, repeats = (out.distinct() if repeats else out), True
            elif not single:
                repeats = True
            single = single and functional(graph, p)
            out = out.where(F.col("end.k") != "literal").join(right, F.col("end.lex") == F.col("middle")).select("start", F.col("far").alias("end"))
        return out.distinct() if repeats else out
    if isinstance(path, Opt):
        return _identity(graph, seeds).unionByName(pairs(graph, path.path, seeds, strict)).distinct()
    if isinstance(path, (Star, Plus)):
        step = pairs(graph, path.path, None, strict)
        links = step.where(F.col("end.k") != "literal").select("start", F.col("end.lex").alias("end"))
        if isinstance(path, Star):
            begin = _identity(graph, seeds).select("start", F.col("end.lex").alias("end"))
            walked = reach(links, begin)
            ends = walked.select("start", resource(F.col("end")).alias("end"))
        else:
            begin = links if seeds is None else links.join(seeds.select("start").distinct(), "start", "left_semi")
            walked = reach(links, begin)
            ends = walked.select("start", resource(F.col("end")).alias("end"))
        # literals are met at the end of a walk only
        last = step.where(F.col("end.k") == "literal").select(F.col("start").alias("at"), F.col("end").alias("value"))
        stops = walked.select("start", F.col("end").alias("at")).join(last, "at").select("start", F.col("value").alias("end"))
        out = ends.unionByName(stops)
        if isinstance(path, Plus):
            direct = step.where(F.col("end.k") == "literal")
            out = out.unionByName(direct if seeds is None else direct.join(seeds.select("start").distinct(), "start", "left_semi"))
        return out.distinct()
    raise PathError(f"no such path: {path!r}")


def _set(graph: Graph, df: DataFrame) -> DataFrame:
    """Without duplicates; a graph whose patterns have none needs no shuffle for that."""
    return df if graph.sets else df.distinct()


def functional(graph: Graph, path) -> bool:
    """Whether a start is known to have one end at most."""
    if isinstance(path, Seq):
        return all(functional(graph, p) for p in path.parts)
    return isinstance(path, Pred) and graph.functional(path.iri)


def lists(graph: Graph, heads: DataFrame) -> DataFrame:
    """head, position, value of the RDF lists that begin at the nodes; a list that loops ends where it meets itself."""
    from ..functions.terms import RDF

    shared_checkpoints(heads)
    first = graph.pattern(p=RDF + "first").select(F.col("s").alias("at"), F.col("o").alias("value"))
    # the links are read in every round, so they are made once
    links = graph.pattern(p=RDF + "rest").where((F.col("o.k") != "literal") & (F.col("o.lex") != RDF + "nil"))
    rest = links.select(F.col("s").alias("at"), F.col("o.lex").alias("next")).checkpoint()
    # where no cell follows two others, the first cell that a walk meets again is its head
    joined = not rest.groupBy("next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    front = heads.select(F.col("node").alias("head"), F.col("node").alias("at")).distinct().checkpoint()
    seen, position = [], 0
    while not seen or not front.isEmpty():
        seen = [reduce(DataFrame.unionByName, seen).checkpoint()] if len(seen) >= COMPACT else seen
        seen.append(front.withColumn("position", F.lit(position)))
        step = front.join(rest, "at").select("head", F.col("next").alias("at"))
        front = (step.join(reduce(DataFrame.unionByName, seen), ["head", "at"], "left_anti") if joined else step.where(F.col("at") != F.col("head"))).checkpoint()
        position += 1
    return reduce(DataFrame.unionByName, seen).join(first, "at").select("head", "position", "value")


def _identity(graph: Graph, seeds: DataFrame | None) -> DataFrame:
    nodes = nodes_of(graph) if seeds is None else seeds.select("start").distinct()
    return nodes.select("start", resource(F.col("start")).alias("end"))


def text_of(path) -> str:
    """The path in SPARQL syntax."""
    if isinstance(path, str):
        return f"<{path}>"
    if isinstance(path, Pred):
        return f"<{path.iri}>"
    if isinstance(path, Inv):
        return f"^{text_of(path.path)}"
    if isinstance(path, Seq):
        return "(" + "/".join(map(text_of, path.parts)) + ")"
    if isinstance(path, Alt):
        return "(" + "|".join(map(text_of, path.parts)) + ")"
    if isinstance(path, NotIn):
        return "!(" + "|".join([*map("<{}>".format, path.forward), *map("^<{}>".format, path.backward)]) + ")"
    return text_of(path.path) + {Star: "*", Plus: "+", Opt: "?"}[type(path)]


def end_key(column: str = "end"):
    return key_of(F.col(column))
