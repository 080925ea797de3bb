"""Streams of triples: each micro-batch revalidates the focus nodes that it can change.

A focus node's results depend on the arcs that its shapes walk: those of their paths, of the shapes that they
refer to, of class tests and of targets. For each arc of the schema, the triples of a batch are taken back along the
path that leads to it (`affected`), so a change some steps away is seen, and nothing else is looked at.
All foci that were looked at are given beside the violations: theirs replace the old ones, and a focus without
any has become conforming.

Batches are written to partitions named by their number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import SUBCLASS, TYPE
from ..operators.graph import FrameGraph, Graph
from ..operators.paths import Alt, Inv, NotIn, Opt, Plus, Pred, Seq, Star, inverse, pairs
from ..plans import shacl

#: (path to where it starts, predicate or None for any, whether it is walked from its subject)
Arc = tuple[tuple, str | None, bool]


class Everything(Exception):
    """What a schema looks at isn't known: all foci count as affected."""


def _path_arcs(path, before: tuple) -> Iterator[Arc]:
    if isinstance(path, str):
        path = Pred(path)
    if isinstance(path, Pred):
        yield before, path.iri, True
    elif isinstance(path, Inv) and isinstance(path.path, Pred):
        yield before, path.path.iri, False
    elif isinstance(path, Inv):
        yield from _path_arcs(inverse(path.path), before)
    elif isinstance(path, Seq):
        for k, p in enumerate(path.parts):
            yield from _path_arcs(p, (*before, *path.parts[:k]))
    elif isinstance(path, Alt):
        for p in path.parts:
            yield from _path_arcs(p, before)
    elif isinstance(path, Opt):
        yield from _path_arcs(path.path, before)
    elif isinstance(path, (Star, Plus)):
        yield from _path_arcs(path.path, (*before, Star(path.path)))
    elif isinstance(path, NotIn):
        if path.forward or not path.backward:
            yield before, None, True
        if path.backward:
            yield before, None, False


def arcs_of(schema: shacl.Schema, shape: shacl.Shape, mode: str, before: tuple = (), stack: tuple = ()) -> Iterator[Arc]:
    """What evaluating a shape looks at, from its focus node on."""
    if shape.id in stack:
        raise Everything
    stack = (*stack, shape.id)
    if not before:
        for kind, value in shape.targets:
            if kind in ("subjectsOf", "objectsOf"):
                yield (), value, kind == "subjectsOf"
            elif kind in ("class", "implicit"):
                yield from _class_arcs((), kind == "implicit" or mode != "native")
    at = before
    if shape.path is not None:
        yield from _path_arcs(shape.path, before)
        at = (*before, Pred(shape.path) if isinstance(shape.path, str) else shape.path)
    for c in shape.constraints:
        if c.name == "class":
            yield from _class_arcs(at, True)
        elif c.name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            yield before, c.args[0], True
        elif c.name == "closed":
            yield at, None, True
        elif c.name in ("sparql", "reifier"):
            raise Everything
        elif c.name in ("and", "or", "xone"):
            for other in c.args[0]:
                yield from arcs_of(schema, schema.shapes[other], mode, at, stack)
        elif c.name in ("node", "property", "not", "qualified"):
            for other in (c.args[0], *(c.args[3] if c.name == "qualified" else ())):
                yield from arcs_of(schema, schema.shapes[other], mode, at, stack)


def _class_arcs(at: tuple, subclasses: bool) -> Iterator[Arc]:
    yield at, TYPE, True
    if subclasses:
        yield (*at, Pred(TYPE), Star(Pred(SUBCLASS))), SUBCLASS, True


def affected(graph: Graph, batch: DataFrame, schema: shacl.Schema, mode: str = "native") -> DataFrame | None:
    """node: the nodes whose results the batch's triples can change, graph being the one with the batch. None: all."""
    try:
        arcs = {a for s in schema.shapes.values() if s.targets and not s.deactivated for a in arcs_of(schema, s, mode)}
    except Everything:
        return None
    parts = []
    for before in sorted({b for b, _, _ in arcs}, key=str):
        ends = []
        for p, forward in sorted({(p, f) for b, p, f in arcs if b == before}, key=str):
            own = batch if p is None else batch.where(F.col("p") == p)
            ends.append(own.select(F.col("s").alias("start")) if forward else own.where(F.col("o.k") != "literal").select(F.col("o.lex").alias("start")))
        seeds = reduce(DataFrame.union, ends).distinct()
        if before:
            back = pairs(graph, inverse(Seq(before)), seeds)
            seeds = back.join(seeds, "start", "left_semi").select(F.col("end.lex").alias("start"))
        parts.append(seeds)
    # the literals and IRIs that are targets by themselves
    parts.append(batch.where(F.col("o.k") == "literal").select(shacl.key_of(F.col("o")).alias("start")))
    return reduce(DataFrame.union, parts).select(F.col("start").alias("node")).distinct()


def foci(validator: shacl.Validator, nodes: DataFrame | None) -> DataFrame:
    """focus: the target nodes among the nodes (None: all)."""
    found = [f.select("fk") for s in validator.schema.shapes.values() if not s.deactivated and (f := validator.focus_nodes(s)) is not None]
    if not found:
        return validator.graph.spark.createDataFrame([], "focus string")
    every = reduce(DataFrame.union, found).distinct().withColumnRenamed("fk", "focus")
    return every if nodes is None else every.join(nodes.select(F.col("node").alias("focus")), "focus", "left_semi")


def revalidate(graph: Graph, batch: DataFrame, schema: shacl.Schema, mode: str = "native") -> tuple[FrameGraph, DataFrame, DataFrame]:
    """The graph with the batch, the foci looked at, and their violations."""
    both = graph.add(batch)
    validator, nodes = shacl.Validator(both, schema, mode), affected(both, batch, schema, mode)
    return both, foci(validator, nodes), validator.validate(nodes=nodes)


def current(looked_at: DataFrame, violations: DataFrame) -> DataFrame:
    """The violations that hold now, of all batches' (batch, focus) and violations: of each focus those of the last batch that looked at it."""
    last = looked_at.groupBy("focus").agg(F.max("batch").alias("batch"))
    return violations.join(last, ["focus", "batch"], "left_semi")


def start(stream: DataFrame, store: str, schema: shacl.Schema, out: str, checkpoint: str, mode: str = "native"):
    """Run on a stream of (s, p, o). Triples go to the Parquet table `store`, violations to `out` and the foci looked at to `out`-foci, each by batch."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        # what was written is read: the batch isn't computed again for each of its uses
        own = spark.read.schema(batch.schema).parquet(f"{store}/batch={number}")
        known = spark.read.schema(batch.schema).parquet(store).where(F.col("batch") <= number)
        graph = FrameGraph(known.select("s", "p", "o").distinct())
        validator, nodes = shacl.Validator(graph, schema, mode), affected(graph, own, schema, mode)
        validator.validate(nodes=nodes).write.mode("overwrite").parquet(f"{out}/batch={number}")
        foci(validator, nodes).write.mode("overwrite").parquet(f"{out}-foci/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window start, key, n: counts in tumbling or sliding windows of a stream, with a watermark for late rows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
