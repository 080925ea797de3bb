"""Semantic actions of ShEx constraints, run on all triples that a constraint matched at once.

A registry maps an extension's IRI to a function from an action's code and the triples (focus, s, p, value: a term) to
rows (focus, output, failed). Actions of groups are ignored; an unknown extension is an error. Start actions run once,
without a triple.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import key_of
from ..operators.graph import Graph
from . import shex

Action = Callable[[str, DataFrame], DataFrame]
# The IRIs of the extensions.
TEST, MAP = "http://shex.io/extensions/Test/", "http://shex.io/extensions/Map/"
COLUMNS = "focus string, predicate string, action string, output string, failed boolean"

_TEST_CODE = re.compile(r'\s*(?P<verb>fail|print)\s*\(\s*(?:"(?P<text>(?:[^"\\]|\\.)*)"|(?P<name>[spo]))\s*\)\s*')


class ActionError(shex.ShexError):
    pass


def test_action(code: str, triples: DataFrame) -> DataFrame:
    """print(x) gives x for each triple, fail(x) also makes it fail; x is a text, or s, p or o."""
    if not code.strip():
        return triples.select("focus", F.lit(None).cast("string").alias("output"), F.lit(False).alias("failed"))
    found = _TEST_CODE.fullmatch(code)
    if not found:
        raise ActionError(f"no test action: {code!r}")
    if found["name"]:
        out = {"s": F.col("s"), "p": F.col("p"), "o": F.col("value.lex")}[found["name"]]
    else:
        out = F.lit(re.sub(r"\\(.)", r"\1", found["text"]))
    return triples.select("focus", out.alias("output"), F.lit(found["verb"] == "fail").alias("failed"))


def map_action(code: str, triples: DataFrame) -> DataFrame:
    """key=value of each triple."""
    return triples.select("focus", F.concat(F.lit(code.strip() + "="), F.col("value.lex")).alias("output"), F.lit(False).alias("failed"))


REGISTRY: dict[str, Action] = {TEST: test_action, MAP: map_action}


def _find(registry: dict[str, Action], name: str) -> Action:
    for known, action in registry.items():
        if known.partition("#")[0].rstrip("/") == name.partition("#")[0].rstrip("/"):
            return action
    raise ActionError(f"no extension {name}")


def run(graph: Graph, schema: shex.Schema, nodes: DataFrame, label: str, registry: dict[str, Action] | None = None) -> DataFrame:
    """focus, predicate, action, output, failed for each triple that a constraint with an action matches, at the nodes that conform; null focus and predicate: start actions."""
    registry = REGISTRY if registry is None else registry
    validator = shex.Validator(graph, schema)
    own = nodes.select(key_of(F.col("node")).alias("fk"), F.col("node").alias("focus")).dropDuplicates(["fk"])
    good = own.join(validator.failing_label(label, own), "fk", "left_anti")
    leaves: list[shex.TripleConstraint] = []
    validator._extended(validator._base(label), leaves)
    parts = []
    one = graph.spark.range(1).select(*(F.lit(None).cast("string").alias(c) for c in ("focus", "s", "p")), F.struct(F.lit(None).cast("string").alias("lex")).alias("value"))
    for name, code in schema.start_actions:
        made = _find(registry, name)(code, one)
        parts.append(made.select("focus", F.lit(None).cast("string").alias("predicate"), F.lit(name).alias("action"), "output", "failed"))
    for leaf in leaves:
        for name, code in leaf.actions:
            values = validator._values(good, leaf.predicate, leaf.inverse)
            fits = shex.value_condition(leaf.value, F.col("value"))
            values = values if fits is None else values.where(fits)
            s, o = (F.col("value.lex"), F.col("fk")) if leaf.inverse else (F.col("fk"), F.col("value.lex"))
            triples = values.select(F.col("fk").alias("focus"), s.alias("s"), F.lit(leaf.predicate).alias("p"), F.struct(o.alias("lex")).alias("value"))
            made = _find(registry, name)(code, triples)
            parts.append(made.select("focus", F.lit(leaf.predicate).alias("predicate"), F.lit(name).alias("action"), "output", "failed"))
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], COLUMNS)


def conforming(graph: Graph, schema: shex.Schema, nodes: DataFrame, label: str, registry: dict[str, Action] | None = None) -> DataFrame:
    """node: those that conform and of whose actions, start actions among them, none fails."""
    validator = shex.Validator(graph, schema)
    own = nodes.select(key_of(F.col("node")).alias("fk"), F.col("node").alias("focus")).dropDuplicates(["fk"])
    good = own.join(validator.failing_label(label, own), "fk", "left_anti")
    failed = run(graph, schema, nodes, label, registry).where("failed").select("focus").distinct()
    # a start action that fails has no focus: it fails all
    hit = good.join(failed, (F.col("fk") == failed["focus"]) | failed["focus"].isNull(), "left_anti") if schema.start_actions else good.join(failed.withColumnRenamed("focus", "fk"), "fk", "left_anti")
    return hit.select(F.col("fk").alias("node"))
