"""Tabular application profiles: CSV rows to shapes, and shapes to ShEx and SHACL."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import RDF, XSD, Term, literal
from ..operators.paths import Pred
from ..plans import shacl, shex

HEADERS = ("shapeID", "shapeLabel", "propertyID", "propertyLabel", "mandatory", "repeatable", "valueNodeType", "valueDataType", "valueConstraint", "valueConstraintType", "valueShape", "note", "severity", "extends")
CONSTRAINTS = ("picklist", "pattern", "iristem", "languagetag", "minlength", "maxlength", "mininclusive", "maxinclusive", "minexclusive", "maxexclusive")


class TapError(ValueError):
    pass


@dataclass
class Statement:
    property: str
    label: str = ""
    mandatory: bool = False
    repeatable: bool = False
    node_types: tuple = ()
    datatype: str = ""
    constraint: str = ""
    constraint_type: str = ""
    shape: str = ""
    note: str = ""
    severity: str = ""


@dataclass
class TapShape:
    id: str
    label: str = ""
    statements: list = field(default_factory=list)


def boolean(text: str) -> bool:
    known = {"yes": True, "true": True, "1": True, "no": False, "false": False, "0": False, "": False}
    if (t := (text or "").strip().lower()) not in known:
        raise TapError(f"{text!r} is no boolean")
    return known[t]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV file with shapeID filled forward in file order: a blank one continues the shape before."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    numbered = raw.withColumn("line", F.monotonically_increasing_id())
    # a profile is a small file; its order is that of one window
    filled = F.last(F.when(F.trim("shapeID") != "", F.trim("shapeID")), ignorenulls=True).over(Window.orderBy("line"))
    return numbered.withColumn("shapeID", F.coalesce(filled, F.lit("default")))


def read_excel(path: str, sheet: str | int = 0, placeholders: dict[str, str] | None = None) -> list[TapShape]:
    """The shapes of a sheet of a workbook, where a reader for its format is installed."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet, dtype=str, keep_default_na=False)
    except ImportError as e:
        raise TapError(f"no reader for {path} is installed") from e
    return parse(frame.to_csv(index=False), placeholders)


def parse(text: str, placeholders: dict[str, str] | None = None) -> list[TapShape]:
    """placeholders: a property's text -> a stem; each use gives the stem with a number, from 0 on for each text."""
    used: dict[str, int] = {}

    def property_of(name: str) -> str:
        if name not in (placeholders or {}):
            return name
        used[name] = used.get(name, -1) + 1
        return f"{placeholders[name]}{used[name]}"

    rows = csv.DictReader(io.StringIO(text))
    shapes: dict[str, TapShape] = {}
    at = "default"
    for row in rows:
        row = {(k or "").strip(): (v or "").strip() for k, v in row.items() if isinstance(v, str) or v is None}
        at = row.get("shapeID") or at
        own = shapes.setdefault(at, TapShape(at))
        own.label = own.label or row.get("shapeLabel", "")
        if not row.get("propertyID"):
            continue
        kind = row.get("valueConstraintType", "").lower()
        if kind and kind not in CONSTRAINTS:
            raise TapError(f"no such constraint type: {kind}")
        own.statements.append(Statement(property_of(row["propertyID"]), row.get("propertyLabel", ""), boolean(row.get("mandatory", "")), boolean(row.get("repeatable", "")), tuple(row.get("valueNodeType", "").lower().split()), row.get("valueDataType", ""), row.get("valueConstraint", ""), kind, row.get("valueShape", ""), row.get("note", ""), row.get("severity", "")))
    return list(shapes.values())


def expand(name: str, prefixes: dict) -> str:
    prefix, colon, local = name.partition(":")
    if name.startswith("<"):
        return name[1:-1]
    if colon and prefix in prefixes:
        return prefixes[prefix] + local
    return {"xsd": XSD, "rdf": RDF}.get(prefix, prefixes.get("", "") if not colon else prefix + ":") + (local if colon else name)


def _picklist(s: Statement, prefixes: dict) -> tuple[Term, ...]:
    items = [x.strip() for x in (s.constraint.split("|") if "|" in s.constraint else s.constraint.replace(",", " ").split())]
    iri = "iri" in s.node_types
    return tuple(Term("iri", expand(x, prefixes)) if iri or (":" in x and x.partition(":")[0] in prefixes) else literal(x) for x in items if x)


def _node(s: Statement, prefixes: dict):
    facets, values = [], None
    if s.constraint_type == "picklist":
        values = _picklist(s, prefixes)
    elif s.constraint_type == "pattern":
        facets.append(("pattern", (s.constraint, "")))
    elif s.constraint_type in ("minlength", "maxlength"):
        facets.append((s.constraint_type, int(s.constraint)))
    elif s.constraint_type in ("mininclusive", "maxinclusive", "minexclusive", "maxexclusive"):
        facets.append((s.constraint_type, float(s.constraint)))
    elif s.constraint_type == "iristem":
        values = tuple(shex.Stem(shex.IRI_STEM, expand(x, prefixes)) for x in s.constraint.split())
    elif s.constraint_type == "languagetag":
        values = tuple(shex.Stem(shex.LANGUAGE_STEM, x) for x in s.constraint.split())
    kind = {("iri",): "iri", ("bnode",): "bnode", ("literal",): "literal", ("bnode", "iri"): "nonliteral"}.get(tuple(sorted(s.node_types)))
    own = shex.NodeConstraint(kind, expand(s.datatype, prefixes) if s.datatype else None, tuple(facets), values)
    plain = own == shex.NodeConstraint()
    ref = shex.Ref(expand(s.shape, prefixes)) if s.shape else None
    return ref if plain and ref else None if plain else shex.ShapeAnd((own, ref)) if ref else own


def to_shex(shapes: list[TapShape], prefixes: dict | None = None) -> shex.Schema:
    """mandatory sets the least, repeatable the most number of values."""
    prefixes = prefixes or {}
    out = {}
    for t in shapes:
        parts = tuple(shex.TripleConstraint(expand(s.property, prefixes), _node(s, prefixes), int(s.mandatory), None if s.repeatable else 1) for s in t.statements)
        out[expand(t.id, prefixes)] = shex.ShapeDef(None if not parts else parts[0] if len(parts) == 1 else shex.EachOf(parts))
    return shex.Schema(out, prefixes=prefixes)


def to_shacl(shapes: list[TapShape], prefixes: dict | None = None) -> shacl.Schema:
    prefixes, made = prefixes or {}, []
    C = shacl.Constraint
    for t in shapes:
        node, props = expand(t.id, prefixes), []
        for k, s in enumerate(t.statements):
            cs = [C("minCount", (1,))] * s.mandatory + [C("maxCount", (1,))] * (not s.repeatable)
            if s.datatype:
                cs.append(C("datatype", (expand(s.datatype, prefixes),)))
            if s.shape:
                cs.append(C("node", (expand(s.shape, prefixes),)))
            if s.constraint_type == "picklist":
                cs.append(C("in", (_picklist(s, prefixes),)))
            elif s.constraint_type == "pattern":
                cs.append(C("pattern", (s.constraint, "")))
            elif s.constraint_type in ("minlength", "maxlength"):
                cs.append(C({"minlength": "minLength", "maxlength": "maxLength"}[s.constraint_type], (int(s.constraint),)))
            elif s.constraint_type.startswith(("min", "max")):
                names = {"mininclusive": "minInclusive", "maxinclusive": "maxInclusive", "minexclusive": "minExclusive", "maxexclusive": "maxExclusive"}
                cs.append(C(names[s.constraint_type], (literal(float(s.constraint)),)))
            props.append(shacl.Shape(f"{node}-{k + 1}", Pred(expand(s.property, prefixes)), constraints=tuple(cs), severity=s.severity or "Violation"))
        made += [shacl.Shape(node, constraints=tuple(C("property", (p.id,)) for p in props)), *props]
    return shacl.Schema.of(*made)
