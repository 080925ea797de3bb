"""Schemas to schemas and to text: ShEx, SHACL, profiles, SPARQL, UML, HTML; tables of small results."""

from __future__ import annotations

import csv
import html
import io
import json

from ..functions.terms import SH, XSD, Term
from ..operators import generate
from ..operators.paths import Inv, Pred
from ..plans import shacl, shex


class ConversionError(ValueError):
    pass


def qualify(t, prefixes: dict[str, str]) -> str:
    """A term in short form by its longest prefix."""
    if t is None:
        return ""
    k, lex = (t["k"], t["lex"]) if not isinstance(t, str) else ("iri", t)
    if k == "iri":
        for name, full in sorted(prefixes.items(), key=lambda x: -len(x[1])):
            if lex.startswith(full):
                return f"{name}:{lex[len(full) :]}"
    return lex


def table_text(columns: list[str], rows: list[list[str]], kind: str = "markdown") -> str:
    if kind == "json":
        return json.dumps([dict(zip(columns, r)) for r in rows], ensure_ascii=False)
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([columns, *rows])
        return out.getvalue()
    if not rows:
        return "No results"
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)])


def leaves(e) -> list[shex.TripleConstraint]:
    if isinstance(e, shex.TripleConstraint):
        return [e]
    if isinstance(e, (shex.EachOf, shex.OneOf, shex.ShapeAnd, shex.ShapeOr)):
        return [x for p in e.parts for x in leaves(p)]
    if isinstance(e, shex.ShapeDef):
        return leaves(e.expr)
    return []


def constraints(schema) -> list[tuple[str, str, int, int | None]]:
    """(shape, predicate, least, most) of a ShEx or SHACL schema."""
    if isinstance(schema, shex.Schema):
        return [(label, x.predicate, x.low, x.high) for label, e in schema.shapes.items() for x in leaves(e)]
    out = []
    for s in schema.shapes.values():
        cls = next((v for k, v in s.targets if k in ("class", "implicit")), s.id)
        for c in s.constraints:
            p = schema.shapes.get(c.args[0]) if c.name == "property" else None
            if p is not None and isinstance(p.path, Pred):
                n = {x.name: x.args[0] for x in p.constraints if x.name in ("minCount", "maxCount")}
                out.append((cls, p.path.iri, n.get("minCount", 0), n.get("maxCount")))
    return out


def predicates(schema) -> set[str]:
    return {p for _, p, _, _ in constraints(schema)}


def shacl_to_shex(schema: shacl.Schema) -> shex.Schema:
    """Property shapes become triple constraints with their cardinality, datatype, class, node kind, values and facets."""
    out = {}
    kinds = {"IRI": "iri", "BlankNode": "bnode", "Literal": "literal", "BlankNodeOrIRI": "nonliteral"}
    for s in schema.shapes.values():
        if s.path is not None:
            continue
        parts = []
        for c in s.constraints:
            if c.name != "property":
                continue
            p = schema.shapes[c.args[0]]
            inverse = isinstance(p.path, Inv)
            path = p.path.path if inverse else p.path
            if not isinstance(path, Pred):
                raise ConversionError("a path of several steps has no triple constraint")
            low, high, kind, datatype, facets, values, ref = 0, None, None, None, [], None, None
            for x in p.constraints:
                if x.name == "minCount":
                    low = x.args[0]
                elif x.name == "maxCount":
                    high = x.args[0]
                elif x.name == "datatype":
                    datatype = x.args[0]
                elif x.name == "nodeKind":
                    kind = kinds.get(x.args[0])
                elif x.name == "in":
                    values = x.args[0]
                elif x.name == "hasValue":
                    values = (x.args[0],)
                elif x.name in ("minLength", "maxLength"):
                    facets.append((x.name.lower(), x.args[0]))
                elif x.name == "pattern":
                    facets.append(("pattern", x.args))
                elif x.name in ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive"):
                    facets.append((x.name.lower(), float(x.args[0].lex)))
                elif x.name == "node":
                    ref = shex.Ref(x.args[0])
                elif x.name == "class":
                    out.setdefault(x.args[0], shex.ShapeDef(shex.TripleConstraint("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", shex.NodeConstraint(values=(Term("iri", x.args[0]),))), extra=("http://www.w3.org/1999/02/22-rdf-syntax-ns#type",)))
                    ref = shex.Ref(x.args[0])
            own = shex.NodeConstraint(kind, datatype, tuple(facets), values)
            value = ref if own == shex.NodeConstraint() else own if ref is None else shex.ShapeAnd((own, ref))
            parts.append(shex.TripleConstraint(path.iri, value, low, high, inverse))
        closed = any(c.name == "closed" for c in s.constraints)
        out[s.id] = shex.ShapeDef(None if not parts else parts[0] if len(parts) == 1 else shex.EachOf(tuple(parts)), closed)
    return shex.Schema(out, prefixes=dict(schema.prefixes))


def shex_to_sparql(schema: shex.Schema, label: str | None = None) -> str:
    """A SELECT with a pattern for each constraint of a shape and of those that it refers to; cardinalities are left out."""
    label = label or (schema.start.label if isinstance(schema.start, shex.Ref) else next(iter(schema.shapes)))
    lines, count, seen = [], 0, set()

    def walk(name: str, var: str) -> None:
        nonlocal count
        if name in seen:
            return
        seen.add(name)
        for x in leaves(schema.shapes[name]):
            count += 1
            other = f"?v{count}"
            lines.append(f"  {other} <{x.predicate}> {var} ." if x.inverse else f"  {var} <{x.predicate}> {other} .")
            if isinstance(x.value, shex.Ref):
                walk(x.value.label, other)
            elif isinstance(x.value, shex.NodeConstraint):
                if x.value.datatype:
                    lines.append(f"  FILTER (datatype({other}) = <{x.value.datatype}>)")
                elif x.value.values and all(isinstance(v, Term) for v in x.value.values):
                    lines.append(f"  FILTER ({other} IN ({', '.join(map(str, x.value.values))}))")

    walk(label, "?this")
    return "SELECT * WHERE {\n" + "\n".join(lines) + "\n}"


def _short(lex: str, prefixes: dict) -> str:
    return qualify(lex, prefixes)


def _value(x: shex.TripleConstraint, prefixes: dict) -> str:
    v = x.value
    if isinstance(v, shex.Ref):
        return "@" + _short(v.label, prefixes)
    if isinstance(v, shex.NodeConstraint):
        return _short(v.datatype, prefixes) if v.datatype else "[..]" if v.values else (v.kind or ".").upper()
    return "."


def _card(low: int, high: int | None) -> str:
    return {(1, 1): "", (0, 1): "?", (0, None): "*", (1, None): "+"}.get((low, high), f"{{{low},{'*' if high is None else high}}}")


def shex_to_uml(schema: shex.Schema) -> str:
    names = {k: f"c{i}" for i, k in enumerate(schema.shapes)}
    boxes, links = [], []
    for label, e in schema.shapes.items():
        rows = []
        for x in leaves(e):
            if isinstance(x.value, shex.Ref) and x.value.label in names:
                links.append(f'{names[label]} --> "{_card(x.low, x.high)}" {names[x.value.label]} : {_short(x.predicate, schema.prefixes)}')
            else:
                rows.append(f"  {_short(x.predicate, schema.prefixes)} : {_value(x, schema.prefixes)} {_card(x.low, x.high)}".rstrip())
        boxes.append(f'class "{_short(label, schema.prefixes)}" as {names[label]} {{\n' + "\n".join(rows) + "\n}")
        if isinstance(e, shex.ShapeDef):
            links += [f"{names[b]} <|-- {names[label]}" for b in e.extends if b in names]
    return "@startuml\n" + "\n".join(boxes + links) + "\n@enduml\n"


def shex_to_html(schema: shex.Schema) -> str:
    parts = []
    for label, e in schema.shapes.items():
        rows = "".join(f"<tr><td>{html.escape(_short(x.predicate, schema.prefixes))}</td><td>{html.escape(_value(x, schema.prefixes))}</td><td>{html.escape(_card(x.low, x.high))}</td></tr>" for x in leaves(e))
        parts.append(f"<h2>{html.escape(_short(label, schema.prefixes))}</h2><table><tr><th>property</th><th>value</th><th>cardinality</th></tr>{rows}</table>")
    return "<!DOCTYPE html><html><body>" + "".join(parts) + "</body></html>"


def shex_to_rdf_config(schema: shex.Schema) -> str:
    """A model in YAML: subjects with their properties and variable names."""
    out = []
    for label, e in schema.shapes.items():
        name = label.rpartition("/")[2].rpartition("#")[2]
        out.append(f"- {name} <{label}>:")
        for x in leaves(e):
            own = x.predicate.rpartition("/")[2].rpartition("#")[2]
            out.append(f"  - {_short(x.predicate, schema.prefixes) if schema.prefixes else '<' + x.predicate + '>'}{_card(x.low, x.high)}:")
            out.append(f"    - {own}: {_value(x, schema.prefixes)}")
    return "\n".join(out) + "\n"


def parse_rdf_config(text: str):
    """The model of an rdf-config document (the first, of several), as lists and maps; needs a YAML reader."""
    try:
        import yaml
    except ImportError as e:
        raise ConversionError("no YAML reader is installed") from e
    try:
        found = list(yaml.safe_load_all(text))
    except yaml.YAMLError as e:
        raise ConversionError(f"no YAML: {e}") from e
    if not found or found[0] is None:
        raise ConversionError("the document is empty")
    return found[0]


def rdf_config_to_shex(model, prefixes: dict[str, str]) -> shex.Schema:
    """Subjects `name <iri>` with properties `prefix:name` and a cardinality mark; what a property's values are isn't told."""
    out = {}
    for entry in model:
        for subject, properties in entry.items():
            label = subject.partition("<")[2].rstrip(">") or subject.split()[0]
            parts = []
            for arc in properties or ():
                for name in arc if isinstance(arc, dict) else (arc,):
                    low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(name[-1], (1, 1))
                    plain = name.rstrip("?*+").strip()
                    prefix, colon, local = plain.partition(":")
                    iri = plain[1:-1] if plain.startswith("<") else prefixes[prefix] + local if colon and prefix in prefixes else plain
                    parts.append(shex.TripleConstraint(iri, None, low, high))
            out[label] = shex.ShapeDef(None if not parts else parts[0] if len(parts) == 1 else shex.EachOf(tuple(parts)))
    return shex.Schema(out, prefixes=dict(prefixes))


def graph_uml(rows, prefixes: dict) -> str:
    """(s, p, k, lex) rows as a diagram."""
    names: dict[str, str] = {}

    def box(key: str, text: str) -> str:
        if key not in names:
            names[key] = f"n{len(names)}"
            lines.append(f'rectangle "{text}" as {names[key]}')
        return names[key]

    lines: list[str] = []
    for i, r in enumerate(rows):
        a = box(r["s"], qualify(r["s"], prefixes))
        b = box(r["lex"], qualify(r["lex"], prefixes)) if r["k"] != "literal" else box(f"literal {i}", r["lex"].replace('"', "'"))
        lines.append(f"{a} --> {b} : {qualify(r['p'], prefixes)}")
    return "@startuml\n" + "\n".join(lines) + "\n@enduml\n"


def shex_statistics(schema: shex.Schema) -> dict[str, int]:
    found = [x for e in schema.shapes.values() for x in leaves(e)]
    return {"shapes": len(schema.shapes), "triple_constraints": len(found), "predicates": len({x.predicate for x in found}), "references": sum(isinstance(x.value, shex.Ref) for x in found), "extends": sum(len(e.extends) for e in schema.shapes.values() if isinstance(e, shex.ShapeDef)), "abstract": len(schema.abstract)}


def to_generator(schema) -> list[generate.Shape]:
    """Generator shapes of a ShEx or SHACL schema."""
    if isinstance(schema, shacl.Schema):
        schema = shacl_to_shex(schema)
    out = []
    for label, e in schema.shapes.items():
        found = leaves(e)
        if not isinstance(e, shex.ShapeDef) or not found:
            continue
        props = []
        for x in found:
            if x.inverse:
                continue
            v = x.value if isinstance(x.value, shex.NodeConstraint) else shex.NodeConstraint()
            facets = dict(v.facets)
            terms = tuple(t for t in v.values or () if isinstance(t, Term))
            props.append(generate.Property(x.predicate, v.datatype or XSD + "string", x.low, x.high, x.value.label if isinstance(x.value, shex.Ref) else None, terms, least=facets.get("mininclusive"), most=facets.get("maxinclusive"), generator="uri" if v.kind == "iri" and not terms else None))
        out.append(generate.Shape(label, tuple(props)))
    return out


def convert(schema, source: str, target: str, prefixes: dict | None = None, **kw) -> str:
    """Text of a schema in another language."""
    from . import dctap, shex_text

    prefixes = prefixes or {}
    if source == "dctap":
        own = dctap.to_shex(schema, prefixes)
        if target == "shacl":
            return shacl_text(dctap.to_shacl(schema, prefixes))
    elif source == "shacl":
        if target == "shacl":
            return shacl_text(schema)
        own = shacl_to_shex(schema)
    elif source == "shex":
        own = schema
    else:
        raise ConversionError(f"{source} isn't read")
    makers = {"shexc": shex_text.print_shexc, "shex": shex_text.print_shexc, "sparql": lambda s: shex_to_sparql(s, **kw), "uml": shex_to_uml, "html": shex_to_html, "rdfconfig": shex_to_rdf_config}
    if target not in makers:
        raise ConversionError(f"{source} isn't converted to {target}")
    return makers[target](own)


def shacl_text(schema: shacl.Schema) -> str:
    """Node and property shapes as Turtle; logical components by name."""
    from ..operators.paths import text_of
    from .turtle import serialize

    triples = []
    iri = lambda x: Term("iri", x)
    for s in schema.shapes.values():
        triples.append((s.id, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", iri(SH + ("NodeShape" if s.path is None else "PropertyShape"))))
        if s.path is not None:
            if not isinstance(s.path, Pred):
                raise ConversionError(f"the path {text_of(s.path)} isn't printed")
            triples.append((s.id, SH + "path", iri(s.path.iri)))
        for kind, v in s.targets:
            triples.append((s.id, SH + "target" + kind[0].upper() + kind[1:], v if isinstance(v, Term) else iri(v)))
        for c in s.constraints:
            x = c.args[0] if c.args else None
            if c.name in ("minCount", "maxCount", "minLength", "maxLength"):
                triples.append((s.id, SH + c.name, Term("literal", str(x), XSD + "integer")))
            elif isinstance(x, Term):
                triples.append((s.id, SH + c.name, x))
            elif c.name in ("class", "datatype", "node", "property", "not", "equals", "disjoint", "lessThan", "lessThanOrEquals"):
                triples.append((s.id, SH + c.name, iri(x)))
            elif c.name == "nodeKind":
                triples.append((s.id, SH + c.name, iri(SH + x)))
            elif c.name == "pattern":
                triples.append((s.id, SH + c.name, Term("literal", x, XSD + "string")))
            elif c.name in ("in", "and", "or", "xone", "languageIn"):
                items = [t if isinstance(t, Term) else Term("literal", t, XSD + "string") if c.name == "languageIn" else iri(t) for t in x]
                head = iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#nil")
                for k, item in reversed(list(enumerate(items))):
                    cell = f"_:l{len(triples)}x{k}"
                    triples += [(cell, "http://www.w3.org/1999/02/22-rdf-syntax-ns#first", item), (cell, "http://www.w3.org/1999/02/22-rdf-syntax-ns#rest", head)]
                    head = Term("bnode", cell)
                triples.append((s.id, SH + c.name, head))
    return serialize(triples, {"sh": SH, "xsd": XSD, **schema.prefixes})
