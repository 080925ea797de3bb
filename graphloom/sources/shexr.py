"""ShExR: ShEx schemas as RDF."""

from __future__ import annotations

from collections import defaultdict

from ..functions.terms import RDF, TYPE, Term
from ..plans import shex

SX = "http://www.w3.org/ns/shex#"


def parse_shexr(triples) -> shex.Schema:
    """From driver triples (s, p, Term)."""
    by = defaultdict(lambda: defaultdict(list))
    for s, p, o in triples:
        by[s][p].append(o)
    schema = shex.Schema()

    def get(s: str, name: str) -> Term | None:
        found = by[s][SX + name]
        return found[0] if found else None

    def items(head: Term | None) -> list[Term]:
        out, at = [], head.lex if head else RDF + "nil"
        while at != RDF + "nil":
            out.append(by[at][RDF + "first"][0])
            at = by[at][RDF + "rest"][0].lex
        return out

    def kind(s: str) -> str:
        return next((t.lex.removeprefix(SX) for t in by[s][TYPE] if t.lex.startswith(SX)), "")

    declared = {o.lex for s in list(by) for o in by[s][SX + "shapes"]} | {x.lex for s in list(by) for h in by[s][SX + "shapes"] if by[h.lex][RDF + "first"] for x in items(h)}

    def value(t: Term):
        k = kind(t.lex) if t.k != "literal" else ""
        for prefix, own in (("Iri", shex.IRI_STEM), ("Literal", shex.LITERAL_STEM), ("Language", shex.LANGUAGE_STEM)):
            if k in (prefix + "Stem", prefix + "StemRange"):
                stem = get(t.lex, "stem")
                outs = tuple(value(x) for x in items(get(t.lex, "exclusion")))
                return shex.Stem(own, stem.lex if stem is not None and stem.k != "bnode" else "", outs)
        if k == "Language":
            return shex.Stem(shex.LANGUAGE_STEM, get(t.lex, "languageTag").lex, exact=True)
        return t

    def shape(t: Term, top: bool = False):
        s = t.lex
        if not top and s in declared:
            return shex.Ref(s)
        k = kind(s)
        if k in ("ShapeAnd", "ShapeOr"):
            return {"ShapeAnd": shex.ShapeAnd, "ShapeOr": shex.ShapeOr}[k](tuple(shape(x) for x in items(get(s, "shapeExprs"))))
        if k == "ShapeNot":
            return shex.ShapeNot(shape(get(s, "shapeExpr")))
        if k == "ShapeExternal":
            return shex.External()
        if k == "NodeConstraint":
            facets = []
            for name in ("length", "minlength", "maxlength", "mininclusive", "minexclusive", "maxinclusive", "maxexclusive", "totaldigits", "fractiondigits"):
                if (x := get(s, name)) is not None:
                    facets.append((name, float(x.lex) if "clusive" in name else int(x.lex)))
            if (x := get(s, "pattern")) is not None:
                flags = get(s, "flags")
                facets.append(("pattern", (x.lex, flags.lex if flags else "")))
            node, datatype, values = get(s, "nodeKind"), get(s, "datatype"), get(s, "values")
            return shex.NodeConstraint(node.lex.removeprefix(SX) if node else None, datatype.lex if datatype else None, tuple(facets), tuple(map(value, items(values))) if values else None)
        expr, closed = get(s, "expression"), get(s, "closed")
        return shex.ShapeDef(triple(expr) if expr else None, closed is not None and closed.lex == "true", tuple(x.lex for x in by[s][SX + "extra"]), tuple(x.lex for x in by[s][SX + "extends"]))

    def triple(t: Term):
        s = t.lex
        low, high = get(s, "min"), get(s, "max")
        lo, hi = int(low.lex) if low else 1, int(high.lex) if high else 1
        hi = None if hi == -1 else hi
        k = kind(s)
        if k in ("EachOf", "OneOf"):
            return {"EachOf": shex.EachOf, "OneOf": shex.OneOf}[k](tuple(triple(x) for x in items(get(s, "expressions"))), lo, hi)
        inverse, own = get(s, "inverse"), get(s, "valueExpr")
        return shex.TripleConstraint(get(s, "predicate").lex, shape(own) if own else None, lo, hi, inverse is not None and inverse.lex == "true")

    for s in sorted(declared):
        if by[s][RDF + "first"]:
            continue
        schema.shapes[s] = shape(Term("iri", s), True)
    for s in list(by):
        if (start := get(s, "start")) is not None:
            schema.start = shape(start)
    return schema


