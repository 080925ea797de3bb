"""RDF terms as struct columns, XSD lexical checks and comparisons.

A term is STRUCT<k, lex, dt, lang, num, ts>: k is iri, bnode, literal or triple; lex the IRI, the
label (with _:), the lexical form or the text of a triple term; dt and lang are '' where there is
none, so that terms join by plain equality of (k, lex, dt, lang); num and ts are the value of a
numeric or dateTime literal, null otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SH = "http://www.w3.org/ns/shacl#"
TYPE = RDF + "type"
SUBCLASS = RDFS + "subClassOf"
LANG_STRING = RDF + "langString"

TERM = "struct<k:string,lex:string,dt:string,lang:string,num:double,ts:timestamp>"
KEY = ("k", "lex", "dt", "lang")

# The lexical forms that are checked, as patterns, and the ranges of the whole-number types.
INTEGER = r"^[+-]?[0-9]+$"
LEXICAL = {
    "integer": INTEGER, "long": INTEGER, "short": INTEGER, "byte": INTEGER,
    "unsignedLong": r"^\+?[0-9]+$", "unsignedInt": r"^\+?[0-9]+$", "unsignedShort": r"^\+?[0-9]+$", "unsignedByte": r"^\+?[0-9]+$",
    "nonNegativeInteger": r"^(\+?[0-9]+|-0+)$", "positiveInteger": r"^\+?0*[1-9][0-9]*$", "negativeInteger": r"^-0*[1-9][0-9]*$", "nonPositiveInteger": r"^(-[0-9]+|\+?0+)$",
    "decimal": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$",
    "double": r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|-?(INF|inf|Inf|infinity)|[+-]?(NaN|nan))$",
    "float": r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|-?(INF|inf|Inf|infinity)|[+-]?(NaN|nan))$",
    "boolean": r"^(true|false|1|0)$",
    "dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
}
RANGES = {
    "long": (-(2**63), 2**63 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
}
NUMERIC = tuple(XSD + n for n in LEXICAL if n not in ("boolean", "dateTime")) + (XSD + "int",)


@dataclass(frozen=True, order=True)
class Term:
    """A term on the driver."""

    k: str
    lex: str
    dt: str = ""
    lang: str = ""

    def __str__(self) -> str:
        if self.k == "iri":
            return f"<{self.lex}>"
        if self.k != "literal":
            return self.lex
        quoted = '"' + self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
        return f"{quoted}@{self.lang}" if self.lang else f"{quoted}^^<{self.dt}>" if self.dt and self.dt != XSD + "string" else quoted


def iri(lex: str) -> Term:
    return Term("iri", lex)


def literal(lex, dt: str = XSD + "string", lang: str = "") -> Term:
    if isinstance(lex, bool):
        return Term("literal", str(lex).lower(), XSD + "boolean")
    if isinstance(lex, int):
        return Term("literal", str(lex), XSD + "integer")
    if isinstance(lex, float):
        return Term("literal", repr(lex), XSD + "double")
    return Term("literal", lex, LANG_STRING if lang else dt, lang)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def number_of(lex: Column, dt: Column) -> Column:
    return F.when(dt.isin(*NUMERIC), lex.try_cast("double"))


def time_of(lex: Column, dt: Column) -> Column:
    return F.when(dt == XSD + "dateTime", lex.try_cast("timestamp"))


def term(k, lex, dt="", lang="", num=None, ts=None) -> Column:
    """A term; num and ts come from the lexical form unless given."""
    k, lex, dt, lang = map(_column, (k, lex, dt, lang))
    num = number_of(lex, dt) if num is None else num
    ts = time_of(lex, dt) if ts is None else ts
    return F.struct(k.alias("k"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang"), num.cast("double").alias("num"), ts.cast("timestamp").alias("ts"))


def resource(lex) -> Column:
    """The term of an IRI or blank node, by its text."""
    lex = _column(lex)
    kind = F.when(lex.startswith("_:"), "bnode").otherwise("iri")
    return F.when(lex.isNotNull(), F.struct(kind.alias("k"), lex.alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("timestamp").alias("ts")))


def constant(t: Term) -> Column:
    return term(t.k, t.lex, t.dt, t.lang)


def same(a: Column, b: Column) -> Column:
    """Term equality."""
    out = a["k"] == b["k"]
    for f in KEY[1:]:
        out = out & (a[f] == b[f])
    return out


def is_term(a: Column, t: Term) -> Column:
    out = (a["k"] == t.k) & (a["lex"] == t.lex)
    return out & (a["dt"] == t.dt) & (a["lang"] == t.lang) if t.k == "literal" else out


def key_of(a: Column) -> Column:
    """A string that is equal for equal terms alone."""
    return F.when(a["k"] != "literal", a["lex"]).otherwise(F.concat(F.lit('"'), a["lex"], F.lit('"^^'), a["dt"], F.lit("@"), a["lang"]))


def ill_typed(a: Column) -> Column:
    """A literal whose checked datatype doesn't allow its lexical form. Other datatypes are not checked."""
    out = F.lit(False)
    for name, pattern in LEXICAL.items():
        bad = ~a["lex"].rlike(pattern)
        if name in RANGES:
            low, high = RANGES[name]
            wide = a["lex"].try_cast("decimal(38,0)")
            bad = bad | ~F.coalesce(wide.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), F.lit(False))
        if name == "dateTime":
            bad = bad | a["lex"].try_cast("timestamp").isNull()
        out = F.when(a["dt"] == XSD + name, bad).otherwise(out)
    return (a["k"] == "literal") & out


def _order(a: Column, b: Column, op: str) -> Column:
    apply = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y}[op]
    text = a["dt"].isin(XSD + "string", LANG_STRING) & b["dt"].isin(XSD + "string", LANG_STRING)
    plain = (a["dt"] == b["dt"]) & ~a["dt"].isin(XSD + "dateTime", *NUMERIC)
    numbers = ~F.isnan(a["num"]) & ~F.isnan(b["num"])
    return (
        F.when((a["k"] != "literal") | (b["k"] != "literal"), F.lit(None))
        .when(a["num"].isNotNull() & b["num"].isNotNull(), F.when(numbers, apply(a["num"], b["num"])))
        .when(a["ts"].isNotNull() & b["ts"].isNotNull(), apply(a["ts"], b["ts"]))
        .when(text | plain, apply(a["lex"], b["lex"]))
    )


def compare(a: Column, op: str, b: Column) -> Column:
    """The partial order of literals: null where two terms can't be compared."""
    return _order(a, b, op)


def rank(a: Column) -> list[Column]:
    """Sort keys: unbound, blank nodes, IRIs, literals; numbers by value, then by text."""
    kind = F.when(a.isNull(), 0).when(a["k"] == "bnode", 1).when(a["k"] == "iri", 2).when(a["k"] == "literal", 3).otherwise(4)
    return [kind, a["num"], a["ts"], a["lex"]]


def byte_length(a: Column) -> Column:
    return F.octet_length(a["lex"])


def regex(pattern: str, flags: str = "") -> str:
    """A pattern with SPARQL flags as one of Java's dialect."""
    if "q" in flags:
        pattern = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    inline = "".join(f for f in "smix" if f in flags)
    return f"(?{inline}){pattern}" if inline else pattern
