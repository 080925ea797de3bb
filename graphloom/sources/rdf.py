"""RDF readers and writers.

N-Triples and N-Quads are split by line and parsed by one regular expression in the JVM. Turtle,
RDF/XML and JSON-LD documents are one row each. mode: strict fails on a bad line, lax skips it.
TriG and N3 are named formats that are refused on reading.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import LANG_STRING, RDF, TYPE, XSD, Term, resource, term
from ..operators.graph import FrameGraph, spread
from .turtle import RdfSyntaxError, TurtleParser

FORMATS = ("turtle", "ntriples", "nquads", "rdfxml", "jsonld", "trig", "n3")
SUFFIXES = {"ttl": "turtle", "nt": "ntriples", "nq": "nquads", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "jsonld": "jsonld", "trig": "trig", "n3": "n3"}

# What of a document is in memory at once beside its text, and the text of a document that is written.
XML_PIECE, BATCH_ROWS, BATCH_CHARS, DOCUMENT_BYTES = 1 << 16, 10_000, 4 << 20, 4 << 20

_RESOURCE = r"<([^<>\x00-\x20]*)>|(_:[A-Za-z0-9_][A-Za-z0-9_.\-]*)"
# possessive: a long literal must not be walked by recursion
_LITERAL = r'"((?:[^"\\\n\r]++|\\.)*+)"(?:\^\^<([^<>\x00-\x20]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
LINE = rf"^\s*(?:{_RESOURCE})\s*<([^<>\x00-\x20]*)>\s*(?:{_RESOURCE}|{_LITERAL}|(<<\(.*\)>>))\s*(?:{_RESOURCE})?\s*\.\s*(?:#.*)?$"


def _unescape(c: Column) -> Column:
    """Escapes of a literal; a double backslash is set aside first."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(out, F.lit("\x00"), F.lit("\\"))
    return F.when(c.contains("\\"), out).otherwise(c)


def from_lines(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """s, p, o, g from a column `value` of N-Triples or N-Quads lines. The expression runs once a line: its groups come as one array."""
    solid = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    mark = "\x1f"
    once = F.split(F.regexp_replace("value", LINE, mark.join(f"${k}" for k in range(1, 12))), mark)
    # a line that holds the mark itself is taken apart group by group
    apart = F.when(F.col("value").rlike(LINE), F.array(*(F.regexp_extract("value", LINE, k) for k in range(1, 12)))).otherwise(F.array(F.lit("")))
    cut = solid.select("value", F.when(F.col("value").contains(mark), apart).otherwise(once).alias("f"))
    good = F.size("f") == 11
    if mode == "lax":
        cut = cut.where(good)
    else:
        cut = cut.select(F.when(good, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("bad RDF line: "), F.col("value"))).cast("array<string>")).alias("f"))
    part = lambda k: F.col("f")[k - 1]
    node = lambda a, b: F.when(part(a) != "", part(a)).otherwise(F.when(part(b) != "", part(b)))
    lang = F.lower(part(8))
    dt = F.when(lang != "", LANG_STRING).when(part(7) != "", part(7)).otherwise(XSD + "string")
    triple = F.struct(F.lit("triple").alias("k"), part(9).alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("timestamp").alias("ts"))
    obj = F.when(node(4, 5).isNotNull(), resource(node(4, 5))).when(part(9) != "", triple).otherwise(term("literal", _unescape(part(6)), dt, lang))
    return cut.select(node(1, 2).alias("s"), part(3).alias("p"), obj.alias("o"), node(10, 11).alias("g"))


def parse_xml(text: str, base: str = "", scope: str = "") -> Iterator[list[tuple[str, str, Term]]]:
    """RDF/XML: node and property elements, types, resources, literals, nested nodes and collections; the triples of each outer node, which is then let go."""
    out: list[tuple[str, str, Term]] = []
    count = 0
    xml = "{http://www.w3.org/XML/1998/namespace}"
    rdf = "{" + RDF + "}"

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}x{count}"

    def full(tag: str) -> str:
        ns, _, local = tag[1:].partition("}")
        return ns + local

    def absolute(ref: str) -> str:
        from urllib.parse import urljoin

        return urljoin(base, ref) if base else ref

    def node(e, lang: str) -> Term:
        lang = e.get(xml + "lang", lang)
        if e.get(rdf + "about") is not None:
            me = Term("iri", absolute(e.get(rdf + "about")))
        elif e.get(rdf + "ID") is not None:
            me = Term("iri", absolute("#" + e.get(rdf + "ID")))
        elif e.get(rdf + "nodeID") is not None:
            me = Term("bnode", f"_:{scope}{e.get(rdf + 'nodeID')}")
        else:
            me = Term("bnode", blank())
        if e.tag != rdf + "Description":
            out.append((me.lex, TYPE, Term("iri", full(e.tag))))
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((rdf, xml)):
                out.append((me.lex, full(k), Term("literal", v, LANG_STRING if lang else XSD + "string", lang.lower())))
            elif k == rdf + "type":
                out.append((me.lex, TYPE, Term("iri", absolute(v))))
        for child in e:
            prop(me, child, lang)
        return me

    def prop(me: Term, e, lang: str) -> None:
        lang, p = e.get(xml + "lang", lang), full(e.tag)
        kind = e.get(rdf + "parseType")
        if e.get(rdf + "resource") is not None:
            out.append((me.lex, p, Term("iri", absolute(e.get(rdf + "resource")))))
        elif e.get(rdf + "nodeID") is not None:
            out.append((me.lex, p, Term("bnode", f"_:{scope}{e.get(rdf + 'nodeID')}")))
        elif kind == "Resource":
            own = Term("bnode", blank())
            out.append((me.lex, p, own))
            for child in e:
                prop(own, child, lang)
        elif kind == "Collection":
            items = [node(child, lang) for child in e]
            cells = [Term("bnode", blank()) for _ in items]
            out.append((me.lex, p, cells[0] if cells else Term("iri", RDF + "nil")))
            for i, item in enumerate(items):
                out.append((cells[i].lex, RDF + "first", item))
                out.append((cells[i].lex, RDF + "rest", cells[i + 1] if i + 1 < len(items) else Term("iri", RDF + "nil")))
        elif kind == "Literal":
            inner = (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e)
            out.append((me.lex, p, Term("literal", inner, RDF + "XMLLiteral")))
        elif len(e):
            out.append((me.lex, p, node(e[0], lang)))
        else:
            dt = e.get(rdf + "datatype")
            out.append((me.lex, p, Term("literal", e.text or "", absolute(dt) if dt else LANG_STRING if lang else XSD + "string", "" if dt else lang.lower())))

    root, depth = None, 0
    parser = ElementTree.XMLPullParser(("start", "end"))
    try:
        for at in range(0, max(len(text), 1), XML_PIECE):
            parser.feed(text[at : at + XML_PIECE])
            # the last piece is followed by the end, at which a document that isn't whole is an error
            if at + XML_PIECE >= len(text):
                parser.close()
            for event, e in parser.read_events():
                if event == "start":
                    root, depth = (e if root is None else root), depth + 1
                    continue
                depth, within = depth - 1, root.tag == rdf + "RDF"
                if depth == int(within):
                    node(e, root.get(xml + "lang", ""))
                    if within:
                        del root[:]
                    yield out
                    out = []
    except ElementTree.ParseError as e:
        raise RdfSyntaxError(str(e)) from e


def parse_jsonld(text: str, scope: str = "") -> Iterator[list[tuple[str, str, Term]]]:
    """JSON-LD with inline contexts: prefixes, terms, @vocab, @id, @type, @value, @language, @list, @graph, @reverse is not read. The triples of each outer node."""
    out: list[tuple[str, str, Term]] = []
    count = 0

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}j{count}"

    def expand(ctx: dict, name: str, vocab: bool = True) -> str:
        if name.startswith(("@", "_:")):
            return name
        known = ctx.get(name)
        known = known.get("@id") if isinstance(known, dict) else known
        if vocab and known is not None:
            return expand({k: v for k, v in ctx.items() if k != name}, known)
        head, colon, tail = name.partition(":")
        if colon and not tail.startswith("//") and head in ctx:
            return expand({k: v for k, v in ctx.items() if k != head}, ctx[head]["@id"] if isinstance(ctx[head], dict) else ctx[head]) + tail
        return name if colon or not vocab else ctx.get("@vocab", "") + name

    def value(ctx: dict, hint: dict, v) -> Term:
        if isinstance(v, dict):
            if "@value" in v:
                raw, dt, lang = v["@value"], v.get("@type"), v.get("@language", "")
                if not isinstance(raw, str):
                    return value(ctx, {"@type": dt} if dt else {}, raw)
                return Term("literal", raw, expand(ctx, dt) if dt else LANG_STRING if lang else XSD + "string", lang.lower())
            if "@list" in v:
                head = Term("iri", RDF + "nil")
                for item in reversed(v["@list"]):
                    own = blank()
                    out.append((own, RDF + "first", value(ctx, hint, item)))
                    out.append((own, RDF + "rest", head))
                    head = Term("bnode", own)
                return head
            return node(ctx, v)
        dt = hint.get("@type")
        if isinstance(v, bool):
            return Term("literal", str(v).lower(), XSD + "boolean")
        if isinstance(v, (int, float)):
            whole = isinstance(v, int)
            return Term("literal", str(v) if whole else f"{v:E}", expand(ctx, dt) if dt and dt[0] != "@" else XSD + ("integer" if whole else "double"))
        if dt in ("@id", "@vocab"):
            full = expand(ctx, v, dt == "@vocab")
            return Term("bnode" if full.startswith("_:") else "iri", f"_:{scope}{full[2:]}" if full.startswith("_:") else full)
        lang = hint.get("@language", ctx.get("@language", "")) if not dt else ""
        return Term("literal", v, expand(ctx, dt) if dt else LANG_STRING if lang else XSD + "string", lang.lower())

    def within(ctx: dict, e: dict) -> dict:
        for c in (x for x in [e.get("@context")] if x):
            for one in c if isinstance(c, list) else [c]:
                if not isinstance(one, dict):
                    raise RdfSyntaxError("only inline contexts are read")
                ctx = {**ctx, **one}
        return ctx

    def node(ctx: dict, e: dict) -> Term:
        ctx = within(ctx, e)
        alias = {k: v for k, v in ctx.items() if isinstance(v, str) and v.startswith("@")}
        e = {alias.get(k, k): v for k, v in e.items()}
        if e.get("@id") is not None:
            full = expand(ctx, e["@id"], False)
            me = Term("bnode", f"_:{scope}{full[2:]}") if full.startswith("_:") else Term("iri", full)
        else:
            me = Term("bnode", blank())
        for t in e.get("@type", []) if isinstance(e.get("@type"), list) else [e["@type"]] if "@type" in e else []:
            out.append((me.lex, TYPE, Term("iri", expand(ctx, t))))
        for inner in e.get("@graph", []):
            node(ctx, inner)
        for k, vs in e.items():
            if k.startswith("@") or vs is None:
                continue
            hint = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            p = expand(ctx, k)
            if ":" not in p:
                continue
            if hint.get("@container") == "@list":
                vs = {"@list": vs if isinstance(vs, list) else [vs]}
            for v in vs if isinstance(vs, list) else [vs]:
                out.append((me.lex, p, value(ctx, hint, v)))
        return me

    try:
        doc = json.loads(text)
    except ValueError as e:
        raise RdfSyntaxError(str(e)) from e
    for e in doc if isinstance(doc, list) else [doc]:
        # an object that only holds a graph has no triples of its own
        ctx, inner = ({}, [e]) if e.keys() - {"@context", "@graph"} else (within({}, e), e.get("@graph", []))
        for one in inner:
            node(ctx, one)
            yield out
            out = []


def parse_parts(text: str, kind: str, base: str = "", mode: str = "strict", scope: str = "") -> Iterator[list[tuple[str, str, Term]]]:
    """The triples of a document's statements or outer nodes, one after the other."""
    if kind in ("trig", "n3"):
        raise RdfSyntaxError(f"reading {kind} isn't supported")
    if kind in ("turtle", "ntriples"):
        return TurtleParser(text, base, mode == "strict", scope).statements()
    if kind == "rdfxml":
        return parse_xml(text, base, scope)
    if kind == "jsonld":
        return parse_jsonld(text, scope)
    raise RdfSyntaxError(f"no such format: {kind}")


def parse_text(text: str, kind: str, base: str = "", mode: str = "strict", scope: str = "") -> list[tuple[str, str, Term]]:
    """Driver triples of a document."""
    return [t for part in parse_parts(text, kind, base, mode, scope) for t in part]


def _arrow_rows(parts: Iterator[list[tuple[str, str, Term]]]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded size, made as the parser goes on."""
    names = ("s", "p", "k", "lex", "dt", "lang")
    rows, held = [], 0
    for part in parts:
        for s, p, o in part:
            rows.append((s, p, o.k, o.lex, o.dt, o.lang))
            held += len(o.lex)
            if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)


def read_rdf(spark: SparkSession, path: str | list[str], kind: str | None = None, base: str = "", mode: str = "strict") -> FrameGraph:
    """The graph of files; several are merged as sets. Blank nodes of Turtle, RDF/XML and JSON-LD files are kept apart by file."""
    paths = [path] if isinstance(path, str) else list(path)
    parts = []
    for p in paths:
        own = kind or SUFFIXES.get(p.rstrip("/").removesuffix(".gz").removesuffix(".bz2").rpartition(".")[2])
        if own in ("ntriples", "nquads"):
            df = from_lines(spark.read.text(p), mode)
            parts.append(df if own == "nquads" else df.select("s", "p", "o"))
        elif own in ("turtle", "rdfxml", "jsonld"):
            docs = spark.read.text(p, wholetext=True).select("value", F.substring(F.sha2(F.col("_metadata.file_path"), 256), 1, 10).alias("scope"))

            def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        yield from _arrow_rows(parse_parts(batch.column(0)[k].as_py(), own, base, mode, f"{batch.column(1)[k].as_py()}_"))

            flat = docs.mapInArrow(run, "s string, p string, k string, lex string, dt string, lang string")
            parts.append(flat.select("s", "p", term(F.col("k"), F.col("lex"), F.col("dt"), F.col("lang")).alias("o")))
        else:
            raise RdfSyntaxError(f"reading {own} isn't supported")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return FrameGraph(spread(out, *out.columns).dropDuplicates())


def from_text(spark: SparkSession, text: str, kind: str = "turtle", base: str = "", mode: str = "strict") -> FrameGraph:
    return FrameGraph.of(spark, dict.fromkeys(parse_text(text, kind, base, mode)))


def _escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _node_text(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def _term_text(o: Column) -> Column:
    """A term as N-Triples and Turtle write it."""
    quoted = F.concat(F.lit('"'), _escaped(o["lex"]), F.lit('"'))
    lit = F.when(o["lang"] != "", F.concat(quoted, F.lit("@"), o["lang"])).when(o["dt"].isin("", XSD + "string"), quoted).otherwise(F.concat(quoted, F.lit("^^<"), o["dt"], F.lit(">")))
    return F.when(o["k"] == "literal", lit).when(o["k"] == "triple", o["lex"]).otherwise(_node_text(o["lex"]))


def to_lines(df: DataFrame) -> DataFrame:
    """value: N-Triples lines (N-Quads where there is a column g)."""
    graph = [F.when(F.col("g").isNotNull(), _node_text(F.col("g")))] if "g" in df.columns else []
    return df.select(F.concat_ws(" ", _node_text(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), _term_text(F.col("o")), *graph, F.lit(".")).alias("value"))


def to_blocks(df: DataFrame) -> DataFrame:
    """value: a Turtle block for each subject, with full IRIs, so that blocks may go to any file."""
    pairs = F.concat(F.lit("<"), F.col("p"), F.lit("> "), _term_text(F.col("o")))
    grouped = df.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(pairs)), " ;\n    ").alias("rest"))
    return grouped.select(F.concat(_node_text(F.col("s")), F.lit(" "), F.col("rest"), F.lit(" .")).alias("value"))


def _xml_text(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_xml_elements(df: DataFrame) -> DataFrame:
    """value: an rdf:Description for each triple whose predicate ends in a name."""
    name, o = r"[A-Za-z_][A-Za-z0-9_.-]*$", F.col("o")
    local = F.regexp_extract("p", f"({name})", 1)
    space = F.regexp_replace("p", name, "")
    about = lambda c, attr: F.when(c.startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), F.expr("substring(%s, 3)" % attr), F.lit('"')))
    subject = F.coalesce(about(F.col("s"), "s"), F.concat(F.lit(' rdf:about="'), _xml_text(F.col("s")), F.lit('"')))
    target = F.coalesce(about(o["lex"], "o.lex"), F.concat(F.lit(' rdf:resource="'), _xml_text(o["lex"]), F.lit('"')))
    kind = F.when(o["lang"] != "", F.concat(F.lit(' xml:lang="'), o["lang"], F.lit('"'))).when(o["dt"].isin("", XSD + "string"), F.lit("")).otherwise(F.concat(F.lit(' rdf:datatype="'), o["dt"], F.lit('"')))
    head = F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), _xml_text(space), F.lit('"'))
    arc = F.when(o["k"] == "literal", F.concat(head, kind, F.lit(">"), _xml_text(o["lex"]), F.lit("</n:"), local, F.lit(">"))).otherwise(F.concat(head, target, F.lit("/>")))
    checked = F.when((local == "") | (o["k"] == "triple"), F.raise_error(F.concat(F.lit("RDF/XML can't write "), "p")).cast("string")).otherwise(arc)
    return df.select(F.concat(F.lit("<rdf:Description"), subject, F.lit(">"), checked, F.lit("</rdf:Description>")).alias("value"))


def to_json_nodes(df: DataFrame) -> DataFrame:
    """value: a JSON-LD node object for each triple."""
    text, o = (lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)), F.col("o")
    kind = F.when(o["lang"] != "", F.concat(F.lit(', "@language": '), text(o["lang"]))).when(o["dt"].isin("", XSD + "string"), F.lit("")).otherwise(F.concat(F.lit(', "@type": '), text(o["dt"])))
    literal = F.concat(F.lit('{"@value": '), text(o["lex"]), kind, F.lit("}"))
    resource_ = F.concat(F.lit('{"@id": '), text(o["lex"]), F.lit("}"))
    value = F.when(o["k"] == "literal", literal).when(o["k"] == "triple", F.raise_error(F.lit("JSON-LD can't write a triple as a term")).cast("string")).otherwise(resource_)
    return df.select(F.concat(F.lit('{"@id": '), text(F.col("s")), F.lit(", "), text(F.col("p")), F.lit(": ["), value, F.lit("]}")).alias("value"))


def _documents(df: DataFrame, items: DataFrame, per_document: int, begin: str, between: str, end: str) -> DataFrame:
    """value, document: the items of the triples in whole documents of about per_document each, or of DOCUMENT_BYTES if their texts are long."""
    many, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("o.lex")), F.lit(0))).first()
    parts = max(1, -(-many // per_document), -(-size // DOCUMENT_BYTES))
    placed = items.withColumn("document", F.pmod(F.xxhash64("value"), F.lit(parts)))
    joined = spread(placed, "document").groupBy("document").agg(F.array_join(F.collect_list("value"), between).alias("value"))
    return joined.select(F.concat(F.lit(begin), "value", F.lit(end)).alias("value"), "document")


def write_rdf(df: DataFrame, path: str, compression: str = "none", kind: str = "ntriples", per_document: int = 20_000) -> None:
    """Files of a format: lines of N-Triples and N-Quads as they come; Turtle in files of per_document subjects at most; RDF/XML and JSON-LD in documents of about per_document triples, a file each."""
    if kind in ("ntriples", "nquads"):
        out = to_lines(df)
    elif kind == "turtle":
        out = to_blocks(df.select("s", "p", "o"))
    elif kind == "rdfxml":
        out = _documents(df, to_xml_elements(df), per_document, f'<rdf:RDF xmlns:rdf="{RDF}">\n', "\n", "\n</rdf:RDF>")
    elif kind == "jsonld":
        out = _documents(df, to_json_nodes(df), per_document, '{"@graph": [\n', ",\n", "\n]}")
    else:
        raise RdfSyntaxError(f"writing {kind} isn't supported")
    if "document" in out.columns:
        # a document is one row
        out.write.option("compression", compression).partitionBy("document").text(path)
    else:
        # lines are read by line, Turtle by whole files
        out.write.option("compression", compression).option("maxRecordsPerFile", per_document if kind == "turtle" else 0).text(path)


def to_turtle(df: DataFrame, prefixes: dict[str, str] | None = None, most: int = 100_000) -> str:
    """Turtle text of a graph of at most `most` triples."""
    from .turtle import serialize

    rows = df.select("s", "p", "o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} triples; use write_rdf")
    return serialize(((r.s, r.p, Term(r.o.k, r.o.lex, r.o.dt, r.o.lang)) for r in rows), prefixes)
