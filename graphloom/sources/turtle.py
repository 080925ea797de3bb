"""A Turtle parser for whole documents: shapes graphs on the driver, data files one document a row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from ..functions.terms import LANG_STRING, RDF, TYPE, XSD, Term


class RdfSyntaxError(ValueError):
    pass


_TOKEN = re.compile(
    r"""
    (?P<space>[\s]+|\#[^\n]*)
  | (?P<open3><<\()|(?P<close3>\)>>)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\x00-\x20]*|\\U[0-9A-Fa-f]{8}[^<>"{}|^`\\\x00-\x20]*)*>)
  | (?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
  | (?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<typed>\^\^)
  | (?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
  | (?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.[0-9]+[eE][+-]?[0-9]+|[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
  | (?P<name>(?:[A-Za-z\u00C0-\uFFFF](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<punct>[.;,\[\]()])
    """,
    re.X | re.S,
)
_END = ("end", "")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m):
        x = m[1]
        if x[0] in "uU":
            return chr(int(x[1:], 16))
        if x not in _ESCAPES:
            raise RdfSyntaxError(f"no such escape: \\{x}")
        return _ESCAPES[x]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class TokenError(RdfSyntaxError):
    """Text that is no token: there is no way on."""


def scan(text: str, pattern: re.Pattern = _TOKEN) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise TokenError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "space":
            yield m.lastgroup, m[0]
        at = m.end()


def tokens(text: str, pattern: re.Pattern = _TOKEN) -> list[tuple[str, str]]:
    return list(scan(text, pattern))


class TurtleParser:
    """statements() yields the triples (s, p, Term) of each statement, and holds no others. strict=False skips a statement that is wrong and goes on after its dot."""

    def __init__(self, text: str, base: str = "", strict: bool = True, scope: str = ""):
        self.tokens, self.at, self.base, self.strict, self.scope = scan(text), 0, base, strict, scope
        self.now = next(self.tokens, _END)
        self.prefixes: dict[str, str] = {}
        self.fresh = 0
        self.out: list[tuple[str, str, Term]] = []

    def peek(self) -> tuple[str, str]:
        return self.now

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value:
            raise RdfSyntaxError(f"expected {value!r}, found {t[1]!r}")
        self.at, self.now = self.at + 1, next(self.tokens, _END)
        return t

    def statements(self) -> Iterator[list[tuple[str, str, Term]]]:
        while self.peek()[0] != "end":
            begin, self.out = self.at, []
            try:
                self.statement()
            except RdfSyntaxError as e:
                if self.strict or isinstance(e, TokenError):
                    raise
                self.out = []
                if self.at == begin:
                    self.take()
                while self.peek()[0] != "end" and self.take()[1] != ".":
                    pass
            yield self.out

    def triples(self) -> list[tuple[str, str, Term]]:
        return [t for made in self.statements() for t in made]

    def statement(self) -> None:
        kind, value = self.peek()
        if value in ("@prefix", "@base") or (kind == "word" and value.upper() in ("PREFIX", "BASE")):
            self.take()
            if value.lower().lstrip("@") == "prefix":
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.iri(self.take()[1])
            else:
                self.base = self.iri(self.take()[1])
            if value[0] == "@":
                self.take(".")
            return
        if value == "[":
            subject = self.bnode_list()
            if self.peek()[1] != ".":
                self.predicates(subject)
        else:
            subject = self.subject()
            self.predicates(subject)
        self.take(".")

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}g{self.fresh}"

    def iri(self, token: str) -> str:
        raw = unescape(token[1:-1])
        return urljoin(self.base, raw) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", raw) else raw

    def name(self, token: str) -> str:
        prefix, _, local = token.partition(":")
        if prefix not in self.prefixes:
            raise RdfSyntaxError(f"no prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def subject(self) -> str:
        t = self.term()
        if t.k not in ("iri", "bnode"):
            raise RdfSyntaxError("a subject is an IRI or a blank node")
        return t.lex

    def predicates(self, subject: str) -> None:
        while True:
            kind, value = self.take()
            if kind == "word" and value == "a":
                p = TYPE
            elif kind == "iri":
                p = self.iri(value)
            elif kind == "name":
                p = self.name(value)
            else:
                raise RdfSyntaxError(f"{value!r} is no predicate")
            while True:
                self.out.append((subject, p, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def bnode_list(self) -> str:
        self.take("[")
        own = self.blank()
        if self.peek()[1] != "]":
            self.predicates(own)
        self.take("]")
        return own

    def term(self) -> Term:
        kind, value = self.peek()
        if value == "[":
            return Term("bnode", self.bnode_list())
        self.take()
        if kind == "iri":
            return Term("iri", self.iri(value))
        if kind == "name":
            return Term("iri", self.name(value))
        if kind == "bnode":
            return Term("bnode", f"_:{self.scope}{value[2:]}")
        if kind == "open3":
            s, p, o = self.term(), self.term() if self.peek()[1] != "a" else (self.take() and Term("iri", TYPE)), self.term()
            if self.take()[0] != "close3":
                raise RdfSyntaxError("a triple term isn't closed")
            return Term("triple", f"<<( {s} {p} {o} )>>")
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head = Term("iri", RDF + "nil")
            for item in reversed(items):
                own = self.blank()
                self.out.append((own, RDF + "first", item))
                self.out.append((own, RDF + "rest", head))
                head = Term("bnode", own)
            return head
        if kind == "number":
            return Term("literal", value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "word" and value in ("true", "false"):
            return Term("literal", value, XSD + "boolean")
        if kind in ("long", "short"):
            text = unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "at":
                return Term("literal", text, LANG_STRING, self.take()[1][1:].lower())
            if self.peek()[0] == "typed":
                self.take()
                kind, value = self.take()
                return Term("literal", text, self.iri(value) if kind == "iri" else self.name(value))
            return Term("literal", text, XSD + "string")
        raise RdfSyntaxError(f"{value!r} is no term")


def parse(text: str, base: str = "", strict: bool = True, scope: str = "") -> tuple[list[tuple[str, str, Term]], dict[str, str]]:
    """Triples and prefixes of a Turtle document."""
    p = TurtleParser(text, base, strict, scope)
    return p.triples(), p.prefixes


def serialize(triples: Iterator[tuple[str, str, Term]], prefixes: dict[str, str] | None = None) -> str:
    """Turtle, grouped by subject."""
    prefixes = prefixes or {}
    longest = sorted(prefixes.items(), key=lambda x: -len(x[1]))

    def short(lex: str) -> str:
        for name, full in longest:
            if lex.startswith(full) and re.fullmatch(r"[A-Za-z_]\w*", lex[len(full) :]):
                return f"{name}:{lex[len(full) :]}"
        return lex if lex.startswith("_:") else f"<{lex}>"

    by: dict[str, list[str]] = {}
    for s, p, o in triples:
        by.setdefault(s, []).append(f"{'a' if p == TYPE else short(p)} {short(o.lex) if o.k == 'iri' else o}")
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in prefixes.items())
    return head + "".join(f"{short(s)} " + " ;\n    ".join(sorted(set(arcs))) + " .\n" for s, arcs in sorted(by.items()))
