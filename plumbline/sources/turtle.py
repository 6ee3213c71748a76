"""Turtle, TriG, N-Triples and N-Quads by one recursive-descent parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from ..terms import RDF, XSD, Term, bnode, iri, literal

BASE = "http://example.org"

TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<double>[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)[eE][+-]?[0-9]+)
    |(?P<decimal>[+-]?[0-9]*\.[0-9]+)
    |(?P<integer>[+-]?[0-9]+)
    |(?P<bnode>_:[\w0-9](?:[\w.\-·]*[\w\-·])?)
    |(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>\^\^|[.;,()\[\]{}])""",
    re.VERBOSE | re.DOTALL,
)
#: Character escapes.
ESCAPE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

Quad = tuple[Term, str, Term, str]


class ParseError(ValueError):
    """Text that is not in the grammar; the message tells the line."""


def unescape(s: str) -> str:
    if "\\" not in s:
        return s

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "uU":
            return chr(int(c[1:], 16))
        if c not in ESCAPE:
            raise ParseError(f"unknown escape \\{c}")
        return ESCAPE[c]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.DOTALL)


class Parser:
    """Quads of one document; the graph name is empty for the default graph."""

    def __init__(self, text: str, base: str = BASE, graphs: bool = False, scope: str = "") -> None:
        self.text, self.base, self.graphs, self.scope = text, base, graphs, scope
        self.prefixes: dict[str, str] = {}
        self.out: list[Quad] = []
        self.graph = ""
        self._fresh = 0
        self._tokens = self._lex()
        self._next()

    def _lex(self) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(self.text):
            m = TOKEN.match(self.text, at)
            if not m:
                raise self._error(f"unexpected {self.text[at : at + 20]!r}", at)
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], m.start()
        yield "end", "", len(self.text)

    def _error(self, what: str, at: int | None = None) -> ParseError:
        line = self.text.count("\n", 0, self.at if at is None else at) + 1
        return ParseError(f"line {line}: {what}")

    def _next(self) -> None:
        self.kind, self.value, self.at = next(self._tokens)

    def _take(self, sign: str) -> None:
        if self.value != sign:
            raise self._error(f"expected {sign!r}, found {self.value!r}")
        self._next()

    def _is(self, *signs: str) -> bool:
        return self.kind in ("sign", "word") and self.value in signs

    def _blank(self) -> Term:
        self._fresh += 1
        return bnode(f"{self.scope}g{self._fresh}")

    def _emit(self, s: Term, p: str, o: Term) -> None:
        self.out.append((s, p, o, self.graph))

    def parse(self) -> list[Quad]:
        while self.kind != "end":
            self._statement()
        return self.out

    def _statement(self) -> None:
        word = self.value.lower() if self.kind in ("word", "lang") else ""
        if word in ("@prefix", "prefix", "@base", "base"):
            self._next()
            if "prefix" in word:
                if self.kind != "name" or not self.value.endswith(":"):
                    raise self._error(f"expected a prefix, found {self.value!r}")
                prefix = self.value[:-1]
                self._next()
                self.prefixes[prefix] = self._iri()
            else:
                self.base = self._iri()
            if word[0] == "@":
                self._take(".")
            return
        if self.graphs and (word == "graph" or self.value == "{"):
            if word == "graph":
                self._next()
                self._block(self._subject().lex)
            else:
                self._block("")
            return
        if self.value == "[":
            s = self._property_list()
            if self.graphs and self.value == "{":
                self._block(s.lex)
                return
            if not self._is("."):
                self._predicates(s)
        else:
            s = self._subject()
            if self.graphs and self.value == "{":
                self._block(s.lex)
                return
            self._predicates(s)
        self._take(".")

    def _block(self, name: str) -> None:
        self._take("{")
        self.graph, before = name, self.graph
        while self.value != "}":
            if self.value == "[":
                s = self._property_list()
                if not self._is(".", "}"):
                    self._predicates(s)
            else:
                self._predicates(self._subject())
            if self.value != "}":
                self._take(".")
        self.graph = before
        self._next()

    def _iri(self) -> str:
        if self.kind == "iri":
            x = unescape(self.value[1:-1])
            self._next()
            return x if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", x) else self._resolve(x)
        if self.kind == "name":
            prefix, _, local = self.value.partition(":")
            if prefix not in self.prefixes:
                raise self._error(f"unknown prefix {prefix!r}")
            self._next()
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise self._error(f"expected an IRI, found {self.value!r}")

    def _resolve(self, x: str) -> str:
        return self.base if not x else urljoin(self.base, x) if "://" in self.base else self.base + x

    def _subject(self) -> Term:
        if self.kind == "bnode":
            return self._label()
        if self.value == "(":
            return self._list()
        return iri(self._iri())

    def _label(self) -> Term:
        x = self.value[2:]
        self._next()
        return bnode(f"{self.scope}{x}" if self.scope or not x.startswith("g") else f"_{x}")

    def _predicates(self, s: Term) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                p = RDF + "type"
                self._next()
            else:
                p = self._iri()
            while True:
                self._emit(s, p, self._object())
                if not self._is(","):
                    break
                self._next()
            if not self._is(";"):
                return
            while self._is(";"):
                self._next()
            if self._is(".", "]", "}"):
                return

    def _property_list(self) -> Term:
        self._take("[")
        s = self._blank()
        if not self._is("]"):
            self._predicates(s)
        self._take("]")
        return s

    def _list(self) -> Term:
        self._take("(")
        items = []
        while not self._is(")"):
            items.append(self._object())
        self._next()
        head = iri(RDF + "nil")
        for x in reversed(items):
            cell = self._blank()
            self._emit(cell, RDF + "first", x)
            self._emit(cell, RDF + "rest", head)
            head = cell
        return head

    def _object(self) -> Term:
        if self.kind in ("text", "long"):
            n = 3 if self.kind == "long" else 1
            x = unescape(self.value[n:-n])
            self._next()
            if self.kind == "lang":
                tag = self.value[1:]
                self._next()
                return literal(x, "", tag)
            if self._is("^^"):
                self._next()
                return literal(x, self._iri())
            return literal(x)
        if self.kind in ("integer", "decimal", "double"):
            x = literal(self.value, XSD + self.kind)
            self._next()
            return x
        if self.kind == "word" and self.value in ("true", "false"):
            x = literal(self.value, XSD + "boolean")
            self._next()
            return x
        if self.value == "[":
            return self._property_list()
        return self._subject()


LINE = re.compile(
    r"""^\s*(?P<s><[^<>"{}|^`\\\x00-\x20]*>|_:[^\s<"]+)\s*(?P<p><[^<>"{}|^`\\\x00-\x20]*>)\s*"""
    r"""(?P<o><[^<>"{}|^`\\\x00-\x20]*>|_:[^\s<"]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?)"""
    r"""\s*(?P<g><[^<>"{}|^`\\\x00-\x20]*>|_:[^\s<"]+)?\s*\.\s*(?:\#.*)?$"""
)


def parse(text: str, fmt: str, base: str = BASE, scope: str = "") -> list[Quad]:
    """Quads of a text in ``ttl``, ``trig``, ``nt`` or ``nq``; raises ParseError."""
    if fmt in ("nt", "nq"):
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip() and not line.lstrip().startswith("#"):
                m = LINE.match(line)
                if not m or (fmt == "nt" and m["g"]):
                    raise ParseError(f"line {n}: no {'triple' if fmt == 'nt' else 'quad'}: {line[:60]!r}")
        if fmt == "nq":
            return [q for line in text.splitlines() if (q := _quad(line, base, scope))]
    return Parser(text, base, graphs=fmt == "trig", scope=scope).parse()


def _quad(line: str, base: str, scope: str) -> Quad | None:
    m = LINE.match(line)
    if not m:
        return None
    s, p, o, _ = Parser(f"{m['s']} {m['p']} {m['o']} .", base, scope=scope).parse()[0]
    g = (m["g"] or "").strip("<>")
    return s, p, o, g
