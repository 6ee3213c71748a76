"""JSON-LD with inline contexts: terms, prefixes, types, languages, lists, sets, reverse and named graphs."""

from __future__ import annotations

import json
from urllib.parse import urljoin

from ..terms import RDF, XSD, Term, bnode, iri, literal
from .turtle import BASE, ParseError, Quad


class _Reader:
    def __init__(self, base: str, scope: str) -> None:
        self.base, self.scope, self.fresh, self.out = base, scope, 0, []

    def blank(self) -> Term:
        self.fresh += 1
        return bnode(f"{self.scope}j{self.fresh}")

    def context(self, old: dict, new) -> dict:
        for c in new if isinstance(new, list) else [new]:
            if c is None:
                old = {}
            elif isinstance(c, str):
                raise ParseError(f"remote contexts are not read: {c}")
            else:
                old = {**old, **c}
        return old

    def expand(self, x: str, ctx: dict, vocab: bool = True) -> str:
        if x.startswith("@") or x.startswith("_:"):
            return x
        if vocab and x in ctx:
            d = ctx[x]
            d = d.get("@id", x) if isinstance(d, dict) else d
            if d is None or d.startswith("@"):
                return d
            if d != x:
                return self.expand(d, ctx, True)
        head, sep, rest = x.partition(":")
        if sep and not rest.startswith("//") and head in ctx:
            d = ctx[head]
            return self.expand(d.get("@id") if isinstance(d, dict) else d, {k: v for k, v in ctx.items() if k != head}) + rest
        if sep:
            return x
        if vocab:
            return ctx["@vocab"] + x if ctx.get("@vocab") else x
        return urljoin(ctx.get("@base", self.base), x)

    def ref(self, x: str, ctx: dict, vocab: bool = False) -> Term:
        x = self.expand(x, ctx, vocab)
        return bnode(self.scope + x[2:]) if x.startswith("_:") else iri(x)

    def key(self, k: str, ctx: dict) -> str:
        return self.expand(k, ctx) or k

    def node(self, o: dict, ctx: dict, graph: str) -> Term:
        if "@context" in o:
            ctx = self.context(ctx, o["@context"])
        names = {self.key(k, ctx): k for k in o}
        s = self.ref(o[names["@id"]], ctx) if "@id" in names else self.blank()
        for k, v in o.items():
            p = self.key(k, ctx)
            items = v if isinstance(v, list) else [v]
            if p == "@type":
                self.out += [(s, RDF + "type", self.ref(t, ctx, True), graph) for t in items]
            elif p == "@graph":
                inner = graph if set(names) <= {"@context", "@graph"} else s.lex
                for x in items:
                    self.node(x, ctx, inner)
            elif p == "@reverse":
                for q, some in v.items():
                    for x in some if isinstance(some, list) else [some]:
                        self.out.append((self.node(x, ctx, graph) if isinstance(x, dict) else self.ref(x, ctx), self.key(q, ctx), s, graph))
            elif not p.startswith("@") and ":" in p:
                d = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
                if "@reverse" in d:
                    for x in items:
                        subject = self.node(x, ctx, graph) if isinstance(x, dict) else self.ref(x, ctx)
                        self.out.append((subject, self.expand(d["@reverse"], ctx), s, graph))
                elif d.get("@container") == "@list":
                    self.out.append((s, p, self.listed(items, d, ctx, graph), graph))
                elif d.get("@container") == "@language" and isinstance(v, dict):
                    for tag, some in v.items():
                        self.out += [(s, p, literal(x, "", tag), graph) for x in (some if isinstance(some, list) else [some])]
                else:
                    self.out += [(s, p, o2, graph) for x in items if (o2 := self.value(x, d, ctx, graph)) is not None]
        return s

    def listed(self, items: list, d: dict, ctx: dict, graph: str) -> Term:
        head = iri(RDF + "nil")
        for x in reversed([self.value(x, d, ctx, graph) for x in items]):
            cell = self.blank()
            self.out += [(cell, RDF + "first", x, graph), (cell, RDF + "rest", head, graph)]
            head = cell
        return head

    def value(self, x, d: dict, ctx: dict, graph: str) -> Term | None:
        if isinstance(x, dict):
            names = {self.key(k, ctx): k for k in x}
            if "@value" in names:
                v, t = x[names["@value"]], names.get("@type")
                return self.scalar(v, self.expand(x[t], ctx) if t else "", x.get(names.get("@language", ""), ""))
            if "@list" in names:
                inner = x[names["@list"]]
                return self.listed(inner if isinstance(inner, list) else [inner], d, ctx, graph)
            if "@set" in names:
                raise ParseError("a set inside a list of values")
            return self.node(x, ctx, graph)
        if x is None:
            return None
        kind = d.get("@type")
        if isinstance(x, str) and kind in ("@id", "@vocab"):
            return self.ref(x, ctx, kind == "@vocab")
        lang = d.get("@language", ctx.get("@language", "")) if isinstance(x, str) and not kind else ""
        return self.scalar(x, self.expand(kind, ctx) if kind else "", lang or "")

    def scalar(self, v, dt: str, lang: str) -> Term:
        if isinstance(v, bool):
            return literal(str(v).lower(), dt or XSD + "boolean")
        if isinstance(v, int):
            return literal(str(v), dt or XSD + "integer")
        if isinstance(v, float):
            return literal(str(int(v)), dt or XSD + "integer") if v.is_integer() and abs(v) < 1e21 else literal(repr(v), dt or XSD + "double")
        return literal(v, dt, lang)


def parse(text: str, base: str = BASE, scope: str = "") -> list[Quad]:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ParseError(str(e)) from e
    r = _Reader(base, scope)
    for o in data if isinstance(data, list) else [data]:
        r.node(o, {}, "")
    return r.out
