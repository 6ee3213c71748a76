"""RDF/XML: node and property elements, collections, containers, literals and reification-free attributes."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from ..terms import RDF, Term, bnode, iri, literal
from .turtle import BASE, ParseError, Quad

XML = "{http://www.w3.org/XML/1998/namespace}"
R = "{" + RDF + "}"
#: Attributes that are syntax, not properties.
SYNTAX = {R + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "li")} | {XML + "lang", XML + "base"}


class _Reader:
    def __init__(self, base: str, scope: str) -> None:
        self.base, self.scope, self.fresh, self.out = base, scope, 0, []

    def blank(self, label: str | None = None) -> Term:
        self.fresh += label is None
        return bnode(f"{self.scope}{label}" if label is not None else f"{self.scope}x{self.fresh}")

    def name(self, tag: str) -> str:
        if not tag.startswith("{"):
            raise ParseError(f"element without a namespace: {tag}")
        return tag[1:].replace("}", "")

    def node(self, e: ET.Element, lang: str, base: str) -> Term:
        lang, base = e.get(XML + "lang", lang), e.get(XML + "base", base)
        if R + "about" in e.attrib:
            s = iri(urljoin(base, e.get(R + "about")) or base)
        elif R + "ID" in e.attrib:
            s = iri(urljoin(base, "#" + e.get(R + "ID")))
        else:
            s = self.blank(e.get(R + "nodeID"))
        if e.tag != R + "Description":
            self.out.append((s, RDF + "type", iri(self.name(e.tag)), ""))
        for k, v in e.attrib.items():
            if k == R + "type":
                self.out.append((s, RDF + "type", iri(urljoin(base, v)), ""))
            elif k not in SYNTAX and k.startswith("{"):
                self.out.append((s, self.name(k), literal(v, "", lang), ""))
        number = 0
        for child in e:
            p = self.name(child.tag)
            if p == RDF + "li":
                number += 1
                p = f"{RDF}_{number}"
            self.out.append((s, p, self.value(child, lang, base), ""))
        return s

    def value(self, e: ET.Element, lang: str, base: str) -> Term:
        lang, base = e.get(XML + "lang", lang), e.get(XML + "base", base)
        kind = e.get(R + "parseType")
        if kind == "Resource":
            s = self.blank()
            for child in e:
                self.out.append((s, self.name(child.tag), self.value(child, lang, base), ""))
            return s
        if kind == "Collection":
            head = iri(RDF + "nil")
            for item in reversed([self.node(c, lang, base) for c in e]):
                cell = self.blank()
                self.out += [(cell, RDF + "first", item, ""), (cell, RDF + "rest", head, "")]
                head = cell
            return head
        if kind == "Literal":
            text = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            return literal(text, RDF + "XMLLiteral")
        if R + "resource" in e.attrib:
            return iri(urljoin(base, e.get(R + "resource")) or base)
        if R + "nodeID" in e.attrib:
            return self.blank(e.get(R + "nodeID"))
        if len(e):
            return self.node(e[0], lang, base)
        extra = {k: v for k, v in e.attrib.items() if k not in SYNTAX and k.startswith("{")}
        if extra:
            s = self.blank()
            self.out += [(s, self.name(k), literal(v, "", lang), "") for k, v in extra.items()]
            return s
        return literal(e.text or "", e.get(R + "datatype", ""), "" if R + "datatype" in e.attrib else lang)


def parse(text: str, base: str = BASE, scope: str = "") -> list[Quad]:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ParseError(str(e)) from e
    r = _Reader(root.get(XML + "base", base), scope)
    for e in root if root.tag == R + "RDF" else [root]:
        r.node(e, root.get(XML + "lang", ""), r.base)
    return r.out
