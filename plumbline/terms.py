"""RDF terms: a Python value for shapes, and a struct column for data.

A term column is ``struct<kind, lex, dt, lang, num>``; ``kind`` is ``iri``, ``bnode`` or ``literal``, absent parts are
empty strings, and ``num`` is the number that a literal's text spells, if any. It follows from the other parts, so
terms are equal if the first four are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SH = "http://www.w3.org/ns/shacl#"
OWL = "http://www.w3.org/2002/07/owl#"
STRING, LANG_STRING = XSD + "string", RDF + "langString"

TERM = "struct<kind:string,lex:string,dt:string,lang:string,num:double>"
PARTS = ("kind", "lex", "dt", "lang")
#: What spells a number, as a double.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"


@dataclass(frozen=True, order=True)
class Term:
    """One RDF term. ``lex`` is the IRI, the blank node's label or the literal's text."""

    kind: str
    lex: str
    dt: str = ""
    lang: str = ""

    @property
    def is_literal(self) -> bool:
        return self.kind == "literal"

    @property
    def num(self) -> float | None:
        if not self.is_literal or not re.match(NUMBER, self.lex):
            return None
        return float(self.lex)

    def __str__(self) -> str:
        if self.kind == "iri":
            return f"<{self.lex}>"
        if self.kind == "bnode":
            return f"_:{self.lex}"
        text = '"' + "".join(ESCAPES.get(c, c) for c in self.lex) + '"'
        if self.lang:
            return f"{text}@{self.lang}"
        return text if self.dt in ("", STRING) else f"{text}^^<{self.dt}>"

    def column(self) -> Column:
        return make(self.kind, F.lit(self.lex), F.lit(self.dt), F.lit(self.lang), F.lit(self.num).cast("double"))


#: Characters that N-Triples escapes in literals.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def iri(x: str) -> Term:
    return Term("iri", x)


def bnode(x: str) -> Term:
    return Term("bnode", x)


def literal(x: str, dt: str = "", lang: str = "") -> Term:
    """A literal; without a datatype a string, and with a language a language string. Tags are lower case."""
    return Term("literal", x, LANG_STRING if lang else dt or STRING, lang.lower())


def make(kind: str | Column, lex: Column, dt: Column | None = None, lang: Column | None = None, num: Column | None = None) -> Column:
    """A term column of parts."""
    none = F.lit("")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        lex.alias("lex"),
        (none if dt is None else dt).alias("dt"),
        (none if lang is None else lang).alias("lang"),
        (F.lit(None).cast("double") if num is None else num).alias("num"),
    )


def iri_column(lex: Column) -> Column:
    return make("iri", lex)


def number_of(lex: Column) -> Column:
    """The double that a text spells in the plain grammar, else null: no suffixes, no surrounding blanks."""
    return F.when(lex.rlike(NUMBER), lex.try_cast("double"))


def literal_column(lex: Column, dt: str = STRING, lang: Column | None = None, num: Column | None = None) -> Column:
    """A literal of a text column. ``num``: its number, where the caller has it."""
    if lang is not None:
        return make("literal", lex, F.lit(LANG_STRING), F.lower(lang), number_of(lex))
    return make("literal", lex, F.lit(dt), None, number_of(lex) if num is None else num)


def same(a: Column, b: Column) -> Column:
    """Equality of terms, part by part, so that it serves as an equi-join and constant parts fold away."""
    out = a["kind"] == b["kind"]
    for p in PARTS[1:]:
        out = out & (a[p] == b[p])
    return out


def is_term(a: Column, t: Term) -> Column:
    out = (a["kind"] == t.kind) & (a["lex"] == t.lex)
    return out & (a["dt"] == t.dt) & (a["lang"] == t.lang) if t.is_literal else out


def in_terms(a: Column, terms: list[Term]) -> Column:
    """Membership in a constant list, as one set look-up for each kind."""
    if not terms:
        return F.lit(False)
    key = lambda k, x, d, g: F.concat_ws("\x00", k, x, d, g)
    return key(a["kind"], a["lex"], a["dt"], a["lang"]).isin(["\x00".join((t.kind, t.lex, t.dt, t.lang)) for t in terms])


def text_of(a: Column) -> Column:
    """The canonical N-Triples text; null for null."""
    escaped = a["lex"]
    for c, e in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(e))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    return (
        F.when(a["kind"] == "iri", F.concat(F.lit("<"), a["lex"], F.lit(">")))
        .when(a["kind"] == "bnode", F.concat(F.lit("_:"), a["lex"]))
        .when(a["lang"] != "", F.concat(quoted, F.lit("@"), a["lang"]))
        .when(a["dt"].isin("", STRING), quoted)
        .otherwise(F.concat(quoted, F.lit("^^<"), a["dt"], F.lit(">")))
    )
