"""SPARQL 1.1 text to queries of all four forms, with paths, filters, options, unions, graphs, values and aggregates."""

from __future__ import annotations

import re
from dataclasses import replace

from ..plans.ir import Alternative, Closure, Inverse, Negated, Path, Predicate, Sequence
from ..sources.turtle import unescape
from ..terms import RDF, XSD, Term, iri, literal
from .ast import Bind, Call, Filter, Group, InGraph, Lateral, Minus, Optional, Query, Service, SubSelect, Triple, Union, Values, Var, walk

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\r\n]*)
    |(?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
    |(?P<var>[?$]\w+)
    |(?P<text>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<bnode>_:[\w][\w.\-]*)
    |(?P<name>(?:[^\W\d_][\w.\-]*)?:(?:[\w:%\-]|\.(?=[\w:%\-])|\\.)*)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<sign>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,|/^*+?!=<>\-])""",
    re.VERBOSE | re.DOTALL,
)
AGGREGATES = ("count", "sum", "avg", "min", "max", "sample", "group_concat")


class QueryError(ValueError):
    """Text that is not in the grammar, or a query that isn't allowed here."""


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, path: Path | None = None) -> None:
        self.prefixes, self.path, self.base = dict(prefixes or {}), path, ""
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.append(("end", ""))
        self.i, self.fresh = 0, 0

    # tokens -----------------------------------------------------------------------------------------------------

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def next(self) -> str:
        v = self.value
        self.i += 1
        return v

    def word(self, *words: str) -> bool:
        """Whether the next token is one of the keywords; takes it if so."""
        if self.kind == "word" and self.value.lower() in words:
            self.i += 1
            return True
        return False

    def at_word(self, *words: str) -> bool:
        return self.kind == "word" and self.value.lower() in words

    def sign(self, s: str) -> bool:
        if self.kind == "sign" and self.value == s:
            self.i += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.sign(s):
            raise QueryError(f"expected {s!r}, found {self.value!r}")

    def var(self) -> str:
        if self.kind != "var":
            raise QueryError(f"expected a variable, found {self.value!r}")
        return self.next()[1:]

    # queries ----------------------------------------------------------------------------------------------------

    def query(self) -> Query:
        while self.at_word("prefix", "base"):
            if self.next().lower() == "base":
                self.base = self.next()[1:-1]
            else:
                p = self.next()
                self.prefixes[p[:-1]] = self.next()[1:-1]
        forms = {"select": self.select, "construct": self.construct, "describe": self.describe}
        q = forms.get(self.value.lower(), self.ask)()
        if self.word("values"):
            q = replace(q, where=Group((*q.where.parts, self.values())))
        if self.kind != "end":
            raise QueryError(f"unexpected {self.value!r} after the query")
        return q

    def ask(self) -> Query:
        if not self.word("ask"):
            raise QueryError(f"none of SELECT, ASK, CONSTRUCT and DESCRIBE: {self.value!r}")
        self.word("where")
        return self.modifiers(Query(self.group()))

    def construct(self) -> Query:
        self.word("construct")
        if self.word("where"):  # the short form: the pattern is the template
            where = self.group()
            if not all(isinstance(p, Triple) for p in where.parts):
                raise QueryError("CONSTRUCT WHERE takes triples only")
            template = where
        else:
            template = self.group()
            self.word("where")
            where = self.group()
        if not all(isinstance(p, Triple) and isinstance(p.p, (Var, Predicate)) for p in template.parts):
            raise QueryError("a template takes triples only")
        return self.modifiers(Query(where, (), star=True, construct=tuple(template.parts)))

    def describe(self) -> Query:
        self.word("describe")
        nodes: list = []
        star = self.sign("*")
        while not star and self.kind in ("var", "iri", "name"):
            nodes.append(self.node())
        where = self.group() if self.word("where") or self.value == "{" else Group()
        if star:
            nodes = sorted((Var(n) for n in _named(where)), key=lambda v: v.name)
        return self.modifiers(Query(where, (), star=True, describe=tuple(nodes)))

    def select(self) -> Query:
        self.word("select")
        distinct = self.word("distinct", "reduced")
        columns: list = []
        star = False
        while True:
            if self.sign("*"):
                star = True
            elif self.kind == "var":
                v = self.var()
                columns.append((v, Var(v)))
            elif self.sign("("):
                e = self.expression()
                if not self.word("as"):
                    raise QueryError("expected AS")
                columns.append((self.var(), e))
                self.need(")")
            else:
                break
        self.word("where")
        return self.modifiers(Query(self.group(), tuple(columns), distinct, star=star))

    def modifiers(self, q: Query) -> Query:
        if self.word("group"):
            self.word("by")
            keys = []
            while self.kind == "var" or self.value == "(" or (self.kind in ("word", "name", "iri") and not self.at_word("having", "order", "limit", "offset")):
                if self.sign("("):
                    e = self.expression()
                    keys.append((self.var() if self.word("as") else f"_k{len(keys)}", e))
                    self.need(")")
                else:
                    e = self.primary()
                    keys.append((e.name if isinstance(e, Var) else f"_k{len(keys)}", e))
            q = replace(q, group_by=tuple(keys))
        if self.word("having"):
            tests = []
            while self.value == "(":
                tests.append(self.primary())
            q = replace(q, having=tuple(tests))
        if self.word("order"):
            self.word("by")
            keys = []
            while True:
                if self.at_word("asc", "desc"):
                    down = self.next().lower() == "desc"
                    keys.append((self.primary(), down))
                elif self.kind == "var" or self.value == "(":
                    keys.append((self.primary(), False))
                else:
                    break
            q = replace(q, order_by=tuple(keys))
        while self.at_word("limit", "offset"):
            k = self.next().lower()
            q = replace(q, **{k: int(self.next())})
        return q

    # groups -----------------------------------------------------------------------------------------------------

    def group(self) -> Group:
        self.need("{")
        if self.at_word("select"):
            q = self.select()
            self.need("}")
            return Group((SubSelect(q),))
        parts: list = []
        while not self.sign("}"):
            if self.word("filter"):
                parts.append(Filter(self.constraint()))
            elif self.word("optional"):
                parts.append(Optional(self.group()))
            elif self.word("lateral"):
                parts.append(Lateral(self.group()))
            elif self.word("minus"):
                parts.append(Minus(self.group()))
            elif self.word("service"):
                self.word("silent")
                self.node()
                parts.append(Service(self.group()))
            elif self.word("graph"):
                name = self.node()
                parts.append(InGraph(name, self.group()))
            elif self.word("bind"):
                self.need("(")
                e = self.expression()
                if not self.word("as"):
                    raise QueryError("expected AS")
                parts.append(Bind(e, self.var()))
                self.need(")")
            elif self.word("values"):
                parts.append(self.values())
            elif self.value == "{":
                groups = [self.group()]
                while self.word("union"):
                    groups.append(self.group())
                parts.append(groups[0] if len(groups) == 1 else Union(tuple(groups)))
            elif self.sign("."):
                continue
            else:
                self.triples(parts)
        return Group(tuple(parts))

    def constraint(self):
        if self.word("exists"):
            return Call("exists", (self.group(),))
        if self.at_word("not") and self.tokens[self.i + 1][1].lower() == "exists":
            self.i += 2
            return Call("not exists", (self.group(),))
        return self.primary()

    def values(self) -> Values:
        rows: list = []
        if self.kind == "var":
            names = [self.var()]
            self.need("{")
            while not self.sign("}"):
                rows.append((None if self.word("undef") else self.node(),))
        else:
            names = []
            self.need("(")
            while not self.sign(")"):
                names.append(self.var())
            self.need("{")
            while not self.sign("}"):
                self.need("(")
                row = []
                while not self.sign(")"):
                    row.append(None if self.word("undef") else self.node())
                rows.append(tuple(row))
        return Values(tuple(names), tuple(rows))

    def triples(self, parts: list) -> None:
        s = self.node(parts)
        if self.value in (".", "}") and isinstance(s, Var):
            return
        while True:
            p = Var(self.var()) if self.kind == "var" else self.alternative()
            if isinstance(p, Var) and p.name == "PATH":
                if self.path is None:
                    raise QueryError("$PATH outside a property shape")
                p = self.path
            while True:
                parts.append(Triple(s, p, self.node(parts)))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                return
            while self.sign(";"):
                pass
            if self.value in (".", "}", "]"):
                return

    def node(self, parts: list | None = None):
        if self.kind == "var":
            return Var(self.var())
        if self.kind == "bnode":
            return Var("_b_" + self.next()[2:])
        if parts is not None and self.sign("["):
            self.fresh += 1
            v = Var(f"_a_{self.fresh}")
            if not self.sign("]"):
                inner: list = []
                self.tokens.insert(self.i, ("var", f"?{v.name}"))
                self.triples(inner)
                parts += inner
                self.need("]")
            return v
        if parts is not None and self.sign("("):
            items = []
            while not self.sign(")"):
                items.append(self.node(parts))
            head: object = iri(RDF + "nil")
            for x in reversed(items):
                self.fresh += 1
                cell = Var(f"_a_{self.fresh}")
                parts += [Triple(cell, Predicate(RDF + "first"), x), Triple(cell, Predicate(RDF + "rest"), head)]
                head = cell
            return head
        return self.constant()

    def constant(self) -> Term:
        if self.kind in ("iri", "name"):
            return iri(self.iri())
        if self.kind == "text":
            raw = self.next()
            n = 3 if raw[:3] in ('"""', "'''") else 1
            x = unescape(raw[n:-n])
            if self.kind == "lang":
                return literal(x, "", self.next()[1:])
            return literal(x, self.iri()) if self.sign("^^") else literal(x)
        sign = self.next() if self.value in ("+", "-") and self.kind == "sign" else ""
        if self.kind == "number":
            x = sign + self.next()
            return literal(x, XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"))
        if self.at_word("true", "false"):
            return literal(self.next().lower(), XSD + "boolean")
        raise QueryError(f"unexpected {self.value!r}")

    def iri(self) -> str:
        if self.kind == "iri":
            return self.base + self.next()[1:-1] if ":" not in self.value else self.next()[1:-1]
        if self.kind != "name":
            raise QueryError(f"expected an IRI, found {self.value!r}")
        p, _, local = self.next().partition(":")
        if p not in self.prefixes:
            raise QueryError(f"unknown prefix {p!r}")
        return self.prefixes[p] + re.sub(r"\\(.)", r"\1", local)

    # paths ------------------------------------------------------------------------------------------------------

    def alternative(self) -> Path:
        parts = [self.sequence()]
        while self.sign("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Alternative(tuple(parts))

    def sequence(self) -> Path:
        parts = [self.step()]
        while self.sign("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else Sequence(tuple(parts))

    def step(self) -> Path:
        if self.sign("^"):
            return Inverse(self.step())
        if self.sign("!"):
            forward, backward = [], []
            some = self.sign("(")
            while True:
                back = self.sign("^")
                (backward if back else forward).append(RDF + "type" if self.word("a") else self.iri())
                if not (some and self.sign("|")):
                    break
            if some:
                self.need(")")
            return Negated(tuple(forward), tuple(backward))
        if self.sign("("):
            p = self.alternative()
            self.need(")")
        elif self.word("a"):
            p = Predicate(RDF + "type")
        else:
            p = Predicate(self.iri())
        if self.kind == "sign" and self.value in "*+?":
            s = self.next()
            return Closure(p, int(s == "+"), s != "?")
        return p

    # expressions ------------------------------------------------------------------------------------------------

    def expression(self):
        e = self.conjunction()
        while self.sign("||"):
            e = Call("||", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.relation()
        while self.sign("&&"):
            e = Call("&&", (e, self.relation()))
        return e

    def relation(self):
        e = self.sum()
        for s in ("=", "!=", "<=", ">=", "<", ">"):
            if self.sign(s):
                return Call(s, (e, self.sum()))
        negative = self.at_word("not") and self.tokens[self.i + 1][1].lower() == "in"
        if negative:
            self.i += 1
        if self.word("in"):
            self.need("(")
            items = []
            while not self.sign(")"):
                items.append(self.expression())
                self.sign(",")
            return Call("not in" if negative else "in", (e, *items))
        return e

    def sum(self):
        e = self.product()
        while self.value in ("+", "-") and self.kind == "sign":
            e = Call(self.next(), (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while self.value in ("*", "/") and self.kind == "sign":
            e = Call(self.next(), (e, self.unary()))
        return e

    def unary(self):
        if self.sign("!"):
            return Call("!", (self.unary(),))
        if self.value == "-" and self.kind == "sign" and self.tokens[self.i + 1][0] != "number":
            self.next()
            return Call("-", (literal("0", XSD + "integer"), self.unary()))
        return self.primary()

    def primary(self):
        if self.sign("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind == "var":
            return Var(self.var())
        if self.at_word("exists", "not"):
            return self.constraint()
        if self.kind == "word" and not self.at_word("true", "false"):
            return self.call(self.next().lower())
        if self.kind in ("iri", "name"):
            x = self.iri()
            return self.call(x) if self.value == "(" else iri(x)
        return self.constant()

    def call(self, name: str):
        self.need("(")
        distinct = self.word("distinct")
        if name in AGGREGATES and self.sign("*"):
            self.need(")")
            return Call(name, (), distinct)
        args, separator = [], " "
        while not self.sign(")"):
            if self.sign(";"):
                self.word("separator")
                self.need("=")
                separator = self.constant().lex
                continue
            args.append(self.expression())
            self.sign(",")
        return Call(name, tuple(args), distinct, separator)


def _named(group: Group) -> set[str]:
    """The variables of the group's triples that have a name."""
    triples = [p for p in walk(group) if isinstance(p, Triple)]
    return {x.name for t in triples for x in (t.s, t.p, t.o) if isinstance(x, Var) and not x.name.startswith("_")}


def parse_query(text: str, prefixes: dict[str, str] | None = None, path: Path | None = None) -> Query:
    return Parser(text, prefixes, path).query()


