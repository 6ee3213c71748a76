"""SPARQL expressions as columns. A null is an error or an unbound variable; in a filter it counts as false."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..terms import RDF, XSD, Term, make, number_of, same
from .ast import Call, Var
from .parser import QueryError

BOOLEAN, INTEGER, DECIMAL, DOUBLE, STRING = (XSD + x for x in ("boolean", "integer", "decimal", "double", "string"))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, so that nested expressions don't multiply."""
    return F.transform(F.array(c), f)[0]


def boolean(c: Column) -> Column:
    return let(c, _boolean)


def number(c: Column, dt: Column | str = DOUBLE) -> Column:
    return let(c, lambda x: _number(x, dt))


def text(c: Column, like: Column | None = None) -> Column:
    """A string; with ``like`` it keeps that literal's language."""
    return let(c, lambda x: _text(x, like))


def _boolean(c: Column) -> Column:
    return F.when(c.isNotNull(), make("literal", F.when(c, "true").otherwise("false"), F.lit(BOOLEAN)))


def _number(c: Column, dt: Column | str) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    text = F.when(whole, F.floor(c).cast("string")).otherwise(c.cast("string"))
    kind = F.when(whole, F.lit(INTEGER)).otherwise(F.lit(DOUBLE)) if dt == DOUBLE else F.lit(dt)
    return F.when(c.isNotNull(), make("literal", text, kind, None, c.cast("double")))


def _text(c: Column, like: Column | None) -> Column:
    lang = F.lit("") if like is None else like["lang"]
    dt = F.when(lang != "", F.lit(RDF + "langString")).otherwise(F.lit(STRING))
    return F.when(c.isNotNull(), make("literal", c, dt, lang, number_of(c)))


class Expressions:
    """Compiles expressions over columns of variables; ``column`` gives a variable's, or None."""

    def __init__(self, column: Callable[[str], Column | None]) -> None:
        self.column = column

    def term(self, e) -> Column:
        """The value as a term."""
        if isinstance(e, Term):
            return e.column()
        if isinstance(e, Var):
            c = self.column(e.name)
            return F.lit(None).cast(TERM_TYPE) if c is None else c
        if e.name in TESTS or e.name in ("&&", "||", "!", "=", "!=", "<", ">", "<=", ">=", "in", "not in", "bound"):
            return boolean(self.test(e))
        if e.name in ("+", "-", "*", "/"):
            return number(self.num(e))
        if e.name == "coalesce":
            return F.coalesce(*(self.term(x) for x in e.args))
        if e.name == "if":
            t = self.test(e.args[0])
            return F.when(t, self.term(e.args[1])).when(~t, self.term(e.args[2]))
        if e.name.startswith(XSD):
            return self.cast(e)
        if e.name == "bnode" and not e.args:
            return make("bnode", F.replace(F.uuid(), F.lit("-"), F.lit("")))
        fn = VALUES.get(e.name)
        if fn is None:
            raise QueryError(f"unknown function: {e.name}")
        return fn(*(self.term(x) for x in e.args))

    def cast(self, e: Call) -> Column:
        a, kind = self.term(e.args[0]), e.name
        if kind == STRING:
            return text(a["lex"])
        if kind == BOOLEAN:
            return boolean(F.when(a["lex"].isin("true", "1"), True).when(a["lex"].isin("false", "0"), False))
        if kind in (INTEGER, DECIMAL, DOUBLE, XSD + "float"):
            n = F.when(a["dt"] == BOOLEAN, (a["lex"] == "true").cast("double")).otherwise(a["num"])
            return number(F.floor(n).cast("double") if kind == INTEGER else n, kind)
        return F.when(a["kind"] == "literal", make("literal", a["lex"], F.lit(kind), None, a["num"]))

    def num(self, e) -> Column:
        """The number of a numeric literal, else null."""
        if isinstance(e, Call) and e.name in ("+", "-", "*", "/"):
            a, b = (self.num(x) for x in e.args)
            plain = {"+": a + b, "-": a - b, "*": a * b}.get(e.name)
            return let(b, lambda d: F.when(d != 0, a / F.when(d != 0, d))) if plain is None else plain
        t = self.term(e)
        return F.when(t["dt"].isin(*V.NUMERIC_TYPES), t["num"])

    def test(self, e) -> Column:
        """The effective boolean value, null for an error."""
        if isinstance(e, Call):
            if e.name == "&&":
                return self.test(e.args[0]) & self.test(e.args[1])
            if e.name == "||":
                return self.test(e.args[0]) | self.test(e.args[1])
            if e.name == "!":
                return ~self.test(e.args[0])
            if e.name == "bound":
                c = self.column(e.args[0].name)
                return F.lit(False) if c is None else c.isNotNull()
            if e.name in ("=", "!="):
                return self.equal(*e.args) if e.name == "=" else ~self.equal(*e.args)
            if e.name in ("<", ">", "<=", ">="):
                a, b = (self.term(x) for x in e.args)
                return F.when(a.isNotNull() & b.isNotNull(), V.compare(a, b, e.name))
            if e.name in ("in", "not in"):
                found = F.lit(False)
                for x in e.args[1:]:
                    found = found | self.equal(e.args[0], x)
                return found if e.name == "in" else ~found
            if e.name in TESTS:
                return TESTS[e.name](*(self.term(x) for x in e.args))
        t = self.term(e)
        return (
            F.when(t["kind"] != "literal", F.lit(None).cast("boolean"))
            .when(t["dt"] == BOOLEAN, t["lex"].isin("true", "1"))
            .when(t["dt"].isin(*V.NUMERIC_TYPES), F.coalesce((t["num"] != 0) & ~F.isnan(t["num"]), F.lit(False)))
            .when(t["dt"].isin(STRING, RDF + "langString"), t["lex"] != "")
        )

    def equal(self, x, y) -> Column:
        a, b = self.term(x), self.term(y)
        numbers = a["dt"].isin(*V.NUMERIC_TYPES) & b["dt"].isin(*V.NUMERIC_TYPES)
        alike = F.when(numbers, a["num"] == b["num"]).otherwise(same(a, b))
        return F.when(a.isNotNull() & b.isNotNull(), alike)


TERM_TYPE = "struct<kind:string,lex:string,dt:string,lang:string,num:double>"


def _lex(f):
    """A test or function of the texts of literals."""
    return lambda a, *more: f(a["lex"], *(m["lex"] for m in more))


def _regex(a: Column, pattern: Column, flags: Column | None = None) -> Column:
    p = pattern["lex"] if flags is None else F.when(flags["lex"] == "", pattern["lex"]).otherwise(F.concat(F.lit("(?"), flags["lex"], F.lit(")"), pattern["lex"]))
    return F.when(a["kind"] == "literal", F.regexp_like(a["lex"], p))


def _lang_matches(a: Column, b: Column) -> Column:
    tag = F.lower(b["lex"])
    return F.when(tag == "*", a["lex"] != "").otherwise(
        (F.lower(a["lex"]) == tag) | F.startswith(F.lower(a["lex"]), F.concat(tag, F.lit("-")))
    )


TESTS: dict[str, Callable] = {
    "isiri": lambda a: a["kind"] == "iri",
    "isuri": lambda a: a["kind"] == "iri",
    "isblank": lambda a: a["kind"] == "bnode",
    "isliteral": lambda a: a["kind"] == "literal",
    "isnumeric": lambda a: a["dt"].isin(*V.NUMERIC_TYPES) & a["num"].isNotNull(),
    "sameterm": lambda a, b: same(a, b),
    "langmatches": _lang_matches,
    "regex": _regex,
    "strstarts": _lex(F.startswith),
    "strends": _lex(F.endswith),
    "contains": _lex(F.contains),
}


def _part(f):
    return lambda a: number(f(a["lex"].try_cast("timestamp")).cast("double"), INTEGER)


def _substr(a: Column, start: Column, length: Column | None = None) -> Column:
    first = start["num"].cast("int")
    return text(F.substr(a["lex"], first) if length is None else F.substr(a["lex"], first, length["num"].cast("int")), a)


def _before(a: Column, b: Column) -> Column:
    at = F.position(b["lex"], a["lex"])
    return text(F.when(at > 0, F.left(a["lex"], at - 1)).otherwise(F.lit("")), a)


def _after(a: Column, b: Column) -> Column:
    at = F.position(b["lex"], a["lex"])
    return text(F.when(at > 0, F.substr(a["lex"], at + F.length(b["lex"]))).otherwise(F.lit("")), a)


ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def _is_time(a: Column) -> Column:
    return (a["dt"] == XSD + "dateTime") & a["lex"].try_cast("timestamp").isNotNull()


def _zone(a: Column) -> Column:
    """A time's offset as a duration; an error where there is none."""
    zone = F.regexp_extract(a["lex"], ZONE, 1)
    hours, minutes = (F.substr(zone, F.lit(k), F.lit(2)).cast("int") for k in (2, 5))
    parts = F.concat(
        F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"),
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""),
    )
    zero = zone.isin("Z", "+00:00", "-00:00")
    duration = F.when(_is_time(a) & zero, "PT0S").when(_is_time(a) & (zone != ""), parts)
    return F.when(duration.isNotNull(), make("literal", duration, F.lit(XSD + "dayTimeDuration")))


VALUES: dict[str, Callable] = {
    "str": lambda a: text(F.when(a["kind"] != "bnode", a["lex"])),
    "lang": lambda a: text(F.when(a["kind"] == "literal", a["lang"])),
    "datatype": lambda a: F.when(a["kind"] == "literal", make("iri", a["dt"])),
    "iri": lambda a: F.when(a["kind"] != "bnode", make("iri", a["lex"])),
    "uri": lambda a: F.when(a["kind"] != "bnode", make("iri", a["lex"])),
    "strdt": lambda a, d: make("literal", a["lex"], d["lex"], None, number_of(a["lex"])),
    "strlang": lambda a, g: make("literal", a["lex"], F.lit(RDF + "langString"), F.lower(g["lex"]), number_of(a["lex"])),
    "strlen": lambda a: number(F.length(a["lex"]).cast("double"), INTEGER),
    "substr": _substr,
    "ucase": lambda a: text(F.upper(a["lex"]), a),
    "lcase": lambda a: text(F.lower(a["lex"]), a),
    "strbefore": _before,
    "strafter": _after,
    "concat": lambda *some: text(F.concat(*(a["lex"] for a in some)) if some else F.lit("")),
    "replace": lambda a, p, r, f=None: text(F.regexp_replace(a["lex"], p["lex"] if f is None else F.concat(F.lit("(?"), f["lex"], F.lit(")"), p["lex"]), r["lex"]), a),
    "encode_for_uri": lambda a: text(F.replace(F.url_encode(a["lex"]), F.lit("+"), F.lit("%20"))),
    "abs": lambda a: number(F.abs(a["num"])),
    "ceil": lambda a: number(F.ceil(a["num"]).cast("double")),
    "floor": lambda a: number(F.floor(a["num"]).cast("double")),
    "round": lambda a: number(F.floor(a["num"] + 0.5).cast("double")),
    "year": _part(F.year),
    "month": _part(F.month),
    "day": _part(F.dayofmonth),
    "hours": _part(F.hour),
    "minutes": _part(F.minute),
    "seconds": _part(F.second),
    "tz": lambda a: text(F.when(_is_time(a), F.regexp_extract(a["lex"], ZONE, 1))),
    "timezone": lambda a: _zone(a),
    "now": lambda: make("literal", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(XSD + "dateTime")),
    "rand": lambda: number(F.rand(), DOUBLE),
    "uuid": lambda: make("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "struuid": lambda: text(F.uuid()),
    "bnode": lambda a: make("bnode", F.concat(F.lit("b"), F.md5(a["lex"]))),
    "md5": lambda a: text(F.md5(a["lex"])),
    "sha1": lambda a: text(F.sha1(a["lex"])),
    "sha256": lambda a: text(F.sha2(a["lex"], 256)),
    "sha384": lambda a: text(F.sha2(a["lex"], 384)),
    "sha512": lambda a: text(F.sha2(a["lex"], 512)),
}


def aggregate(e: Call, x: Expressions) -> Column:
    """An aggregate call as an aggregate column."""
    if e.name == "count":
        if not e.args:
            return number(F.count(F.lit(1)).cast("double"), INTEGER)
        t = x.term(e.args[0])
        key = F.when(t.isNotNull(), F.struct(t["kind"], t["lex"], t["dt"], t["lang"]))
        return number((F.count_distinct(key) if e.distinct else F.count(key)).cast("double"), INTEGER)
    arg = e.args[0]
    if e.name in ("sum", "avg"):
        n = x.num(arg)
        if e.name == "sum":
            return number(F.coalesce(F.sum_distinct(n) if e.distinct else F.sum(n), F.lit(0.0)))
        return number(F.avg(n))
    t = x.term(arg)
    if e.name in ("min", "max"):
        f = F.min_by if e.name == "min" else F.max_by
        return f(t, F.struct(F.coalesce(t["num"], F.lit(0.0)), t["lex"]))
    if e.name == "sample":
        return F.min_by(t, t["lex"])
    if e.name == "group_concat":
        found = F.collect_set(t["lex"]) if e.distinct else F.collect_list(t["lex"])
        return text(F.array_join(F.array_sort(found), e.separator))
    raise QueryError(f"unknown aggregate: {e.name}")
