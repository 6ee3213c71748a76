"""Comparison, lexical forms and matching of term columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import XSD

#: The numeric datatypes, and lexical forms of datatypes (W3C XML Schema).
NUMERIC_TYPES = tuple(
    XSD + x
    for x in (
        "integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger",
        "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte",
    )
)
TIME_TYPES = (XSD + "dateTime", XSD + "date", XSD + "dateTimeStamp")
ZONE = r"(Z|[+-]((0\d|1[0-3]):[0-5]\d|14:00))"
INTEGERS = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1),
    "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1), "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
LEXICAL = {
    "boolean": r"^(true|false|1|0)$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "float": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "date": rf"^-?[0-9]{{4,}}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]){ZONE}?$",
    "dateTime": rf"^-?[0-9]{{4,}}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-4]):[0-5]\d:[0-5]\d(\.\d+)?{ZONE}?$",
    "time": rf"^([01]\d|2[0-4]):[0-5]\d:[0-5]\d(\.\d+)?{ZONE}?$",
    "gYear": rf"^-?[0-9]{{4,}}{ZONE}?$",
    "duration": r"^-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$",
    "hexBinary": r"^([0-9a-fA-F]{2})*$",
    "language": r"^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$",
}


def well_formed(t: Column, datatype: str) -> Column:
    """Whether the literal's text is in the datatype's lexical space; true for datatypes not listed."""
    name = datatype.removeprefix(XSD)
    if not datatype.startswith(XSD):
        return F.lit(True)
    if name in INTEGERS:
        low, high = INTEGERS[name]
        out = t["lex"].rlike(r"^[+-]?[0-9]+$")
        value = t["lex"].try_cast("decimal(38,0)")
        if low is not None:
            out = out & (value >= F.lit(str(low)).cast("decimal(38,0)"))
        if high is not None:
            out = out & (value <= F.lit(str(high)).cast("decimal(38,0)"))
        return F.coalesce(out, F.lit(False))
    return t["lex"].rlike(LEXICAL[name]) if name in LEXICAL else F.lit(True)


def _instant(t: Column) -> Column:
    return F.when(t["dt"].isin(*TIME_TYPES), t["lex"].try_cast("timestamp"))


def _zoned(t: Column) -> Column:
    return t["lex"].rlike(ZONE + "$")


OPS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(a: Column, b: Column, op: str, by_datatype: bool = True) -> Column:
    """Whether ``a op b``; false where the two can't be compared, never null.

    By datatype: numbers with numbers, times with times if both or neither have a zone, strings with strings, booleans
    with booleans. Otherwise, by spelling: numbers if both texts spell one, bytes if neither does, else false. A NaN
    compares with nothing by datatype, and as equal by spelling.
    """
    literals = (a["kind"] == "literal") & (b["kind"] == "literal")
    f = OPS[op]
    nan = F.isnan(a["num"]) | F.isnan(b["num"])
    numbers = a["num"].isNotNull() & b["num"].isNotNull()
    if not by_datatype:
        equal = F.lit(op in ("<=", ">="))
        by_number = F.when(nan, equal).otherwise(f(a["num"], b["num"]))
        by_text = F.when(a["num"].isNull() & b["num"].isNull(), f(a["lex"], b["lex"])).otherwise(False)
        return F.coalesce(literals & F.when(numbers, by_number).otherwise(by_text), F.lit(False))
    numeric = a["dt"].isin(*NUMERIC_TYPES) & b["dt"].isin(*NUMERIC_TYPES)
    times = a["dt"].isin(*TIME_TYPES) & (a["dt"] == b["dt"])
    plain = (a["dt"] == b["dt"]) & (a["dt"].isin(XSD + "string", XSD + "boolean", XSD + "time", XSD + "gYear", ""))
    return F.coalesce(
        literals
        & F.when(numeric, numbers & ~nan & f(a["num"], b["num"]))
        .when(times, (_zoned(a) == _zoned(b)) & f(_instant(a), _instant(b)))
        .when(plain, f(a["lex"], b["lex"]))
        .otherwise(False),
        F.lit(False),
    )


def text_length(t: Column, in_bytes: bool) -> Column:
    return F.octet_length(t["lex"]) if in_bytes else F.length(t["lex"])


def java_pattern(pattern: str, flags: str) -> str | None:
    """The pattern with flags i, m, s, x, q as Java takes them; None if it is no pattern."""
    if "q" in flags:
        pattern = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
    used = "".join(c for c in "imsx" if c in flags)
    try:
        re.compile(pattern.replace("(?<", "(?P<") if "(?<" in pattern and "(?<=" not in pattern and "(?<!" not in pattern else pattern)
    except re.error:
        return None
    return f"(?{used}){pattern}" if used else pattern


def matches(t: Column, pattern: str) -> Column:
    return t["lex"].rlike(pattern)


def lang_matches(lang: Column, tag: str) -> Column:
    """Basic filtering: the tag itself or one that continues it after a hyphen; ``*`` is any tag."""
    if tag == "*":
        return lang != ""
    tag = tag.lower()
    return (F.lower(lang) == tag) | F.startswith(F.lower(lang), F.lit(tag + "-"))


def local_name(x: str) -> str:
    return re.split(r"[#/]", x)[-1]
