"""Queries after parsing."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..plans.ir import Path
from ..terms import Term


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    """A function or operator, in lower case, and its arguments: Var, Term, Call or Group (of exists)."""

    name: str
    args: tuple = ()
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Triple:
    s: Var | Term
    p: Var | Path
    o: Var | Term


@dataclass(frozen=True)
class Filter:
    test: object


@dataclass(frozen=True)
class Bind:
    value: object
    name: str


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple[Term | None, ...], ...]


@dataclass(frozen=True)
class Optional:
    group: Group


@dataclass(frozen=True)
class Lateral:
    """A group that is evaluated for each solution by itself."""

    group: Group


@dataclass(frozen=True)
class Union:
    groups: tuple[Group, ...]


@dataclass(frozen=True)
class InGraph:
    name: Var | Term
    group: Group


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Service:
    group: Group


@dataclass(frozen=True)
class SubSelect:
    query: Query


@dataclass(frozen=True)
class Group:
    parts: tuple = ()


@dataclass(frozen=True)
class Query:
    """``select`` is None for ASK; ``star`` means all variables. CONSTRUCT has a template, DESCRIBE nodes and variables."""

    where: Group
    select: tuple[tuple[str, object], ...] | None = None
    distinct: bool = False
    group_by: tuple = ()
    having: tuple = ()
    order_by: tuple = ()
    limit: int | None = None
    offset: int = 0
    star: bool = field(default=False)
    construct: tuple[Triple, ...] | None = None
    describe: tuple | None = None


def walk(part):
    """Every part of a group, inner groups included, and groups inside expressions."""
    yield part
    inner: list = []
    if isinstance(part, Group):
        inner = list(part.parts)
    elif isinstance(part, (Optional, InGraph, Lateral, Minus, Service)):
        inner = [part.group]
    elif isinstance(part, Union):
        inner = list(part.groups)
    elif isinstance(part, Filter):
        inner = [part.test]
    elif isinstance(part, Bind):
        inner = [part.value]
    elif isinstance(part, Call):
        inner = list(part.args)
    elif isinstance(part, SubSelect):
        q = part.query
        inner = [q.where, *(e for _, e in (*(q.select or ()), *q.group_by)), *q.having, *(e for e, _ in q.order_by)]
    for x in inner:
        yield from walk(x)
