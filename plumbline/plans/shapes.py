"""Shapes graphs to shapes."""

from __future__ import annotations

import logging
from collections import defaultdict

from ..functions.values import local_name
from ..terms import OWL, RDF, RDFS, SH, Term, iri
from .ir import VIOLATION, Alternative, Closure, Constraint, Inverse, Path, Predicate, Sequence, Shape, Target
from .mode import STRICT, Mode

log = logging.getLogger(__name__)

NIL = iri(RDF + "nil")
#: Parameters of one term, number or text, by component.
NUMBERS = ("minCount", "maxCount", "minLength", "maxLength")
BOUNDS = ("minExclusive", "minInclusive", "maxExclusive", "maxInclusive")
PATHS = ("equals", "disjoint", "lessThan", "lessThanOrEquals")


class ShapeError(ValueError):
    """A shapes graph that can't be read: ill-formed paths or lists, or shapes that refer to themselves."""


def component(name: str) -> str:
    return f"{SH}{name[0].upper()}{name[1:]}ConstraintComponent"


class ShapesGraph:
    """Triples of a shapes graph, indexed for the reader."""

    def __init__(self, triples, mode: Mode = STRICT) -> None:
        self.triples = list(dict.fromkeys(triples))
        self.mode = mode
        self.by: dict[Term, dict[str, list[Term]]] = defaultdict(lambda: defaultdict(list))
        self.of: dict[str, list[tuple[Term, Term]]] = defaultdict(list)
        for s, p, o in self.triples:
            self.by[s][p].append(o)
            self.of[p].append((s, o))
        self._open: list[Term] = []
        self._components: list[dict] | None = None

    # values -----------------------------------------------------------------------------------------------------

    def all(self, s: Term, p: str) -> list[Term]:
        return self.by[s].get(p, []) if s in self.by else []

    def one(self, s: Term, p: str) -> Term | None:
        return next(iter(self.all(s, p)), None)

    def text(self, s: Term, p: str) -> str | None:
        v = self.one(s, p)
        return v.lex if v is not None and v.is_literal else None

    def flag(self, s: Term, p: str) -> bool | None:
        """``true`` and ``false`` only, as spelled."""
        return {"true": True, "false": False}.get(self.text(s, p) or "")

    def number(self, s: Term, p: str) -> int | None:
        t = self.text(s, p)
        try:
            n = int(t) if t is not None else None
        except ValueError:
            return None
        return n if n is None or -(2**31) <= n < 2**31 else None

    def items(self, head: Term) -> list[Term]:
        """The members of an RDF list; raises ShapeError for one that is broken or goes in a circle."""
        out, seen = [], set()
        while head != NIL:
            if head in seen:
                raise ShapeError(f"list {head} goes in a circle")
            seen.add(head)
            first, rest = self.one(head, RDF + "first"), self.one(head, RDF + "rest")
            if first is None or rest is None:
                raise ShapeError(f"broken list at {head}")
            out.append(first)
            head = rest
        return out

    def above(self, start: Term, p: str) -> set[Term]:
        """``start`` and all that it leads to by ``p``, however far and in circles too."""
        found, todo = {start}, [start]
        while todo:
            for x in self.all(todo.pop(), p):
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return found

    def superclasses(self, c: Term) -> set[Term]:
        return self.above(c, RDFS + "subClassOf")

    def superproperties(self, p: Term) -> set[Term]:
        return self.above(p, RDFS + "subPropertyOf")

    def is_subclass_of(self, c: Term, other: Term) -> bool:
        return other in self.superclasses(c)

    # paths ------------------------------------------------------------------------------------------------------

    def path(self, t: Term, depth: int = 0) -> Path:
        if depth > 50:
            raise ShapeError("path goes in a circle")
        if t.kind == "iri":
            return Predicate(t.lex)
        if t.is_literal:
            raise ShapeError(f"a literal is no path: {t}")
        if self.one(t, RDF + "first") is not None:
            parts = tuple(self.path(x, depth + 1) for x in self.items(t))
            return parts[0] if len(parts) == 1 else Sequence(parts)
        inner = {p: v for p in ("inversePath", "alternativePath", "zeroOrMorePath", "oneOrMorePath", "zeroOrOnePath") if (v := self.one(t, SH + p)) is not None}
        if len(inner) != 1:
            raise ShapeError(f"no path at {t}")
        (kind, v), = inner.items()
        if kind == "inversePath":
            return Inverse(self.path(v, depth + 1))
        if kind == "alternativePath":
            parts = tuple(self.path(x, depth + 1) for x in self.items(v))
            return parts[0] if len(parts) == 1 else Alternative(parts)
        return Closure(self.path(v, depth + 1), int(kind == "oneOrMorePath"), kind != "zeroOrOnePath")

    # shapes -----------------------------------------------------------------------------------------------------

    def nodes(self) -> list[Term]:
        """Nodes typed as shapes or with a target, in order of appearance."""
        kinds = {iri(SH + x) for x in ("NodeShape", "PropertyShape", "Shape")}
        found = [s for s, o in self.of[RDF + "type"] if o in kinds]
        for p in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "target"):
            found += [s for s, _ in self.of[SH + p]]
        return list(dict.fromkeys(found))

    def targets(self, node: Term) -> tuple[Target, ...]:
        out = []
        types = self.all(node, RDF + "type")
        classes = {iri(RDFS + "Class"), iri(OWL + "Class")}
        if node.kind == "iri" and any(classes & self.superclasses(t) for t in types):
            out.append(Target("implicit", node))
        for p, kind in (("targetClass", "class"), ("targetNode", "node"), ("targetSubjectsOf", "subjects"), ("targetObjectsOf", "objects"), ("target", "advanced")):
            out += [Target(kind, t) for t in self.all(node, SH + p)]
        return tuple(out)

    def shape(self, node: Term, top: bool = False, severity: str | None = None) -> Shape:
        """The shape at ``node`` with all it refers to; raises ShapeError for one that refers to itself."""
        if node in self._open:
            raise ShapeError(f"shape {node} refers to itself")
        self._open.append(node)
        try:
            p = self.one(node, SH + "path")
            own = self.one(node, SH + "severity")
            level = own.lex if own is not None else VIOLATION
            if severity is not None and not self.mode.own_severity:
                level = severity
            properties = []
            for x in self.all(node, SH + "property"):
                properties.append(self.shape(x, severity=level))
            path = self.path(p) if p is not None else None
            return Shape(
                node=node,
                path=path,
                path_text=str(path) if path else "",
                targets=self.targets(node) if top else (),
                constraints=tuple(self.constraints(node, path is not None)),
                properties=tuple(properties),
                name=self.text(node, SH + "name") or self.text(node, RDFS + "label") or "",
                description=self.text(node, SH + "description") or "",
                messages=tuple(m.lex for m in self.all(node, SH + "message") if m.is_literal),
                severity=level,
                deactivated=bool(self.flag(node, SH + "deactivated")),
            )
        finally:
            self._open.pop()

    def _some(self, node: Term, p: str) -> list[Term]:
        found = self.all(node, SH + p)
        return found if self.mode.all_values else found[:1]

    def constraints(self, node: Term, is_property: bool) -> list[Constraint]:
        out: list[Constraint] = []

        def add(name: str, **params) -> None:
            out.append(Constraint(component(name), params))

        for t in self.all(node, SH + "class"):
            if t.kind == "iri":
                add("class", **{"class": t})
        for p in ("datatype", "nodeKind"):
            for t in self._some(node, p):
                if t.kind == "iri":
                    add(p, **{p: t})
        for p in NUMBERS:
            if (n := self.number(node, SH + p)) is not None:
                add(p, **{p: n})
        for p in BOUNDS:
            for t in self._some(node, p):
                if t.is_literal:
                    add(p, **{p: t})
        flags = self.text(node, SH + "flags") or ""
        for t in self._some(node, "pattern"):
            if t.is_literal:
                add("pattern", pattern=t.lex, flags=flags)
        for t in self._some(node, "languageIn"):
            tags = [x.lex for x in self.items(t) if x.is_literal]
            if tags or self.mode.all_values:
                add("languageIn", languageIn=tags)
        if (u := self.flag(node, SH + "uniqueLang")) is not None:
            add("uniqueLang", uniqueLang=u)
        for p in PATHS:
            for t in self.all(node, SH + p):
                try:
                    add(p, **{p: self.path(t)})
                except ShapeError as e:
                    log.warning("%s of %s left out: %s", p, node, e)
        for t in self.all(node, SH + "hasValue"):
            add("hasValue", hasValue=t)
        for t in self._some(node, "in"):
            items = self.items(t)
            if items or self.mode.all_values:
                add("in", **{"in": items})
        for t in self.all(node, SH + "node"):
            add("node", node=self.shape(t))
        for p in ("and", "or", "xone"):
            for t in self.all(node, SH + p):
                add(p, **{p: [self.shape(x) for x in self.items(t)]})
        for t in self._some(node, "not"):
            add("not", **{"not": self.shape(t)})
        for t in self.all(node, SH + "qualifiedValueShape"):
            out.append(
                Constraint(
                    SH + "QualifiedConstraintComponent",
                    {
                        "qualifiedValueShape": self.shape(t),
                        "qualifiedMinCount": self.number(node, SH + "qualifiedMinCount"),
                        "qualifiedMaxCount": self.number(node, SH + "qualifiedMaxCount"),
                        "qualifiedValueShapesDisjoint": bool(self.flag(node, SH + "qualifiedValueShapesDisjoint")),
                    },
                )
            )
        if self.flag(node, SH + "closed"):
            ignored: list[str] = []
            for t in self.all(node, SH + "ignoredProperties"):
                if t.kind == "iri" or self.mode.ignored_as_list:
                    ignored += [x.lex for x in self.items(t)]
            add("closed", ignored=sorted(set(ignored)))
        for t in self.all(node, SH + "sparql"):
            if self.flag(t, SH + "deactivated"):
                continue
            select, ask = self.text(t, SH + "select"), self.text(t, SH + "ask")
            if select or ask:
                message = tuple(m.lex for m in self.all(t, SH + "message") if m.is_literal)
                add("SPARQL", query=select or ask, ask=not select, prefixes=self.prefixes(t), messages=message, binding={}, source=t)
        out += self._custom(node, is_property)
        return out

    def prefixes(self, t: Term) -> dict[str, str]:
        """Declared prefixes, those of imported ontologies included."""
        out, todo, seen = {}, self.all(t, SH + "prefixes")[:], set()
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            todo += self.all(x, OWL + "imports")
            for d in self.all(x, SH + "declare"):
                p, n = self.text(d, SH + "prefix"), self.one(d, SH + "namespace")
                if p is not None and n is not None:
                    out.setdefault(p, n.lex)
        return out

    def components(self) -> list[dict]:
        """Constraint components that the graph declares: IRI, parameters (path, optional) and validators."""
        if self._components is None:
            root, self._components = iri(SH + "ConstraintComponent"), []
            for c in dict.fromkeys(s for s, _ in self.of[SH + "parameter"]):
                if not any(root in self.superclasses(t) for t in self.all(c, RDF + "type")):
                    continue
                params = []
                for x in self.all(c, SH + "parameter"):
                    p = self.one(x, SH + "path")
                    if p is not None:
                        params.append((p.lex, bool(self.flag(x, SH + "optional"))))
                kinds = {k: self.all(c, SH + k) for k in ("validator", "nodeValidator", "propertyValidator")}
                self._components.append({"iri": c.lex, "params": params, **kinds, "node": c})
        return self._components

    def _custom(self, node: Term, is_property: bool) -> list[Constraint]:
        out = []
        for c in self.components():
            if any(not optional and self.one(node, p) is None for p, optional in c["params"]):
                continue
            bound = {local_name(p): v for p, _ in c["params"] if (v := self.one(node, p)) is not None}
            if not bound:
                continue
            special = c["propertyValidator" if is_property else "nodeValidator"]
            for v in special or c["validator"]:
                select, ask = self.text(v, SH + "select"), self.text(v, SH + "ask")
                if not (select or ask):
                    continue
                messages = tuple(m.lex for m in self.all(v, SH + "message") + self.all(c["node"], SH + "message") if m.is_literal)
                params = {"query": select or ask, "ask": not select, "prefixes": {**self.prefixes(c["node"]), **self.prefixes(v)}}
                out.append(Constraint(c["iri"], {**params, "messages": messages, "binding": bound, "source": v, "custom": True}))
        return out


def parse_shapes(triples, mode: Mode = STRICT) -> list[Shape]:
    """The shapes of a shapes graph that have a target or a type.

    A shape or property that can't be read is left out with a warning in the older mode; by default ShapeError is raised.
    """
    g = ShapesGraph(triples, mode)
    out = []
    for n in g.nodes():
        try:
            out.append(g.shape(n, top=True))
        except ShapeError:
            if mode.all_values:
                raise
            log.warning("shape %s left out", n)
    return out


def parse_shape(triples, node: Term, mode: Mode = STRICT) -> Shape:
    """One shape with its targets."""
    return ShapesGraph(triples, mode).shape(node, top=True)
