"""The form of shapes after parsing: frozen values without any data."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import SH, Term

VIOLATION = SH + "Violation"


class Path:
    """A regular expression over predicates."""


@dataclass(frozen=True)
class Predicate(Path):
    iri: str

    def __str__(self) -> str:
        return f"<{self.iri}>"


@dataclass(frozen=True)
class Inverse(Path):
    path: Path

    def __str__(self) -> str:
        return f"^{self.path}"


@dataclass(frozen=True)
class Sequence(Path):
    parts: tuple[Path, ...]

    def __str__(self) -> str:
        return "/".join(f"({p})" if isinstance(p, Alternative) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Alternative(Path):
    parts: tuple[Path, ...]

    def __str__(self) -> str:
        return "|".join(map(str, self.parts))


@dataclass(frozen=True)
class Closure(Path):
    """``path*`` (least 0), ``path+`` (least 1, many) or ``path?`` (least 0, not many)."""

    path: Path
    least: int
    many: bool = True

    def __str__(self) -> str:
        inner = str(self.path)
        inner = f"({inner})" if isinstance(self.path, (Sequence, Alternative)) else inner
        return inner + ("?" if not self.many else "+" if self.least else "*")


@dataclass(frozen=True)
class Negated(Path):
    """Any predicate but these; SPARQL has it."""

    forward: tuple[str, ...] = ()
    backward: tuple[str, ...] = ()

    def __str__(self) -> str:
        return "!(" + "|".join([*(f"<{p}>" for p in self.forward), *(f"^<{p}>" for p in self.backward)]) + ")"


@dataclass(frozen=True)
class Target:
    """``kind``: node, class, implicit, subjects, objects or advanced."""

    kind: str
    term: Term

    def __str__(self) -> str:
        return f"{self.kind} {self.term}"


@dataclass(frozen=True)
class Constraint:
    """One constraint: its component's IRI and its parameters by local name."""

    component: str
    params: dict = field(default_factory=dict, hash=False)

    @property
    def name(self) -> str:
        return self.component.rsplit("#", 1)[-1].removesuffix("ConstraintComponent")

    def __str__(self) -> str:
        shown = []
        for k, v in self.params.items():
            if isinstance(v, Shape):
                v = v.node
            elif isinstance(v, (list, tuple)):
                v = "(" + " ".join(str(x.node if isinstance(x, Shape) else x) for x in v) + ")"
            shown.append(f"{k}={v}")
        return f"{self.name}[{', '.join(shown)}]"


@dataclass(frozen=True)
class Shape:
    """A node shape (no path) or property shape."""

    node: Term
    path: Path | None = None
    path_text: str = ""
    targets: tuple[Target, ...] = ()
    constraints: tuple[Constraint, ...] = field(default=(), hash=False)
    properties: tuple[Shape, ...] = field(default=(), hash=False)
    name: str = ""
    description: str = ""
    messages: tuple[str, ...] = ()
    severity: str = VIOLATION
    deactivated: bool = False

    @property
    def is_property(self) -> bool:
        return self.path is not None

    def counts(self) -> dict[str, int]:
        """How many targets, constraints and property shapes it has, nested ones included."""
        inner = [p.counts() for p in self.properties]
        return {
            "targets": len(self.targets),
            "constraints": len(self.constraints) + sum(x["constraints"] for x in inner),
            "properties": len(self.properties) + sum(x["properties"] for x in inner),
        }

    def lines(self, depth: int = 0) -> list[str]:
        pad = "  " * depth
        head = f"{'PropertyShape' if self.is_property else 'NodeShape'} {self.node}"
        out = [pad + head + (f" path {self.path}" if self.path else "") + (" (deactivated)" if self.deactivated else "")]
        if self.name:
            out.append(f"{pad}  name: {self.name}")
        if self.severity != VIOLATION:
            out.append(f"{pad}  severity: <{self.severity}>")
        out += [f"{pad}  target: {t}" for t in self.targets]
        out += [f"{pad}  constraint: {c}" for c in self.constraints]
        for p in self.properties:
            out += p.lines(depth + 1)
        return out

    def __str__(self) -> str:
        return "\n".join(self.lines())

    def compact(self) -> str:
        c = self.counts()
        return f"{self.node}: {c['targets']} targets, {c['constraints']} constraints, {c['properties']} property shapes"

    def as_dict(self) -> dict:
        return {
            "node": str(self.node),
            "path": str(self.path) if self.path else None,
            "name": self.name or None,
            "description": self.description or None,
            "severity": self.severity,
            "deactivated": self.deactivated,
            "messages": list(self.messages),
            "targets": [{"kind": t.kind, "term": str(t.term)} for t in self.targets],
            "constraints": [str(c) for c in self.constraints],
            "properties": [p.as_dict() for p in self.properties],
        }
