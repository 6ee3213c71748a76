"""Secret scans by one combined deterministic automaton.

Every rule is a regular expression in two parts, a head that each match begins with and a tail that extends it. The
heads are parsed to a nondeterministic automaton; their union, prefixed by "any bytes", goes through subset
construction and Moore minimisation into transition arrays over byte classes. One pass of the bytes of a text yields,
for each position, the set of rules with a head that ends there. Only there does the rule's reversed automaton run
back to the leftmost start, and its whole automaton forward to the longest end, so these two read matches, not texts.
Tails stay out of the combined automaton because runs of different rules would multiply its states.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches of ``head + tail`` with ``least`` characters or more, counted from the last quote, blank, : or = on if
    ``value`` is set. A shorter match is dropped, but what it covers is not searched again for this rule."""

    kind: str
    head: str
    tail: str
    least: int = 1
    value: bool = False


#: The base rules, then rules for other well-known credential formats.
BASE = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
        r"[A-Za-z0-9+/_.=-]*",
        12,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]", r"[A-Z0-9]*", 18),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]*", 16),
)
MORE = (
    Rule("pem", r"-----BEGIN\x20", r"([A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]", r"[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"[A-Za-z0-9]*", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9]", r"[A-Za-z0-9-]*", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]", r"[A-Za-z0-9_-]*", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]", r"[A-Za-z0-9]*", 24),
)
RULES = BASE + MORE
VALUE = re.compile(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)\Z""")


class _Nfa:
    """Thompson construction. Grammar: literals, ``\\x20``-style and ``\\.`` escapes, classes, groups, | * + ? {n}."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self._src, self._at = pattern, 0
        out = self._either()
        if self._at != len(pattern):
            raise ValueError(f"unexpected {pattern[self._at]!r} at {self._at} of {pattern!r}")
        return out

    def _peek(self) -> str:
        return self._src[self._at : self._at + 1]

    def _take(self) -> str:
        c = self._peek()
        if not c:
            raise ValueError(f"pattern ends early: {self._src!r}")
        self._at += 1
        return c

    def _either(self) -> tuple[int, int]:
        parts = [self._chain()]
        while self._peek() == "|":
            self._take()
            parts.append(self._chain())
        if len(parts) == 1:
            return parts[0]
        a, b = self.state(), self.state()
        for x, y in parts:
            self.eps[a].append(x)
            self.eps[y].append(b)
        return a, b

    def _chain(self) -> tuple[int, int]:
        first = last = self.state()
        while self._peek() not in ("", "|", ")"):
            a, b = self._repeated()
            self.eps[last].append(a)
            last = b
        return first, last

    def _repeated(self) -> tuple[int, int]:
        start = self._at
        a, b = self._atom()
        c = self._peek()
        if c == "{":
            end = self._src.index("}", self._at)
            atom, n = self._src[start : self._at], int(self._src[self._at + 1 : end])
            rest, self._at = self._src, end + 1
            keep = self._at
            first, last = a, b
            for _ in range(n - 1):
                self._src, self._at = atom, 0
                x, y = self._atom()
                self.eps[last].append(x)
                last = y
            self._src, self._at = rest, keep
            return first, last
        if c and c in "*+?":
            self._take()
            x, y = self.state(), self.state()
            self.eps[x].append(a)
            self.eps[b].append(y)
            if c in "*?":
                self.eps[x].append(y)
            if c in "*+":
                self.eps[b].append(a)
            return x, y
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self._take()
        if c == "(":
            out = self._either()
            if self._take() != ")":
                raise ValueError(f"missing ) in {self._src!r}")
            return out
        got = self._class() if c == "[" else frozenset([self._escaped() if c == "\\" else ord(c)])
        a, b = self.state(), self.state()
        self.step[a] = (got, b)
        return a, b

    def _escaped(self) -> int:
        c = self._take()
        return int(self._take() + self._take(), 16) if c == "x" else ord(c)

    def _class(self) -> frozenset[int]:
        got: set[int] = set()
        while (c := self._take()) != "]":
            low = self._escaped() if c == "\\" else ord(c)
            high = low
            if self._peek() == "-" and self._src[self._at + 1 : self._at + 2] != "]":
                self._take()
                c = self._take()
                high = self._escaped() if c == "\\" else ord(c)
            got.update(range(low, high + 1))
        return frozenset(got)

    def reversed(self) -> _Nfa:
        out = _Nfa()
        out.eps = [[] for _ in self.eps]
        out.step = [None] * len(self.eps)
        for s, to in enumerate(self.eps):
            for t in to:
                out.eps[t].append(s)
        for s, step in enumerate(self.step):
            if step:  # each target of a byte step is entered by that step alone
                out.step[step[1]] = (step[0], s)
        return out


def _determinised(nfa: _Nfa, starts: list[int], finals: dict[int, int], anywhere: bool):
    """Subset construction over byte classes: (class of each byte, rows of targets, accept mask by state)."""
    cut = sorted({c for step in nfa.step if step for c in (step[0],)}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    of_byte = bytes(kinds.setdefault(tuple(b in c for c in cut), len(kinds)) for b in range(256))
    sample = [of_byte.index(k) for k in range(len(kinds))]

    def closed(states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.step[s] or s in finals)

    start = closed(frozenset(starts))
    number, todo, rows, masks = {start: 0}, [start], [], []
    while todo:
        now = todo.pop(0)
        masks.append(sum({1 << finals[s] for s in now if s in finals}))
        row = []
        for b in sample:
            to = {nfa.step[s][1] for s in now if nfa.step[s] and b in nfa.step[s][0]}
            nxt = closed(frozenset(to | (set(starts) if anywhere else set())))
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    return of_byte, rows, masks


def _minimised(rows: list[list[int]], masks: list[int]) -> tuple[list[list[int]], list[int]]:
    """Moore's partition refinement from the accept masks; state 0 stays the start."""
    block = [sorted(set(masks)).index(m) for m in masks]
    while True:
        ids: dict[tuple, int] = {}
        fresh = [ids.setdefault((block[s], *(block[t] for t in row)), len(ids)) for s, row in enumerate(rows)]
        if len(ids) == len(set(block)):
            break
        block = fresh
    order = {b: i for i, b in enumerate(dict.fromkeys(fresh))}
    out: list[list[int]] = [[] for _ in order]
    kept = [0] * len(order)
    for s, row in enumerate(rows):
        out[order[fresh[s]]] = [order[fresh[t]] for t in row]
        kept[order[fresh[s]]] = masks[s]
    return out, kept


class Scanner:
    """All rules as one automaton; ``spans`` gives each rule's leftmost non-overlapping matches of a text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        nfa = _Nfa()
        ends = [nfa.add(r.head) for r in rules]
        starts, finals = [a for a, _ in ends], {b: i for i, (_, b) in enumerate(ends)}
        self.of_byte, rows, masks = _determinised(nfa, starts, finals, True)
        rows, masks = _minimised(rows, masks)
        self.states, self.transitions, self.accepts = len(rows), rows, masks
        sets = sorted(set(masks))
        if len(sets) > 256:
            raise ValueError("too many combinations of rules for one byte of output")
        self.sets = [[i for i in range(len(rules)) if m >> i & 1] for m in sets]
        width = len(rows[0])
        linked: list[list] = [[None] * (width + 1) for _ in rows]
        for s, row in enumerate(rows):
            for c, t in enumerate(row):
                linked[s][c] = linked[t]
            linked[s][width] = sets.index(masks[s])
        self._linked, self._mark = linked, itemgetter(width)
        self._back, self._whole = [], []
        for r in rules:
            head, whole = _Nfa(), _Nfa()
            a, b = head.add(r.head)
            self._back.append(self._anchored(head.reversed(), b, a))
            self._whole.append(self._anchored(whole, *whole.add(r.head + r.tail)))
        self._hit = re.compile(rb"[^\x00]", re.DOTALL)

    @staticmethod
    def _anchored(nfa: _Nfa, start: int, end: int) -> tuple:
        """(class of each byte, rows, accepts, dead) of a minimised automaton that matches from its start on."""
        of_byte, rows, masks = _determinised(nfa, [start], {end: 0}, False)
        rows, masks = _minimised(rows, masks)
        return of_byte, rows, masks, [not masks[s] and set(row) == {s} for s, row in enumerate(rows)]

    @staticmethod
    def _last(automaton, data: bytes, places: range, lost: set | None = None) -> int | None:
        """The last of ``places`` at which the automaton, started at the first, accepts.

        ``lost`` holds (place, state) from which earlier runs of the automaton came to no accept; a run that meets one
        ends there and adds its own, so all runs together read a text at most once a state.
        """
        of_byte, rows, masks, dead = automaton
        state, best, trail = 0, None, []
        for i in places:
            state = rows[state][of_byte[data[i]]]
            if masks[state]:
                best = i
                trail.clear()
            elif dead[state]:
                break
            elif lost is not None:
                if (i, state) in lost:
                    break
                trail.append((i, state))
        if lost is not None:
            lost.update(trail)
        return best

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, in that order; none for null and empty texts."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        marks = bytes(map(self._mark, accumulate(data.translate(self.of_byte), getitem, initial=self._linked[0])))
        found, floor = [], [0] * len(self.rules)
        lost: list[set[tuple[int, int]]] = [set() for _ in self.rules]
        for m in self._hit.finditer(marks):
            for i in self.sets[marks[m.start()]]:
                start = self._last(self._back[i], data, range(m.start() - 1, floor[i] - 1, -1))
                last = None if start is None else self._last(self._whole[i], data, range(start, len(data)), lost[i])
                if last is None:
                    continue
                floor[i] = end = last + 1
                match = data[start:end].decode("ascii")
                if len(VALUE.search(match)[1] if self.rules[i].value else match) >= self.rules[i].least:
                    found.append((start, i, end))
        if found and len(data) != len(text):
            place = {b: len(data[:b].decode("utf-8", "surrogatepass")) for s, _, e in found for b in (s, e)}
            found = [(place[s], i, place[e]) for s, i, e in found]
        return sorted(found)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (kind, start, end).

    Spans are in code points, ends exclusive, by start and then by the rules' order. Null and empty texts have none;
    repeated rows each get a row; further columns of ``docs`` are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for batch in batches:
            spans = [
                [{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in scanner.spans(t)] for t in batch["text"]
            ]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans that ``scan_secrets`` finds in every document."""
    from .common import table

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    text = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(text(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
