"""Document fingerprints: a Merkle tree over sections, paragraphs and content-defined pieces of paragraphs.

Leaves are 64-bit hashes of short pieces, cut where the content says so. A paragraph's node hashes its leaves' hashes, a
section's its paragraphs' nodes, and the root the sections' nodes. The fingerprint holds the root and, in tree order, each
paragraph's node and a short mark of each leaf; sections' nodes follow from those of their paragraphs. Equal roots tell equal
texts (but for collisions: 96 bits of SHA-256 at the root, 64 at a paragraph, and 64-bit leaves, so about one pair of
leaves in 1.8e19), and where two trees differ only branches with different nodes are entered to locate the edits.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Characters of a leaf's mark, of a paragraph's node and of a root; how far apart pieces end, at least and at most.
LEAF, NODE, ROOT, NEAR, MOST = 4, 11, 16, 6, 48
#: Rows that a task holds in Python at a time.
ROWS = 128

_A, _B, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_POWERS = np.cumprod(np.full(MOST, _B, np.uint64))


def _hash(data: bytes, size: int = 8) -> bytes:
    return hashlib.sha256(data).digest()[:size]


def _leaves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' hashes, and the number of pieces up to the end of each line.

    A piece ends with each line, after at most MOST characters, and where the hash of three characters is the least
    of NEAR such hashes before it and after it, all of one line; so pieces fall into step again after an edit, and a line
    has the same pieces wherever it is. The end of a line is no part of its hash.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    local = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
    local[1:] += c[:-1] * np.uint32(0x85EBCA77)
    local[2:] += c[:-2] * np.uint32(0xC2B2AE3D)
    local ^= local >> np.uint32(15)
    local *= np.uint32(0x27D4EB2F)
    line = c == 10
    last = line.copy()
    if len(c) > 2 * NEAR:
        least = np.minimum(np.minimum(local[:-2], local[1:-1]), local[2:])
        least = np.minimum(least[:-3], least[3:])  # of NEAR = 6 neighbours
        m = len(c) - 2 * NEAR
        mid = local[NEAR : NEAR + m]
        cut = (mid < least[:m]) & (mid < least[NEAR + 1 : NEAR + 1 + m])
        cut[:2] = False  # the text's first line, too, has no pieces that end nearer to its start than other lines do
        if line.any():
            lines = np.concatenate([[0, 0, 0], np.cumsum(line)])
            cut &= lines[2 * NEAR + 3 :][:m] == lines[:m]
        last[NEAR : NEAR + m] |= cut
    last[-1] = True
    ends = np.flatnonzero(last)
    sizes = np.diff(ends, prepend=-1)
    if sizes.max() > MOST:
        parts = -(-sizes // MOST)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.minimum(np.repeat(ends - sizes, parts) + (k + 1) * MOST, np.repeat(ends, parts))
        sizes = np.diff(ends, prepend=-1)
    starts = ends - sizes + 1
    place = np.arange(len(c)) - np.repeat(starts, sizes)
    mixed = (c ^ np.uint32(0xABCDEF)).astype(np.uint64) * _D
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _POWERS[place]
    mixed[line] = 0
    sums = np.add.reduceat(mixed, starts)
    sums = (sums ^ (sums >> np.uint64(29))) * _A
    return sums ^ (sums >> np.uint64(32)), np.searchsorted(ends, np.flatnonzero(line)) + 1


def _marks(sums: np.ndarray) -> str:
    three = (sums >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    return base64.b64encode(three.tobytes()).decode()


def _shown(node: bytes) -> str:
    return base64.b64encode(node).decode().rstrip("=")


def _section(nodes: list[str]) -> bytes:
    return _hash("".join(nodes).encode(), 32)


def fingerprint(text: str | None) -> str:
    """``root:sections``; sections (ended by blank lines) are parted by ``;``, paragraphs (lines) by ``,``.

    A paragraph is its node and its leaves' marks. Null counts as the empty text, which has one section of one paragraph
    without leaves.
    """
    text = text or ""
    sums, lines = _leaves(text) if text else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    marks, data = _marks(sums), sums.tobytes()
    sections: list[list[str]] = [[]]
    nodes: list[list[str]] = [[]]
    at = 0
    for end in [*lines.tolist(), len(sums)]:
        own = data[8 * at : 8 * end]
        nodes[-1].append(node := _shown(_hash(own)))
        sections[-1].append(node + marks[LEAF * at : LEAF * end])
        at = end
        if own == BLANK:
            sections.append([])
            nodes.append([])
    root = _shown(_hash(b"".join(map(_section, nodes)), ROOT * 6 // 8))
    return f"{root}:" + ";".join(",".join(s) for s in sections)


#: The leaf of a line without characters.
BLANK = _leaves("\n")[0].tobytes()


class Tree:
    """A fingerprint read again: for each section its paragraphs as (node, marks), and the section's node."""

    def __init__(self, mark: str) -> None:
        self.root, body = mark.split(":", 1)
        self.sections = [[(p[:NODE], p[NODE:]) for p in s.split(",")] for s in body.split(";")]
        self.nodes = [_section([n for n, _ in s]) for s in self.sections]

    def holds(self) -> bool:
        """The root is that of the sections' nodes."""
        return self.root == _shown(_hash(b"".join(self.nodes), ROOT * 6 // 8))


def _integers(marks: str) -> np.ndarray:
    three = np.frombuffer(base64.b64decode(marks), np.uint8).reshape(-1, 3).astype(np.int64)
    return (three[:, 0] << 16) | (three[:, 1] << 8) | three[:, 2]


def leaves(mark: str) -> np.ndarray:
    """The leaves' marks of a fingerprint as integers, in tree order."""
    return _integers("".join(m for s in Tree(mark).sections for _, m in s))


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal values, ascending in both: equal ends, and between them the longest such chain of pairs of
    a value's n-th place in ``a`` with its n-th in ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    some = [(i, where[a[i]].pop()) for i in range(head, len(a) - tail) if where.get(a[i])]
    ends: list[int] = []  # least last place in b of a chain of each length, and which pair that is
    which: list[int] = []
    before = [-1] * len(some)
    for k, (_, j) in enumerate(some):
        at = bisect.bisect_left(ends, j)
        before[k] = which[at - 1] if at else -1
        ends[at : at + 1], which[at : at + 1] = [j], [k]
    chain, k = [], which[-1] if which else -1
    while k >= 0:
        chain.append(some[k])
        k = before[k]
    ends_ = [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail - 1, -1, -1)]
    return [(i, i) for i in range(head)] + chain[::-1] + ends_


def differing(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(section, paragraph) of each paragraph of ``a`` that has no counterpart in ``b``, and the reverse.

    Sections with equal nodes are passed over; paragraphs of the others are aligned in order by their nodes, so one
    that is put in, taken out or changed doesn't move those after it.
    """
    x, y = Tree(a), Tree(b)
    if x.root == y.root:
        return [], []
    same = aligned(x.nodes, y.nodes)
    left = [(i, j) for i in sorted(set(range(len(x.nodes))) - {p for p, _ in same}) for j in range(len(x.sections[i]))]
    right = [(i, j) for i in sorted(set(range(len(y.nodes))) - {q for _, q in same}) for j in range(len(y.sections[i]))]
    node = lambda t, place: t.sections[place[0]][place[1]][0]
    both = aligned([node(x, p) for p in left], [node(y, q) for q in right])
    gone, come = {p for p, _ in both}, {q for _, q in both}
    return [p for k, p in enumerate(left) if k not in gone], [q for k, q in enumerate(right) if k not in come]


def _numbered(x: np.ndarray) -> np.ndarray:
    """Each value with its count so far, as one integer, so that sets of these are multisets of values."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    count = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return x << 32 | count


def compared(a: str, b: str) -> tuple[float, int, str | None]:
    """Likeness, how many paragraphs of ``a`` have no counterpart in ``b``, and where the first of these is.

    The likeness is 1 for equal roots; else the leaves of aligned branches, and of those that both trees hold in the
    branches that differ, repeats counted, over the leaves of the larger tree. The place is ``section.paragraph``, from 0.
    """
    if a[:ROOT] == b[:ROOT]:
        return 1.0, 0, None
    x, y = Tree(a), Tree(b)
    left, right = differing(a, b)
    size = lambda t: sum(len(m) for s in t.sections for _, m in s) // LEAF
    p, q = (_integers("".join(t.sections[i][j][1] for i, j in places)) for t, places in ((x, left), (y, right)))
    both = np.concatenate([_numbered(p), _numbered(q)])
    both.sort()
    shared = size(x) - len(p) + int((both[1:] == both[:-1]).sum())
    most = max(size(x), size(y))
    first = f"{left[0][0]}.{left[0][1]}" if left else None
    return (min(shared / most, 1.0 - 1e-9) if most else 0.0), len(left), first


def likeness(a: str, b: str) -> float:
    return compared(a, b)[0]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and ``fingerprint`` of each row of ``docs`` (doc_id, text); repeated rows each get a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [fingerprint(t) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {kind}, fingerprint string"
    )


def with_next(docs: DataFrame, blocks: int, each=None, columns: str = "text string, next_text string") -> DataFrame:
    """doc_id and what ``each`` makes of (text, next text) for each row: by default the two texts themselves.

    The text after a row's is that of the next row, and the first row's after the last.
    Rows are ordered by doc_id (cast to long; null first), then text; a null text is the empty text. Ids are cut into ``blocks``
    ranges of about equal numbers of rows; each range is dealt, with the first row of the next range that has rows,
    to one task, which reads it in order. So no task sees all rows, a text moves once, and the driver sees one id a range.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("place", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    cuts = rows.select("place").approxQuantile("place", [k / blocks for k in range(1, blocks)], 0.2 / blocks)
    cuts = sorted({int(c) for c in cuts})
    dealt = rows.withColumn("block", _rank(F.col("place"), cuts))
    heads = sorted(dealt.groupBy("block").agg(F.min("place").alias("place")).collect())
    ahead = [(heads[i - 1][0], head[1]) for i, head in enumerate(heads)]
    small = F.broadcast(docs.sparkSession.createDataFrame(ahead, "block int, place long"))
    texts = rows.where(F.col("place").isin([p for _, p in ahead])).join(small, "place").groupBy("block", "place")
    after = texts.agg(F.min("text").alias("text"), F.lit(1).alias("ahead"), F.lit(None).cast("long").alias("doc_id"))
    both = dealt.withColumn("ahead", F.lit(0)).unionByName(after)
    both = both.repartition(max(1, blocks // 4), "block").sortWithinPartitions("block", "ahead", "place", "text")
    both = both.select("doc_id", "text", "block", "ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                out = []
                for row in zip(*(c.to_pylist() for c in b.slice(k, ROWS).columns), strict=True):
                    if held and held[2] == row[2]:
                        out.append((held[0], *(each(held[1], row[1]) if each else (held[1], row[1]))))
                    held = None if row[3] else row
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else []
                if out:
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in f"doc_id bigint, {columns}".split(", "))])
    return both.mapInArrow(run, f"doc_id bigint, {columns}")


def _rank(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``: among every root-th of them first, then among those between."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c <= value))
    every = F.array(*map(F.lit, cuts[step - 1 :: step])) if len(cuts) >= step else F.array().cast("array<bigint>")
    coarse = below(every) * step
    return coarse + below(F.slice(F.array(*map(F.lit, cuts)), coarse + 1, step))


def edited(text: str, other: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many, or all, of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likenesses, and where the edit begins by the trees.

    ``edited_branches`` paragraphs of the document aren't in the edited text, the first of them ``first_edit``.
    """
    docs = table(spark, sf_dir, "documents")
    last = (None, "")

    def each(text: str, other: str) -> tuple:
        nonlocal last
        changed = edited(text, other)
        mark = last[1] if last[0] == text else fingerprint(text)
        after = fingerprint(other)
        last = (other, after)
        half = fingerprint(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        near, branches, first = compared(mark, half)
        return len(text), sha, mark, half, near, likeness(mark, after), branches, first

    return with_next(
        docs,
        4 * int(spark.conf.get("spark.sql.shuffle.partitions")),
        each,
        "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_branches bigint, first_edit string",
    )
