"""SimHash near-duplicates, with pivot distance tables to discard pairs, and by choice exact shingle similarity.

Texts with equal fingerprints form a class, and only classes are compared. Fingerprints that differ in at most
``BITS`` bits agree in two of five parts, so classes meet in groups by part pairs; large groups are split once more by
parts of the other bits. Each class carries its Hamming distances to the reference fingerprints (the pivots); by the
triangle inequality a pair whose distances to any pivot differ by more than BITS is no link, and what survives is
verified.

With a ``similarity`` texts link by the Jaccard similarity of their sets of shingles instead, whole sets compared. Such
pairs may differ in many more bits than any fingerprint parts can key, so besides the fingerprints' groups classes meet
by the shingles of their prefixes: in any one order of all shingles, two sets with the similarity or more share one among
the first ``n - ceil(similarity * n) + 1`` of each. The order puts common shingles last, which decides costs only.

In each group members are first compared with its least one, which joins dense groups at a cost in proportion to their
size; then only pairs from different components are compared, so no group emits all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, counted, free, settled, table

BITS, SHINGLE, SEED = 3, 3, 42
PARTS = 5
PIVOTS = 16
#: Groups of more members are split by BITS + 1 parts of the bits that they don't share by definition.
SPLIT = 64
#: Shingles in COMMON or more of about SAMPLE documents, or of one in EACH if these are more, count as common; at most KNOWN of
#: them are remembered. That decides costs only.
SAMPLE, EACH, COMMON, KNOWN = 4_000, 50, 8, 50_000
#: A set's map has MAP longs or more, so that it has four bits or more a shingle. The ids of up to FEW classes are
#: broadcast to find their texts.
MAP, FEW = 16, 200_000


def hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of the text's word shingles, repeats included; of all words if these are fewer."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(parts[i:] for i in range(min(size, len(parts)))), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """64 majority bits over the hashes of the text's word shingles, repeats included; 0 without words."""
    return _majority(hashes(text, size))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, ``copy`` (a hash of the text) and ``fp`` (the fingerprint as a signed long) of each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([simhash(t, size) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "copy": b["copy"], "fp": fp})

    return _rows(docs).mapInPandas(run, "doc_id long, copy long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the bit numbers."""
    edges = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _masks() -> list[tuple[int, list[int]]]:
    """The pairs of parts as bit masks, each with masks of BITS + 1 parts of the other bits."""
    out = []
    for both in map(sum, combinations(_cut(list(range(64)), PARTS), 2)):
        rest = _cut([i for i in range(64) if not both >> i & 1], BITS + 1)
        out.append((_signed(both), [_signed(m) for m in rest]))
    return out


def _pivots() -> list[int]:
    """Reference fingerprints: hashes of their numbers, about 32 bits from each other and from most fingerprints."""
    return [_signed(xxhash.xxh64_intdigest(f"pivot {i}", SEED)) for i in range(PIVOTS)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _with_pivots(classes: DataFrame) -> DataFrame:
    """The distances to the pivots, eight to a long."""
    for w in range(0, PIVOTS, 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(_pivots()[w : w + 8]):
            packed = packed.bitwiseOR(F.shiftleft(_distance(F.col("fp"), F.lit(p)).cast("long"), 8 * i))
        classes = classes.withColumn(f"near{w // 8}", packed)
    return classes


def _within(a: str, b: str) -> Column:
    """No pivot's distances from the two sides differ by more than BITS."""
    one = lambda side, w, i: F.shiftrightunsigned(F.col(f"{side}.near{w}"), 8 * i).bitwiseAND(F.lit(255).cast("long"))
    return reduce(
        and_, [F.abs(one(a, i // 8, i % 8) - one(b, i // 8, i % 8)) <= BITS for i in range(PIVOTS)]
    )


def _within_parts(edges: DataFrame) -> DataFrame:
    """(v, root) for the vertices of each partition of ``edges`` (a, b): the least that the partition's own edges lead to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for x, y in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        found = [find(x) for x in root]
        yield pd.DataFrame({"v": np.array(list(root), np.int64), "root": np.array(found, np.int64)})

    return edges.select("a", "b").mapInPandas(run, "v long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``edges`` (a, b: longs): the least vertex it is linked to, by any path.

    Each partition's edges become stars first, which is all where there is one partition. Else large and small stars
    alternate until no vertex has two partners below it or one on each side; each round is checkpointed. Hub vertices
    meet their least neighbour by a pre-aggregated minimum and a join that adaptive execution can split.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts, now = now.rdd.getNumPartitions(), _within_parts(now)
    if parts == 1:
        return checkpointed(now)
    # stars have no more edges than there were
    now = checkpointed(now.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")).distinct().coalesce(parts))

    def stars(e: DataFrame) -> bool:
        one = lambda k, below: F.struct(F.col(k).alias("v"), F.lit(below).alias("below"), F.lit(1 - below).alias("above"))
        ends = e.select(F.explode(F.array(one("a", 1), one("b", 0))).alias("e")).select("e.*")
        sums = ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        return sums.where("below + above > 1 and below > 0").agg(F.count("*")).first()[0] == 0

    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(parts))
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return checkpointed(now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots).coalesce(parts))


def _rooted(members: DataFrame, roots: DataFrame | None, by: str = "id") -> DataFrame:
    """Adds ``root``: that of the member's component in (v, root), else itself."""
    if roots is None:
        return members.withColumn("root", F.col(by))
    return members.join(roots, F.col(by) == F.col("v"), "left").withColumn("root", F.coalesce("root", by)).drop("v")


def _joined(first: DataFrame | None, edges: DataFrame, verified: bool = False) -> DataFrame:
    """(v, root) of the components of ``first`` when ``edges`` (a, b; ``verified``: read from checkpoints) link them further."""
    if first is not None:
        if verified and not counted(edges):
            return first
        edges = edges.unionByName(first.select(F.col("v").alias("a"), F.col("root").alias("b")))
    return components(edges)


def link(
    members: DataFrame,
    near: Column,
    roots: DataFrame | None = None,
    check: Callable[[DataFrame], DataFrame] | None = None,
    finer: Column | None = None,
    often: Callable[[Column, Column, Column], Column] | None = None,
    early: Column | None = None,
) -> DataFrame:
    """(v, root): components of links between ``members`` (g, id, ...) of equal ``g``, and of ``roots`` (v, root).

    ``near`` holds of two members ``x`` and ``y`` that may link, and ``check`` gives those of the pairs (a, b) that do, from
    checkpoints.
    ``finer`` gives keys of which members that link share one, for groups of more than SPLIT members. ``often`` tells, by
    the number of groups that two members share and their ``n``, whether they may link, and ``early`` holds in one group
    at least that members which link share: in groups of more than SPLIT members only such pairs are made, and the others
    are counted as shared by both sides. Repeated (g, id) are one member. Members without links and roots are left out.
    """
    verified, check = check is not None, check or (lambda pairs: pairs)

    def pair(met: DataFrame, x: str, y: str, large: bool = False) -> DataFrame:
        ids = (F.col(f"{x}.id").alias("a"), F.col(f"{y}.id").alias("b"))
        if often is None:
            return met.select(*ids)
        more = F.max(F.least(f"{x}.large", f"{y}.large")) if large else F.lit(0)
        first = F.max(early.cast("int")) if large else F.lit(1)
        made = met.groupBy(*ids, F.col(f"{x}.n").alias("na"), F.col(f"{y}.n").alias("nb"))
        counted = made.agg(F.count("*").alias("shared"), more.alias("more"), first.alias("first")).where("first = 1")
        return counted.where(often(F.col("shared") + F.col("more"), F.col("na"), F.col("nb"))).select("a", "b")

    slim = [c for c in members.columns if c not in ("g", "id")]
    again = members.groupBy("g").agg(F.count("*").alias("rows")).where("rows > 1").select("g")
    met = settled(members.join(again, "g", "left_semi").groupBy("g", "id").agg(*(F.min(c).alias(c) for c in slim)))
    # 1. every member with its group's least one; where these share too few groups, step 2 counts all that they share
    heads = met.groupBy("g").agg(F.min(F.struct("id", *slim)).alias("head")).select("g", "head.*")
    stars = met.alias("x").join(heads.alias("y"), "g").where((F.col("x.id") != F.col("y.id")) & near)
    first = _joined(roots, check(pair(stars, "x", "y")), verified)
    # 2. pairs of a group from different components; most groups are within one and drop out
    rooted = settled(_rooted(met, first))
    mixed = rooted.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    if early is not None:
        # how many large groups each member is in
        size = F.when(F.col("size") > SPLIT, 1).otherwise(0)
        left = settled(rooted.join(mixed.select("g", size.alias("big")), "g"))
        large = left.where("big = 1").groupBy("id").agg(F.count("*").alias("large"))
        left = left.join(large, "id", "left").withColumn("large", F.coalesce("large", F.lit(0)))
        near = near & ((F.col("x.big") == 0) | early)
    elif finer is None:
        left = rooted.join(mixed.select("g"), "g", "left_semi")
    else:
        left = rooted.join(mixed.select("g", "size"), "g")
        key = F.when(F.col("size") > SPLIT, finer).otherwise(F.array("g"))
        left = left.withColumn("g", F.explode(key)).drop("size")
    cross = left.alias("x").join(left.alias("y"), "g").where((F.col("x.root") < F.col("y.root")) & near)
    return _joined(first, check(pair(cross, "y", "x", early is not None)), verified)


def by_parts(classes: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Members, ``near`` and ``finer`` for ``link``: classes (id, fp) meet by part pairs and are near within BITS bits."""
    key = lambda *x: F.xxhash64(*x)  # noqa: E731 (groups of equal hashes are merged, which costs only)
    keys = F.array(*(F.struct(key(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))).alias("g"), F.lit(t).alias("t")) for t, (m, _) in enumerate(_masks())))
    members = _with_pivots(classes.select("id", "fp")).withColumn("key", F.explode(keys)).select("key.g", "id", "key.t", "fp", "near0", "near1")
    near = _within("x", "y") & (_distance(F.col("x.fp"), F.col("y.fp")) <= BITS)
    rest = F.element_at(F.array(*(F.array(*map(F.lit, r)) for _, r in _masks())), F.col("t") + 1)
    return members, near, F.transform(rest, lambda m, i: key(F.col("g"), i, F.col("fp").bitwiseAND(m)))


def link_fingerprints(classes: DataFrame) -> DataFrame:
    """(fp, root) for each distinct ``fp``: the least fingerprint reachable by links of at most BITS bits."""
    members, near, finer = by_parts(classes.select("fp", F.col("fp").alias("id")))
    return _rooted(classes.select("fp"), link(members, near, finer=finer), "fp").select("fp", "root")


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, ascending, and in how many sampled documents each is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"s": np.unique(hashes(t, size)).view(np.int64)})

    step = max(1, min(EACH, docs.count() // SAMPLE))
    some = docs.select("text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)
    counts = some.mapInPandas(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "s").limit(KNOWN).toPandas().sort_values("s")
    return got["s"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _prefix(h: np.ndarray, similarity: float, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, common ones last, of which sets of the similarity share one."""
    if not len(h):
        return h
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        h = h[np.lexsort((h, np.where(known[at] == h, often[at], 0)))]
    return h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def _map(h: np.ndarray) -> np.ndarray:
    """The set as a bit map of a power of two of longs, four bits or more a shingle; the halves of a map, united, are the next smaller one."""
    longs = MAP
    while 16 * longs < len(h):
        longs *= 2
    marks = np.zeros(64 * longs, np.uint8)
    marks[h & (64 * longs - 1)] = 1
    return np.packbits(marks).view(np.int64)


def _unshared(x: Column, y: Column) -> Column:
    """Bits of the map ``x`` that aren't in ``y``, whose size is that of ``x``, its half or its double."""
    halves = lambda m, n: F.zip_with(F.slice(m, 1, n), F.slice(m, n + 1, n), lambda p, q: p.bitwiseOR(q))
    small = F.least(F.size(x), F.size(y))
    fit = lambda m: F.when(F.size(m) > small, halves(m, small)).otherwise(m)
    bits = F.zip_with(fit(x), fit(y), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
    return F.aggregate(bits, F.lit(0), lambda t, z: t + z)


def shingled(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, copy, fp, ``id`` (a hash of the set of shingles), its size ``n``, map ``bits`` and ``prefix`` of each row.

    Of a task's rows with equal sets only the first has a prefix.
    """
    known, often = _common(docs, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        none = np.zeros(0, np.int64)
        for b in batches:
            all_ = [hashes(t, size) for t in b["text"]]
            sets = [np.unique(h.view(np.int64)) for h in all_]
            ids = [xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets]
            new = [not (i in seen or seen.add(i)) for i in ids]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "copy": b["copy"],
                    "fp": np.array([_majority(h) for h in all_], np.uint64).view(np.int64),
                    "id": np.array(ids, np.uint64).view(np.int64),
                    "n": [len(h) for h in sets],
                    "bits": [_map(h) for h in sets],
                    "prefix": [_prefix(h, similarity, known, often) if x else none for h, x in zip(sets, new, strict=True)],
                }
            )

    return _rows(docs).mapInPandas(run, "doc_id long, copy long, fp long, id long, n int, bits array<long>, prefix array<long>")


def by_prefix(rows: DataFrame, similarity: float) -> tuple[DataFrame, Column, Callable[[Column, Column, Column], Column], Column]:
    """Members, ``near``, ``often`` and ``early`` for ``link``: sets meet by shingles of their prefixes.

    Sizes and the places of a shared shingle may rule the similarity out: before and after it, the shorter side bounds
    what both share. So may the number of shingles that the prefixes share: the others that the sets share are all
    behind the prefix of one of them. Texts that share a passage only are told apart by that, without their sets. The
    first shingle that two sets share is early in both: before it each has no more than it may have for itself.
    """
    members = rows.select("id", "n", F.posexplode("prefix").alias("i", "g")).select("g", "id", "n", "i")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    after = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    enough = F.least("x.i", "y.i") + after >= similarity / (1 + similarity) * (small + large) - 1e-6

    def often(shared: Column, na: Column, nb: Column) -> Column:
        behind = F.greatest(*(F.ceil(similarity * n - 1e-9) - 1 for n in (na, nb)))
        return shared + behind >= similarity / (1 + similarity) * (na + nb) - 1e-6

    needed = F.ceil(similarity / (1 + similarity) * (small + large) - 1e-6)
    early = (F.col("x.i") <= F.col("x.n") - needed) & (F.col("y.i") <= F.col("y.n") - needed)
    return members, (small >= similarity * large - 1e-6) & enough, often, early


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity.

    A bit of one map that isn't in the other is a shingle that isn't, so maps bound what is shared; texts are read only
    for the pairs that are left. Each class is compared with the least of its partners first, and with the others
    only where that leaves them in different components.
    """
    side = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    shared = F.least(F.col("na") - _unshared(F.col("bitsa"), F.col("bitsb")), F.col("nb") - _unshared(F.col("bitsb"), F.col("bitsa")))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    pairs = settled(both.where(shared / (F.col("na") + F.col("nb") - shared) >= similarity - 1e-9).select("a", "b"))
    if not counted(pairs):
        return pairs
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = settled(classes.join(ids, "id").select("id", F.col("lead.doc_id").alias("d"), F.col("lead.copy").alias("c")))
    if counted(wanted) <= FEW:
        wanted = F.broadcast(wanted)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))
    texts = settled(_rows(docs).join(wanted, same).groupBy("id").agg(F.min("text").alias("text")), 5_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = {x: np.unique(hashes(t, size)) for k, t in (("a", "one"), ("b", "two")) for x, t in zip(b[k], b[t], strict=True)}
            hit = []
            for x, y in zip(b["a"], b["b"], strict=True):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                hit.append(common >= similarity * (len(sets[x]) + len(sets[y]) - common) - 1e-9)
            yield b.loc[hit, ["a", "b"]]

    def compared(some: DataFrame) -> DataFrame:
        whole = some.join(texts.select(F.col("id").alias("a"), F.col("text").alias("one")), "a")
        whole = whole.join(texts.select(F.col("id").alias("b"), F.col("text").alias("two")), "b")
        return settled(whole.mapInPandas(run, "a long, b long"))

    least = settled(pairs.groupBy("a").agg(F.min("b").alias("b")))
    found = compared(least)
    if counted(least) == counted(pairs):
        return found
    roots = components(found)
    rest = pairs.join(least, ["a", "b"], "left_anti")
    for k in ("a", "b"):
        rest = _rooted(rest, roots, k).withColumnRenamed("root", f"root{k}")
    return found.unionByName(compared(rest.where("roota <> rootb").select("a", "b")))


def link_sets(rows: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(v, root): components of links of the similarity or more between ``rows`` of ``shingled``."""
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("lead")
    classes = rows.groupBy("id").agg(lead, *(F.first(c).alias(c) for c in ("n", "bits", "fp")))
    classes = checkpointed(classes)
    check = lambda pairs: _verified(pairs, classes, docs, size, similarity)
    members, near, finer = by_parts(classes)
    first = link(members, near, check=check, finer=finer)
    members, near, often, early = by_prefix(rows, similarity)
    return link(members, near, first, check, often=often, early=early)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """doc_id, copy, fp, component_id and ``leads`` of each row of ``docs`` (doc_id, text).

    Texts link if the fingerprints of their shingles of ``size`` words differ in at most BITS bits or, with a
    ``similarity``, if the Jaccard similarity of their sets of shingles reaches it. A component's id is its least doc_id
    (null if all are null) and its leader the row with the least (doc_id, copy); rows repeated with both lead together.
    Null, empty and blank texts have fingerprint zero and the empty set and link like others. ``doc_id`` is cast to long.
    """
    if similarity is None:
        rows = checkpointed(fingerprints(docs, size)).withColumn("id", F.col("fp"))
        ids = checkpointed(rows.select("id", "fp").distinct())
        members, near, finer = by_parts(ids)
        roots = link(members, near, finer=finer)
    else:
        rows = checkpointed(shingled(docs, size, similarity))
        roots = link_sets(rows, docs, size, similarity)
    classes = rows.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("lead"))
    linked = checkpointed(_rooted(classes, roots))
    lead = linked.groupBy("root").agg(F.min("lead").alias("lead"))
    found = linked.select("id", "root").join(lead, "root").select("id", "lead")
    out = rows.select("doc_id", "copy", "fp", "id").join(found, "id")
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("copy") == F.col("lead.copy"))
    return out.select("doc_id", "copy", "fp", F.col("lead.doc_id").alias("component_id"), leads.alias("leads"))


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that lead their group of near-duplicates, one row a group.

    Of rows with equal doc_id and text, the one whose columns (but maps, which have no hash) hash least stays.
    """
    c = free("k_", docs)
    names = [f"{c}id", f"{c}null", f"{c}copy"]
    key = lambda x, copy: (F.coalesce(x, F.lit(0)).alias(names[0]), x.isNull().alias(names[1]), copy.alias(names[2]))
    found = near_duplicates(docs.select("doc_id", "text"), size, similarity).where("leads")
    leaders = found.select(*key(F.col("doc_id"), F.col("copy"))).distinct()
    own = docs.select("*", *key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    # one exchange of the rows, after repeated ones are combined, serves the join too
    order = F.xxhash64(*(F.col(f"`{x.name}`") for x in docs.schema if "map<" not in x.dataType.simpleString()))
    once = own.groupBy(*names).agg(F.min_by(F.struct(*(F.col(f"`{x}`") for x in docs.columns)), order).alias(f"{c}row"))
    return once.join(leaders, names, "left_semi").select(*(F.col(f"{c}row.`{x}`") for x in docs.columns))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
