"""Best-fit packing of token sequences by linear grouping.

Only the histogram of piece lengths reaches the driver, at most one number a length. Large lengths are cut into groups of
equal cardinality and rounded up to their group's largest; configurations of these few sizes that fill a sequence are
chosen by column generation on the cutting-stock relaxation, rounded down and completed greedily. Actual lengths,
longest first, take the rounded places of their group, and small pieces go where they fit best. The plan is a list
of runs of equal sequences; pieces find their place in it by their rank among pieces of the same length.
"""

from __future__ import annotations

import bisect
import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

SIZE, END = 2048, 0
#: A length above SIZE / SMALL is large; large lengths form GROUPS groups.
SMALL, GROUPS = 3, 64
#: Pieces of a length are numbered in parts of about PART of all pieces' number, so that no length is numbered in one task.
PART = 50_000
CACHE = 300_000

#: The letters among the characters that OTHER does not find.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: Fixed pattern: how the tokenizer's own rule splits texts of such characters.
SPLIT = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Characters of which letters, digits and blanks mean the same to Python and to the tokenizer.
OTHER = re.compile(r"[^\t\n\r -~¡-©«-±´¶-¸»¿-ſ]")
#: Byte-level pre-tokenization as these tokenizers print it: words are those of SPLIT, each byte a character.
BYTE_LEVEL = re.compile(r"ByteLevel\(add_prefix_space=False, trim_offsets=\w+, use_regex=True\)")


def _byte_characters() -> dict[int, str]:
    """The character that byte-level models have for each byte: its own if it shows, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def tokenizer_path() -> str:
    """Where the public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Token ids as little-endian unsigned 32-bit bytes; what is known of words is kept, for up to CACHE of them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        plain = self._tokenizer.normalizer is None and BYTE_LEVEL.fullmatch(str(self._tokenizer.pre_tokenizer))
        self._tokenize = self._tokenizer.model.tokenize if plain else None
        self._characters = _byte_characters()

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if self._tokenize is None:
            ids = self._whole(word)
        else:  # a word is one piece to the tokenizer, so its model alone does
            tokens = self._tokenize(word.encode().decode("latin-1").translate(self._characters))
            ids = np.array([t.id for t in tokens], "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if OTHER.search(text) or any(s in text for s in self._special):
            return self._whole(text)
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, SPLIT.findall(text)))


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each row's pieces: its ids and END, cut at ``size``.

    The first piece takes the remainder, so all later ones are full. Null counts as the empty text: one piece of END. ``doc_id`` is cast to long.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoder.encode(text or "") + END.to_bytes(4, "little")
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    stop = start + ((n - start) % size or size)
                    out.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, k = stop, k + 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _simplex(patterns: list[list[int]], demand: np.ndarray, sizes: list[int], room: int, rounds: int = 2000) -> np.ndarray:
    """Column generation from single-size patterns, which it replaces: how often to use each (a relaxation's solution).

    It ends when no pattern would help. ``rounds`` only guards against cycling; a solution that it cuts short is still
    one, of more sequences than need be, and a warning says so.
    """
    basis, lengths = np.array(patterns, float).T, np.array(sizes)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = np.ones(len(sizes)) @ inverse
        best, choice = np.zeros(room + 1), np.full(room + 1, -1)
        for r in range(int(lengths.min()), room + 1):
            worth = np.where(lengths <= r, best[r - np.minimum(lengths, r)] + price, -1.0)
            i = int(worth.argmax())
            best[r], choice[r] = max((best[r - 1], -1), (float(worth[i]), i))
        if best[room] <= 1 + 1e-7:
            break
        column, r = np.zeros(len(sizes)), room
        while r > 0:
            if choice[r] < 0:
                r -= 1
            else:
                column[choice[r]] += 1
                r -= sizes[choice[r]]
        step, level = inverse @ column, inverse @ demand
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    else:
        warnings.warn(f"column generation ended after {rounds} rounds, short of the optimum", stacklevel=3)
    patterns[:] = [[int(round(x)) for x in col] for col in basis.T]
    return np.maximum(np.linalg.solve(basis, demand), 0)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Runs (first sequence, number of sequences, [(length, first rank)]): each sequence of a run holds one piece of each.

    The k-th sequence of a run holds the piece with rank (first rank + k) of each length listed, in the list's order.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    bins: list[tuple[int, list[tuple[int, int]]]] = []  # (how many, places)

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
        return first

    if left.get(size):
        n = left[size]
        bins.append((n, [(size, take(size, n))]))
    large = sorted((k for k in left if k > size / SMALL), reverse=True)
    total = sum(left[k] for k in large)
    if total:
        # 1. groups of equal cardinality, rounded up to their largest length
        share, groups, count = -(-total // GROUPS), [], 0
        for k in large:
            if not groups or count >= share:
                groups.append([])
                count = 0
            groups[-1].append(k)
            count += left[k]
        sizes = [g[0] for g in groups]
        # 2. configurations of the rounded sizes
        patterns = [[size // s if i == j else 0 for j in range(len(sizes))] for i, s in enumerate(sizes)]
        demand = np.array([sum(left[k] for k in g) for g in groups], float)
        times = np.floor(_simplex(patterns, demand, sizes, size) + 1e-9).astype(int)
        need = demand.astype(int)
        configs = []
        for p, n in zip(patterns, times, strict=True):
            n = int(min([n, *(need[i] // c for i, c in enumerate(p) if c)]))
            if n > 0:
                configs.append((n, p))
                need = need - n * np.array(p)
        while need.any():
            room, p = size, [0] * len(sizes)
            for i, s in enumerate(sizes):
                c = int(min(need[i], room // s))
                p[i], room = c, room - c * s
            n = int(min(need[i] // c for i, c in enumerate(p) if c))
            configs.append((n, p))
            need = need - n * np.array(p)
        # 3. actual lengths for the rounded places, longest first
        for n, p in configs:
            places = [i for i, c in enumerate(p) for _ in range(c)]
            while n:
                want: dict[int, int] = {}
                chosen = []
                for i in places:
                    k = next(k for k in groups[i] if left.get(k, 0) > want.get(k, 0))
                    want[k] = want.get(k, 0) + 1
                    chosen.append(k)
                m = min([n, *(left[k] // c for k, c in want.items())])
                bins.append((m, [(k, take(k, m)) for k in chosen]))
                n -= m
    # 4. what is left goes where it fits best, longest first
    rooms: dict[int, list[int]] = {}
    open_rooms: list[int] = []

    def put(i: int, room: int) -> None:
        if room:
            if room not in rooms:
                bisect.insort(open_rooms, room)
            rooms.setdefault(room, []).append(i)

    for i, (_, places) in enumerate(bins):
        put(i, size - sum(k for k, _ in places))
    for k in sorted(left, reverse=True):
        while k in left:
            at = bisect.bisect_left(open_rooms, k)
            if at == len(open_rooms):
                fit = size // k
                m = left[k] // fit
                if m:
                    bins.append((m, [(k, take(k, m)) for _ in range(fit)]))
                    put(len(bins) - 1, size - fit * k)
                else:
                    n = left[k]
                    bins.append((1, [(k, take(k, 1)) for _ in range(n)]))
                    put(len(bins) - 1, size - n * k)
                continue
            room = open_rooms[at]
            i = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                open_rooms.pop(at)
            n, places = bins[i]
            fit = min(room // k, max(1, left[k] // n))
            m = min(n, left[k])
            bins[i] = (m, [*places, *((k, take(k, m)) for _ in range(fit if m == n else 1))])
            if m < n:
                bins.append((n - m, [(x, first + m) for x, first in places]))
                put(len(bins) - 1, room)
            put(i, size - sum(x for x, _ in bins[i][1]))
    out, first = [], 0
    for n, places in bins:
        out.append((first, n, places))
        first += n
    return out


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32).

    A full piece is a sequence by itself and gets a negative id; the others' ids count from 0. Equal rows are told apart
    by number only.
    """
    spark = parts.sparkSession
    parts = checkpointed(parts)
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most size rows
    full = parts.where(F.col("length") == size)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    histogram.pop(size, None)
    n = 1 + sum(histogram.values()) // PART
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for first, _, places in plan(histogram, size):
        at = 0
        for length, rank in places:
            by_length.setdefault(length, []).append((rank, first, at))
            at += length
    slots = {k: np.array(sorted(v), np.int64) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(slots)  # bounded by the lengths' runs, not by the input
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int")
    rest = parts.where(F.col("length") < size).withColumn("part", part)
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rest.withColumn("rank", F.row_number().over(order) - 1)
    if n > 1:  # what earlier parts of a length hold
        counts = rest.groupBy("length", "part").count()
        earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
        ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        for b in batches:
            rank = b["rank"].to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for length, at in b.groupby("length").indices.items():
                s = slots[length]
                k = np.searchsorted(s[:, 0], rank[at], "right") - 1
                sequence[at], offset[at] = s[k, 1] + rank[at] - s[k, 0], s[k, 2]
            yield b.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)

    placed = ranked.mapInPandas(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return full.unionByName(placed)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return pack(pieces(table(spark, sf_dir, "documents")))
