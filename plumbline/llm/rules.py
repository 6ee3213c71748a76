"""Quality rules: fixed base rules on words and repetition, then hashed n-gram logistic regression.

The regression sums hashed weights of words, word pairs and the character n-grams inside words, so a word's share is
computed once and reused; its calibrated probability is held against a fixed threshold. Texts are scored in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, logit, platt, sigmoid, table, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
KEEP = 0.3
BUCKETS = 1 << 18
#: Most labelled documents that the regression is fitted on.
FIT_ROWS = 3000
#: Words whose shares are remembered by a task.
CACHE = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more, the first included.

    Hashes of windows tell most texts that repeat none. Others' windows are compared exactly: runs of doubling length
    get ranks, and a window is two ranks.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n, np.uint64)
    for k in range(window):
        sums = sums * _MIX + mixed[k : k + n]
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0
    rank, size = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        size += step
        pair = rank[: len(ids) - size + 1] * np.int64(len(ids) + 1) + rank[step : step + len(ids) - size + 1]
        _, rank = np.unique(pair, return_inverse=True)
    many = np.bincount(rank)[rank] > 1
    if not many.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word, equal to an earlier line of the text."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and words(line))


def base_counts(text: str | None, parts: list[str], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    return (
        len(parts),
        sum(map(len, parts)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(ids),
    )


class Features:
    """Buckets of words, of the character 2- to 4-grams inside them, and of pairs of neighbours."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets = buckets

    def of_words(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of a word, bucket) for each word and each of its n-grams between boundary marks, and words' hashes."""
        hashes = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in some], np.uint64)
        sizes = np.array([len(w) + 2 for w in some], np.int64)
        points = np.frombuffer("".join(f"\x02{w}\x03" for w in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner, code = np.repeat(np.arange(len(some)), sizes), points.astype(np.uint64) + np.uint64(1)
        index, bucket = [np.arange(len(some))], [self._bucket(hashes)]
        gram = code
        for n in (2, 3, 4):
            gram = gram[: len(code) - n + 1] * _MIX + code[n - 1 :]
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
            index.append(owner[: len(inside)][inside])
            bucket.append(self._bucket(gram[inside]))
        return np.concatenate(index), np.concatenate(bucket), hashes

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
        return (mixed >> np.uint64(40)).astype(np.int64) % (self.buckets - 1) + 1

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket 0 is kept for a word that follows itself."""
        return np.where(hashes[:-1] == hashes[1:], 0, self._bucket(hashes[:-1] * _MIX + hashes[1:]))


def _inputs(text: str, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a training text: a word's share is spread over its buckets; pairs have shares of their own."""
    parts = words(text)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    kinds = Counter(parts)
    index, bucket, hashes = features.of_words(list(kinds))
    share = np.fromiter(kinds.values(), float, len(kinds)) / np.bincount(index) / len(parts)
    values = share[index]
    if len(parts) > 1:
        at = dict(zip(kinds, hashes, strict=True))
        pairs = features.pairs(np.array([at[w] for w in parts], np.uint64))
        bucket, values = np.append(bucket, pairs), np.append(values, np.full(len(pairs), 1.0 / len(pairs)))
    keys, where = np.unique(bucket, return_inverse=True)
    return keys, np.bincount(where, values)


def fit(sample: pd.DataFrame, buckets: int = BUCKETS, passes: int = 5, rate: float = 0.3) -> dict:
    """Adagrad on the log loss over four fifths of ``sample``, calibrated on the rest and one row of each label at +-1.

    A sample without rows gives the score 0.5 to all.
    """
    y = sample["label"].to_numpy(float)
    features = Features(buckets)
    rows = [_inputs(t, features) for t in sample["text"]]
    w, past = np.zeros(buckets), np.full(buckets, 1e-6)
    bias, order = float(logit(np.array([(y.sum() + 1) / (len(y) + 2)]))[0]), np.random.default_rng(11)
    train = np.array([i for i in range(len(y)) if i % 5])
    for _ in range(passes):
        for i in order.permutation(train):
            k, v = rows[i]
            g = sigmoid(np.array([w[k] @ v + bias]))[0] - y[i]
            d = g * v + 1e-6 * w[k]
            past[k] += d * d
            w[k] -= rate * d / np.sqrt(past[k])
            bias -= 0.01 * g
    out = np.array([w[k] @ v + bias for k, v in rows])
    slope, shift = platt(np.append(out[::5], [-1.0, 1.0]), np.append(y[::5], [0.0, 1.0]))
    return {"weights": w.astype(np.float32), "bias": bias, "slope": slope, "shift": shift}


class Scorer:
    """Scores texts with one model; what it remembers of words is bounded by ``CACHE`` words and one text's."""

    def __init__(self, model: dict) -> None:
        self.model, self.features = model, Features(len(model["weights"]))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shares, self.hashes = np.zeros(1 << 16), np.zeros(1 << 16, np.uint64)

    def learn(self, fresh: set[str]) -> None:
        if len(self.known) + len(fresh) > CACHE:
            self._forget()
        if not fresh:
            return
        some = list(fresh)
        index, bucket, hashes = self.features.of_words(some)
        n, m = len(self.known), len(self.known) + len(some)
        while m > len(self.shares):
            self.shares, self.hashes = np.resize(self.shares, 2 * len(self.shares)), np.resize(self.hashes, 2 * len(self.hashes))
        self.shares[n:m] = np.bincount(index, self.model["weights"][bucket]) / np.bincount(index)
        self.hashes[n:m] = hashes
        self.known.update(zip(some, range(n, m), strict=True))

    def rows(self, texts: list[str | None], size: int = 64) -> list[tuple]:
        """One tuple of base counts and score a text; words are learnt for ``size`` texts at a time."""
        out = []
        for k in range(0, len(texts), size):
            some = [(t, words(t)) for t in texts[k : k + size]]
            seen = set().union(*(p for _, p in some))
            fresh = {w for w in seen if w not in self.known}
            if len(self.known) + len(fresh) > CACHE:
                self._forget()
                fresh = seen
            self.learn(fresh)
            out += [self._row(t, p) for t, p in some]
        return out

    def _row(self, text: str | None, parts: list[str]) -> tuple:
        ids = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        x = self.model["bias"]
        if len(parts):
            x += self.shares[ids].mean()
        if len(parts) > 1:
            x += self.model["weights"][self.features.pairs(self.hashes[ids])].mean()
        score = float(sigmoid(np.array([self.model["slope"] * x + self.model["shift"]]))[0])
        return (*base_counts(text, parts, ids), score)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the base counts and the calibrated ``score`` of each row of ``docs`` (doc_id, text).

    Null and empty texts have no words and the score of the model's bias. Repeated rows each get a row.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = pd.DataFrame(scorer.rows(batch["text"].tolist()), columns=[*COUNTS, "score"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base rules and the regression's verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 1, -1, FIT_ROWS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= KEEP)).alias("kept"), "score"
    )
