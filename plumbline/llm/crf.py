"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line has measures of its own and of the lines before and after it; the field's two states, bad and good, are
linked between neighbouring lines. Forward-backward marginals of "good", weighted by the lines' lengths, make the
document's quality, which is calibrated to a probability. Document labels stand for the labels of all their lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, logit, platt, sigmoid, table, words

MOD, HELD, THRESHOLD = 5, 0, 0.3
#: Most labelled documents that the field is fitted on.
FIT_ROWS = 3000
SYMBOLS = "#*$%&<>"
OWN = 16


def line_measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """OWN measures of each line that has a word, and the lines' lengths; a text without such lines has none."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        parts = words(line)
        k = len(parts)
        if not k:
            continue
        n = len(line)
        kinds = set(parts)
        symbols = sum(map(line.count, SYMBOLS))
        bangs = line.count("!")
        rows.append(
            (
                1.0,
                n / (n + 80.0),
                k / (k + 12.0),
                min(n / k / 12.0, 2.0),
                min(4.0 * symbols / n, 2.0),
                float(symbols * 20 > n),
                min(8.0 * bangs / n, 2.0),
                min(4.0 * line.count("|") / n, 2.0),
                float(line.isupper()),
                sum(map(str.isupper, parts)) / k,
                sum(map(str.isdigit, parts)) / k,
                len(kinds) / k,
                sum(map(eq, parts, parts[1:])) / k,
                float(sum(map(eq, parts, parts[1:])) * 4 > k),
                float(line in seen),
                float(parts[-1][-1] in ".!?"),
            )
        )
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, OWN), np.array(sizes, np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's measures beside those of the lines before and after it, zero where there is none."""
    if not len(own):
        return np.zeros((0, 3 * OWN))
    none = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


def marginals(emit: np.ndarray, sizes: np.ndarray, link: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``emit`` (lines, 2) has the chains one after another, ``sizes`` their numbers of lines, ``link`` the 2 x 2 link
    scores. Returns the marginals (lines, 2), the pair marginals (2, 2), summed with each chain's ``share`` (1 if not given),
    and the chains' log normalisers.
    """
    order = np.argsort(-sizes, kind="stable")
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    long = sizes[order]
    live = [int(np.searchsorted(-long, -t, "left")) for t in range(int(long.max(initial=0)))]
    peak = emit.max(1, keepdims=True)
    e, m = np.exp(emit - peak), np.exp(link)
    alpha, scale = np.zeros_like(e), np.ones(len(e))
    for t, k in enumerate(live):
        at = first[:k] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ m) * e[at]
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    beta, pairs = np.ones_like(e), np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        at = first[: live[t + 1]] + t
        right = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = right @ m.T
        pairs += (alpha[at].T @ (right if share is None else right * share[order[: live[t + 1]], None])) * m
    ends = np.add.reduceat(np.log(scale) + peak[:, 0], np.sort(first)) if len(e) else np.zeros(0)
    return alpha * beta, pairs, ends


class Field:
    """Weights of the line measures (good against bad), and the link scores between states."""

    def __init__(self, weights: np.ndarray, link: np.ndarray, slope: float = 1.0, bias: float = 0.0) -> None:
        self.weights, self.link, self.slope, self.bias = weights, link, slope, bias

    def emissions(self, x: np.ndarray) -> np.ndarray:
        u = x @ self.weights / 2
        return np.stack([-u, u], 1)

    def good(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Length-weighted share of good lines by text (half for a text without lines), lines' marginals and lengths."""
        measured = [line_measures(t or "") for t in texts]
        counts = np.array([len(s) for _, s in measured], np.int64)
        share = np.full(len(texts), 0.5)
        lines: list[np.ndarray] = [np.zeros(0)] * len(texts)
        some = np.flatnonzero(counts)
        if len(some):
            x = np.concatenate([with_neighbours(measured[i][0]) for i in some])
            p = marginals(self.emissions(x), counts[some], self.link)[0][:, 1]
            for i, part in zip(some, np.split(p, np.cumsum(counts[some])[:-1]), strict=True):
                lines[i] = part
                share[i] = part @ measured[i][1] / measured[i][1].sum()
        return share, lines, [s for _, s in measured]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.slope * logit(np.clip(self.good(texts)[0], 1e-4, 1 - 1e-4)) + self.bias)


def gradient(field: Field, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the mean negative log-likelihood a line of each text: by the weights and by the links, and that mean itself.

    ``x`` has the texts' lines one after another, ``sizes`` their numbers of lines, and all lines of a text its label. A
    text counts as one however many lines it has.
    """
    line, share = np.repeat(labels, sizes), 1.0 / (sizes * len(sizes))
    emit = field.emissions(x)
    p, pairs, ends = marginals(emit, sizes, field.link, share)
    by_line = np.repeat(share, sizes)
    own = np.stack([(sizes - 1) * share * (labels == k) for k in (0, 1)], 1).sum(0)
    score = np.add.reduceat(emit[np.arange(len(line)), line], np.cumsum(sizes) - sizes) + (sizes - 1) * field.link[labels, labels]
    return x.T @ ((p[:, 1] - line) * by_line), pairs - np.diag(own), float(share @ (ends - score))


def fit(sample: pd.DataFrame, rounds: int = 100, rate: float = 0.15, ridge: float = 2e-4, stiff: float = 0.02) -> Field:
    """Adam on the mean conditional log-likelihood of whole texts, a line, by the weights and the links together.

    Both have Gaussian priors, the links a tighter one: document labels say that neighbours never differ, and without it
    links would grow until a text's lines had one label for good. Calibration adds one row of each label, at even shares
    nudged apart, so a sample without rows gives the score 0.5 to all.
    """
    field = Field(np.zeros(3 * OWN), np.zeros((2, 2)))
    y = sample["label"].to_numpy(int)
    blocks = [with_neighbours(line_measures(text)[0]) for text in sample["text"]]
    sizes = np.array([len(b) for b in blocks], np.int64)
    labels, some = y[sizes > 0], sizes[sizes > 0]
    if len(some):
        x = np.concatenate(blocks)
        now, m, v = np.zeros(3 * OWN + 4), np.zeros(3 * OWN + 4), np.zeros(3 * OWN + 4)
        prior = np.append(np.full(3 * OWN, ridge), np.full(4, stiff))
        for k in range(1, rounds + 1):
            grad = np.concatenate([g.ravel() for g in gradient(field, x, some, labels)[:2]]) + prior * now
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            now = now - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            field.weights, field.link = now[:-4], now[-4:].reshape(2, 2)
    share = np.append(field.good(sample["text"].tolist())[0], [0.45, 0.55])
    field.slope, field.bias = platt(logit(np.clip(share, 1e-4, 1 - 1e-4)), np.append(y, [0, 1]).astype(float))
    return field


def score_documents(docs: DataFrame, field: Field, size: int = 256) -> DataFrame:
    """doc_id, score, n_lines and bad_lines (lines likelier bad than good) of each row of ``docs`` (doc_id, text).

    Null and empty texts and texts of blanks have no lines and get the score of an even share. Repeated rows each
    get a row; other columns of ``docs`` are ignored.
    """
    weights = (field.weights, field.link, field.slope, field.bias)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Field(*weights)
        for batch in batches:
            texts = batch["text"].tolist()
            scores, n, bad = [], [], []
            for k in range(0, len(texts), size):
                share, lines, _ = f.good(texts[k : k + size])
                scores.append(sigmoid(f.slope * logit(np.clip(share, 1e-4, 1 - 1e-4)) + f.bias))
                n += [len(p) for p in lines]
                bad += [int((p < 0.5).sum()) for p in lines]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": flat, "n_lines": n, "bad_lines": bad})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {kind}, score double, n_lines long, bad_lines long"
    )


def fitted(spark, sf_dir: str, docs: DataFrame | None = None) -> Field:
    """The field fitted on the labelled rows of ``documents`` outside the held-out fold."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", MOD, HELD, FIT_ROWS))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of rows with crc32(doc_id) mod 5 = 0 are never read for the fit."""
    scored = score_documents(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), MOD) == HELD).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
        "n_lines",
        "bad_lines",
    )


def keep_good(docs: DataFrame, field: Field, size: int = 256) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores THRESHOLD or more."""
    weights = (field.weights, field.link, field.slope, field.bias)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Field(*weights)
        for texts in batches:
            all_ = texts.tolist()
            parts = [f.score(all_[k : k + size]) for k in range(0, len(all_), size)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(F.col("text").cast("string")) >= THRESHOLD)
