"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are folded (lower case, homoglyphs, accents, digit and sign substitutions, stretched and spaced letters) before
matching; words with accents are matched as written, too. Entries are words and word beginnings that mark toxic labels,
weighted by their log odds, and an entry inside an exception phrase doesn't count. The weight of a document's entries
is divided by a power of its length, which the labels choose, and calibrated to a probability.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from statistics import NormalDist

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, platt, sigmoid, table

MOD, HELD, THRESHOLD = 4, 2, 0.3
#: Most labelled documents that the lexicon is fitted on.
FIT_ROWS = 4000

#: Word beginnings of so many letters can be entries. So many chance entries are expected among all that are tested.
STEMS, CHANCE = range(3, 13), 0.5
#: Powers of the length that the labels choose from.
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Phrases in which an entry is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash collection", "clown fish", "garbage collection",
    "garbage collector", "garbage can", "garbage truck", "rodeo clown", "dumb bell", "not stupid", "sore loser rule",
)
#: Characters that stand for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "ɡ": "g", "ո": "n", "ս": "u", "α": "a",
    "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "ω": "w", "ı": "i", "ł": "l",
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e",
    "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ù": "u",
    "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "ß": "ss",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}
#: Removed inside words: soft hyphen, zero-width characters, byte order mark.
INVISIBLE = "­​‌‍⁠﻿"


def _folding() -> dict[int, str]:
    """A translation table: look-alikes to letters, full-width forms to ASCII, ASCII punctuation and blanks to a space."""
    out = {c: " " for c in range(128) if not chr(c).isalnum()}
    for c in range(26):
        out[ord("A") + c] = out[0xFF21 + c] = out[0xFF41 + c] = chr(ord("a") + c)
    for k, v in LOOKALIKES.items():
        out[ord(k)] = v
        if len(k.upper()) == 1 and not k.isascii():
            out.setdefault(ord(k.upper()), v)
    out.update({ord(c): "" for c in INVISIBLE} | {ord(c): " " for c in " ‘’“”–—…"})
    return out


FOLDING = _folding()

class _Table(dict):
    """``str.translate`` keeps what is missing; caching that spares the failed look-ups."""

    def __missing__(self, key: int) -> int:
        low = chr(key).lower()
        self[key] = low if len(low) == 1 else key
        return self[key]


_FOLD = _Table(FOLDING)


#: A letter that occurs three times or more in a row; four single letters or more with a blank between each. Most texts have
#: none, which the cheaper tests tell.
_STRETCHED, _SPACED = re.compile(r"([a-z])\1{2,}"), re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")
_TRIPLES, _SINGLES = [chr(c) * 3 for c in range(ord("a"), ord("z") + 1)], re.compile(r" \w \w \w ")
#: A word in parts, as by hyphens, dots or asterisks.
_PARTED, _PARTS = re.compile(r"[^\W\d_]+(?:[-._*'’][^\W\d_]+)+"), re.compile(r"(?<=[^\W\d_])[-._*'’](?=[^\W\d_])")
_SIGNS = "!|$@"


def _joined(m: re.Match) -> str:
    """A word in parts and its parts joined; single letters only joined, as they would make the same word again."""
    word = re.sub(r"[^\w]|_", "", m[0])
    return word if len(m[0]) == 2 * len(word) - 1 else f"{m[0]} {word}"


def folded(text: str) -> str:
    """The text as lower-case Latin words with a blank between each.

    Signs stand for letters only between other characters of a word; stretched letters count once, single letters in a
    row make a word unless all are the same, and a word in parts is followed by its parts joined, or replaced where all
    parts are single letters.
    """
    if any(c in text for c in _SIGNS):
        text = " ".join(w if w.isalnum() else w.strip("!|$@.,;:?*#%&()[]\"'") for w in text.split())
    if _PARTS.search(text):
        text = _PARTED.sub(_joined, text)
    line = " ".join(text.translate(_FOLD).split())
    if _SINGLES.search(line) or len(line) < 8:
        line = _SPACED.sub(lambda m: m[0].replace(" ", "") if len(set(m[0])) > 2 else m[0], line)
    if any(t in line for t in _TRIPLES):
        line = _STRETCHED.sub(r"\1", line)
    return line


_WORD = re.compile(r"[^\W\d_]+")


def accented(text: str) -> list[str]:
    """The lower-case words of the text with letters beyond ASCII."""
    if text.isascii():
        return []
    return [w for part in text.lower().split() if not part.isascii() for w in _WORD.findall(part) if not w.isascii()]


def views(text: str) -> tuple[str, int]:
    """What is matched, with a blank at both ends and two before the accented words, and the number of folded words."""
    line = folded(text)
    more = accented(text)
    return f" {line} " + (" " + " ".join(more) + " " if more else ""), line.count(" ") + 1 if line else 0


def distinct_texts(texts: list[str]) -> list[int]:
    """Places of texts that share no least hash of three-word shingles, by four orders, with an earlier one.

    Copies and near copies would count chance words as often as they are copied.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for i, text in enumerate(texts):
        h = np.array([zlib.crc32(w) for w in text.encode("utf-8", "replace").split()] or [0], np.uint64)
        if len(h) > 2:
            h = (h[:-2] * _ODD + h[1:-1]) * _ODD + h[2:]
        marks = {(k, int(((h ^ np.uint64(k)) * (_ODD + np.uint64(2 * k)) >> np.uint64(8)).min())) for k in range(4)}
        if not marks & seen:
            out.append(i)
        seen |= marks
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


class Evidence:
    """In how many toxic and other texts, copies left out, each word and word beginning (``stem*``) is, by fifth."""

    def __init__(self, texts: list[str], labels: list[int]) -> None:
        self.fifth = [zlib.crc32(t.encode("utf-8", "replace")) % 5 for t in texts]
        self.size = np.zeros((5, 2), np.int64)
        toxic, other = [Counter() for _ in range(5)], [Counter() for _ in range(5)]
        kept = distinct_texts(texts)
        for i in kept:
            self.size[self.fifth[i], labels[i]] += 1
            if labels[i]:
                found = set(views(texts[i])[0].split())
                toxic[self.fifth[i]].update(found | {w[:k] + "*" for w in found for k in STEMS if k <= len(w)})
        sums = sum(toxic, Counter())
        # an entry in fewer toxic texts than these isn't sure even if no other text has it
        share = self.size[:, 1].sum() / max(1, self.size.sum())
        self.tested = sum(len(w.rstrip("*")) >= STEMS[0] for w in sums)
        self.sure = NormalDist().inv_cdf(1 - min(0.5, CHANCE / max(1, self.tested)))
        least = self.sure**2 / (-2 * math.log(share)) if 0 < share < 1 else math.inf
        self.entries = [w for w, n in sums.items() if n >= least and len(w.rstrip("*")) >= STEMS[0]]
        wanted = set(self.entries)
        for i in kept:
            if not labels[i]:
                found = set(views(texts[i])[0].split())
                other[self.fifth[i]].update(wanted & (found | {w[:k] + "*" for w in found for k in STEMS if k <= len(w)}))
        self.counts = np.array([[[toxic[f][w], other[f][w]] for f in range(5)] for w in self.entries], np.int64).reshape(-1, 5, 2)

    def lexicon(self, without: int | None = None) -> dict[str, float]:
        """Entries and their weights, from all texts or those not of one fifth."""
        some = [f for f in range(5) if f != without]
        n0, n1 = self.size[some].sum(0).astype(float)
        if not n0 or not n1:
            return {}
        a, b = self.counts[:, some, 0].sum(1).astype(float), self.counts[:, some, 1].sum(1).astype(float)
        xlogy = lambda x, y: x * np.log(np.where(x > 0, y, 1.0))
        part = lambda k, n: xlogy(k, k / np.maximum(n, 1)) + xlogy(n - k, (n - k) / np.maximum(n, 1))
        whole = part(np.array(n1), np.array(n0 + n1))
        ratio = np.sqrt(np.maximum(0, 2 * (part(a, a + b) + part(n1 - a, n0 + n1 - a - b) - whole)))
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        weight = np.minimum(1.0, odds / 6.0)
        out: dict[str, float] = {}
        taken: set[str] = set()
        begun: set[str] = set()  # the beginnings of what is taken
        sure = np.flatnonzero((ratio > self.sure) & (a * n0 > b * n1) & (weight > 0))
        for i in sorted(sure, key=lambda i: (-ratio[i], -len(self.entries[i]), self.entries[i])):
            stem = self.entries[i].rstrip("*")
            both = {stem, stem.translate(_FOLD)}
            if not any(s in begun or any(s[:k] in taken for k in range(1, len(s) + 1)) for s in both):
                out[self.entries[i]] = float(weight[i])
                taken |= both
                begun |= {s[:k] for s in both for k in range(1, len(s) + 1)}
        return out


def lexicon_from(sample: pd.DataFrame) -> dict[str, float]:
    """Words and word beginnings (``stem*``) that mark toxic labels, weighted in (0, 1] by their smoothed log odds.

    An entry is in more toxic texts than chance explains, by the likelihood ratio, if CHANCE entries may be by chance
    among all that are tested; of beginnings that cover one another the surest counts. No labels of either kind give
    no entries.
    """
    return Evidence(sample["text"].tolist(), sample["label"].tolist()).lexicon()


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w, weight in lexicon.items():
        if k := w.rstrip("*"):
            k = f" {k}" if w.endswith("*") else f" {k} "
            out.add_word(k, (len(k), weight))
    for phrase in exceptions:
        k = folded(phrase)
        out.add_word(f" {k} ", (len(k) + 2, None))
    out.make_automaton()
    return out


def matched(text: str | None, machine: ahocorasick.Automaton) -> tuple[float, int, int]:
    """Weight of entries outside exceptions, their number, and the number of words."""
    if not text:
        return 0.0, 0, 0
    line, n_words = views(text)
    if not len(machine):
        return 0.0, 0, n_words
    spans, safe = [], []
    for end, (size, weight) in machine.iter(line):
        (safe if weight is None else spans).append((end - size + 1, end, weight))
    if safe and spans:
        safe.sort(key=lambda x: x[0])
        starts, reach = [x[0] for x in safe], list(accumulate((x[1] for x in safe), max))
        inside = lambda a, b: (k := bisect.bisect_right(starts, a)) and reach[k - 1] >= b
        spans = [x for x in spans if not inside(x[0], x[1])]
    return float(sum(x[2] for x in spans)), len(spans), n_words


def raw_score(weight: float, count: int, n_words: int, power: float) -> float:
    """Weight by a power of the length, about that of a text of 200 words."""
    return weight * (250.0 / (n_words + 50.0)) ** power if count else 0.0


def calibrated(found: list[tuple], y: np.ndarray) -> tuple[float, float, float, float]:
    """(power, slope, bias, loss) of the power of the length under which labels are likeliest.

    Two rows are added, a text without entries that isn't toxic and one with an entry that is; no labels leave these.
    """
    best = None
    y = np.append(y, [0.0, 1.0])
    for power in POWERS:
        raw = np.log1p([*(raw_score(*x, power) for x in found), 0.0, 1.0])
        slope, bias = platt(raw, y)
        p = np.clip(sigmoid(slope * raw + bias), 1e-9, 1 - 1e-9)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[3] - 1e-12:
            best = (power, slope, bias, loss)
    return best


def fit(sample: pd.DataFrame) -> dict:
    """The lexicon of the whole sample; its calibration by entries that each fifth of the sample had no part in."""
    texts, found = sample["text"].tolist(), [(0.0, 0, 0)] * len(sample)
    evidence = Evidence(texts, sample["label"].tolist())
    for f in range(5):
        machine = automaton(evidence.lexicon(f))
        for i, of in enumerate(evidence.fifth):
            if of == f:
                found[i] = matched(texts[i], machine)
    power, slope, bias, _ = calibrated(found, sample["label"].to_numpy(float))
    return {"lexicon": evidence.lexicon(), "power": power, "slope": slope, "bias": bias}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, weight, entries and n_words of each row of ``docs`` (doc_id, text).

    Null and empty texts have no entries and get the score of a text without entries. Repeated rows each get a row.
    """
    packed = json.dumps(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = json.loads(packed)
        machine = automaton(m["lexicon"])
        for batch in batches:
            found = [matched(t, machine) for t in batch["text"]]
            raw = np.log1p([raw_score(*x, m["power"]) for x in found])
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "score": sigmoid(m["slope"] * raw + m["bias"]),
                    "weight": [x[0] for x in found],
                    "entries": [x[1] for x in found],
                    "n_words": [x[2] for x in found],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {kind}, score double, weight double, entries long, n_words long"
    )


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of rows with crc32(doc_id) mod 4 = 2 are never read for the fit."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", MOD, HELD, FIT_ROWS))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), MOD) == HELD).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
        "entries",
    )
