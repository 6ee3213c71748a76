"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the corpus's words by weight, up to a multiple of their own size. A source takes complete epochs of all
its documents first; the fraction of an epoch that is left goes to the documents with the least exponential keys,
``-ln(u) / w`` with w the document's quality weight, by prefix sums up to the budget. Quality weights are a logistic
curve of a few measures of the text, fitted to labels. Keys fall into ranges, more of them the more rows a source has, so
prefix sums are those of a source's ranges plus those inside a range, and no source is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free, sigmoid, table

#: The weights of the sources in order, repeating; the most times that a source may be taken.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: About so many rows of a source fall into a range of keys.
RANGE = 2_000
#: Most labelled documents that the quality weights are fitted on; the least weight.
FIT_ROWS, LEAST = 3000, 0.05


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def measures(text: Column, size: Column) -> list[Column]:
    """Shares of a text, each in about [0, 1]: signs, exclamation marks and bars, digits, capitals, and long words."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    long = F.least(F.lit(1.0), n / (40.0 * F.greatest(size, F.lit(1))))
    found = [20 * share("#*$%&<>"), 20 * share("!|"), 5 * share("0123456789"), 2 * share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), long]
    return [F.coalesce(F.least(F.lit(1.0), x), F.lit(0.0)) for x in found]


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """An intercept and a coefficient for each measure: logistic regression on up to FIT_ROWS labelled documents.

    These are the rows with the least hash of their id. Coefficients are zero without labels of both kinds, but for an
    even intercept. Nothing but the measures of these rows reaches the driver.
    """
    text = F.col("text").cast("string")
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(FIT_ROWS).select("doc_id", "label")
    both = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    once = both.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    rows = once.select("label", *(x.alias(f"x{i}") for i, x in enumerate(measures(F.col("least.text"), word_count(F.col("least.text"))))))
    got = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, 6)
    got = got[np.lexsort(got.T)]  # sums don't depend on the order that rows arrive in
    x, y = np.hstack([np.ones((len(got), 1)), got[:, 1:]]), got[:, 0]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
        w -= np.clip(step, -3, 3)
    return [round(float(v), 6) for v in w]


def quality_weight(text: Column, size: Column, model: list[float]) -> Column:
    """Between LEAST and 1: how likely the text is good, by its measures."""
    line = F.lit(model[0])
    for w, x in zip(model[1:], measures(text, size), strict=True):
        line = line + F.lit(w) * x
    return F.greatest(F.lit(LEAST), 1.0 / (1.0 + F.exp(-line)))


def numbered(sizes: DataFrame) -> DataFrame:
    """Adds ``n``: the place of each source by code point, from 0, null last. Sources are sorted by ranges, not in one task."""
    c = checkpointed(sizes.orderBy(F.col("source").isNull(), "source")).withColumn("place", F.monotonically_increasing_id())
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(map(tuple, c.groupBy(part.cast("int").alias("part")).count().collect()))  # a row a partition
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    start = F.element_at(F.create_map(*(F.lit(x) for p in before.items() for x in p)), part.cast("int")) if before else F.lit(0)
    return c.withColumn("n", start + inside).drop("place")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): shares of the total by weight, none above MOST times its size.

    What a source can't take is shared anew by weight among the rest, until none is above. One row a source; each round
    is an aggregation, so no task sees all sources.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS)).cast("int") + 1)
    ranked = checkpointed(numbered(sizes).withColumn("w", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double")))
    sums = lambda full: ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.sum("source_size")).first()
    level, before = 0.0, -1.0
    while level > before:
        taken, weights, total = sums(F.col("cap") < level * F.col("w"))
        before, level = level, max(level, ((total or 0) - (taken or 0.0)) / weights) if weights else level
    return ranked.select(*sizes.columns, F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def mixed(docs: DataFrame, model: list[float], seed: int = 5) -> DataFrame:
    """doc_id, copy, size, source_size, target, ``taken`` and ``epochs`` of each row of ``docs`` (doc_id, text, source).

    ``model`` gives the quality weights. ``epochs`` is how often the row is taken whole, and ``taken`` its words in the
    mix. The document on which a budget ends is taken if more than half of it is within, so a source misses its target by
    less than one document. Null texts have no words; rows without words are taken as often as their source's complete
    epochs. Keys hash doc_id, text and seed, so reruns agree, and repeated rows share a key and are told apart by number
    only.
    """
    size = word_count(F.col("text"))
    u = (F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float((1 << 52) + 1)
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("copy"), size.alias("size"), u.alias("u"), F.col("text"))
    rows = rows.withColumn("key", -F.log("u") / quality_weight(F.col("text"), F.col("size"), model))
    rows = checkpointed(rows.select("doc_id", "source", "copy", "size", "key"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = source_targets(sums)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(1)
    goals = goals.withColumn("whole", epochs.cast("long")).select(
        F.col("source").alias("s"), "source_size", "target", "whole",
        F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.ceil(F.col("rows") / RANGE).cast("int").alias("ranges"),
    )
    dealt = rows.join(goals, rows["source"].eqNullSafe(goals["s"]), "left").drop("s")
    dealt = dealt.withColumn("range", F.floor((1.0 - F.exp(-F.col("key"))) * F.col("ranges")).cast("int"))
    ranges = dealt.groupBy("source", "range").agg(F.sum("size").alias("words"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(by_range), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["range"] == starts["r"]))
    more = (F.col("before") + F.col("inside") + F.col("size") / 2.0 < F.col("left")) & (F.col("size") > 0)
    out = both.withColumn("epochs", F.col("whole") + F.when(more, 1).otherwise(0))
    taken = (F.col("epochs") * F.col("size")).alias("taken")
    return out.select("doc_id", "source", "copy", "size", "source_size", "target", taken, "epochs")


def repeated_to_targets(docs: DataFrame, model: list[float]) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows with equal doc_id, source and text count as equal; what is left of an epoch repeats the columns of any of them.
    """
    c = free("k_", docs)
    id_, source, copy, own_copy, times, rows = (c + x for x in ("id", "source", "copy", "own", "times", "rows"))
    found = mixed(docs.select("doc_id", "text", "source"), model)
    found = found.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("copy").alias(copy), "epochs")
    # equal rows may be taken unequally: the least number for all of them, and one more for as many as it takes
    found = found.groupBy(id_, source, copy).agg(F.sum("epochs").alias(times), F.count("*").alias(rows))
    own = docs.withColumn(own_copy, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own_copy) == F.col(copy))
    both = own.join(found, same)
    number = lambda x: F.explode(F.sequence(F.lit(1), x.cast("int")))
    even = both.where(F.col(times) >= F.col(rows)).withColumn(c + "k", number(F.floor(F.col(times) / F.col(rows))))
    # equal rows of which some are taken once more are combined, then made anew; a key's rows are never numbered
    uneven = both.where(F.col(times) % F.col(rows) > 0).groupBy(id_, source, copy).agg(
        F.first(F.struct(*(F.col(f"`{x}`") for x in docs.columns))).alias(c + "row"), F.first(F.col(times) % F.col(rows)).alias(times)
    )
    more = uneven.withColumn(c + "k", number(F.col(times))).select(*(F.col(f"{c}row.`{x}`") for x in docs.columns))
    return even.select(*(F.col(f"`{x}`") for x in docs.columns)).unionByName(more)


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = table(spark, sf_dir, "documents")
    found = mixed(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "size", "source_size", "target", "taken", "epochs")
