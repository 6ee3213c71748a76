"""Shared pieces of the training-data operators: inputs, samples, label folds, checkpoints."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Most bytes of texts that a sample brings to the driver, half of them for each label.
FIT_BYTES = 1 << 24


def words(text: str | None) -> list[str]:
    """The maximal runs of characters other than ASCII white space; none for null."""
    return WORD.findall(text) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster, whose hosts couldn't read that, an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


def counted(df: DataFrame) -> int:
    """Rows of a checkpoint. An aggregation would be a query with an exchange, and Spark's driver keeps threads of each for a minute."""
    return df._jdf.queryExecution().toRdd().count()


def settled(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A checkpoint read in as many partitions as its rows need, so that many steps on little data make few files."""
    out = checkpointed(df)
    return out.coalesce(1 + counted(out) // rows)


def free(prefix: str, *frames: DataFrame) -> str:
    """``prefix`` with as many underscores before it as make it begin no column of ``frames``, whatever the case."""
    taken = [c.lower() for f in frames for c in f.columns]
    while any(c.startswith(prefix.lower()) for c in taken):
        prefix = "_" + prefix
    return prefix


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int
) -> pd.DataFrame:
    """Up to ``rows`` labelled documents outside fold ``held``, in a stable order, on the driver.

    The rows are those with the smallest hash of their id, so the sample doesn't depend on partitions. Rows with a
    null id, text or label, or a label other than 0 and 1, and ids with both labels are left out; of an id's texts the one
    with the least hash counts. ``rows`` and FIT_BYTES bound what reaches the driver: texts come whole, and where they are
    too long for all of them, those that still fit come first by the same hash; a label none of whose texts fits has its shortest.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), mod) != held))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    both = texts.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
    once = both.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    once = checkpointed(once.select("doc_id", "least.text", "label"))
    sizes = once.select("label", F.octet_length("text"), F.xxhash64(F.lit(7), "doc_id"), "doc_id").collect()
    if sum(r[1] for r in sizes) > FIT_BYTES:
        once = once.where(F.col("doc_id").isin(_fitting([tuple(r) for r in sizes])))
    got = once.toPandas()
    return got.sort_values("doc_id", kind="stable").reset_index(drop=True)


def _fitting(sizes: list[tuple]) -> list:
    """The ids of rows (label, bytes, hash, id) whose texts fit into FIT_BYTES, half of it for each label."""
    out = []
    for label in (0, 1):
        own = sorted((r for r in sizes if r[0] == label), key=lambda r: (r[2], r[3]))
        left, found = FIT_BYTES // 2, []
        for _, size, _, id_ in own:
            if size <= left:
                left -= size
                found.append(id_)
        out += found or [min(own, key=lambda r: r[1])[3]] if own else []
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (x, y), by damped Newton steps; slope never negative."""
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = sigmoid(design @ w)
        grad = design.T @ (p - y) + ridge * np.array([w[0] - 1.0, 0.0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.diag([1.0, 1e-3]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])
