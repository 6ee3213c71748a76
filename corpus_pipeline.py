"""The training-data pipeline: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import crf, linededup, mixing, packing, simhash
from plumbline.llm.common import checkpointed, free, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at its threshold or above; fitted on the labelled rows of ``documents``."""
    kept = crf.keep_good(docs, crf.fitted(spark, sf_dir))
    return kept


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document that loses all its words goes. ``n_chars`` follows."""
    name = free("removed", docs)
    out = linededup.dedup_lines(docs, name)
    left = out.where((F.col(name) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id: texts whose five-word shingles are alike
    by 0.8 or more."""
    return simhash.keep_one_of_each(docs, size=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them; quality weights fitted on the labelled rows
    of ``documents``."""
    model = mixing.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.repeated_to_targets(docs, model)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]
#: The classifier, shingle hashes and tokens are beyond SQL; a brute-force version is held against ``run`` in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
