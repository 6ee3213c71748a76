"""Lineage cuts for loops that run on the driver."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> str:
    """The folder of checkpoints: the one that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master gets a temporary folder; a cluster, whose hosts couldn't read that, an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    prepared(frame.sparkSession)
    return frame.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below that of the checkpoints."""
    return f"{prepared(spark)}/{name}-{uuid.uuid4().hex}"
