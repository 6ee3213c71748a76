"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .crf import op3_quality_classifier
from .fingerprint import op2_fingerprint
from .linededup import op9_line_dedup
from .mixing import op5_source_mix
from .packing import op4_best_fit_packing
from .rules import op6_quality_rules
from .secrets import op8_secret_scan
from .simhash import op7_simhash
from .toxicity import op10_toxicity
from .urls import op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_fingerprint": op2_fingerprint,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_source_mix": op5_source_mix,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {}
