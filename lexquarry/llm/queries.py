"""The subpackage's queries for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, filter_audit, hard_negatives, mixing, ngram_join, packing, quality, secret_scan, sharding, substring_dedup, toxicity, warc, wavelet
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.query,
    "op2_mixing": mixing.query,
    "op3_ngram_join": ngram_join.query,
    "op4_warc": warc.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_packing": packing.query,
    "op7_wavelet": wavelet.query,
    "op8_quality": quality.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_sharding": sharding.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_filter_audit": filter_audit.query,
    "op13_toxicity": toxicity.query,
}

__all__ = ["ORACLES", "QUERIES"]
