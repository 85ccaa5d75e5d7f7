"""Registered query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch
from .quality import judged


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scratch = Scratch(spark)
    rows = judged(docs, labels, carry=["doc_id"], scratch=scratch)
    return scratch.result(rows.select("rec.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
