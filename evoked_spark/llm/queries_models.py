"""Registered queries of the trained models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, toxicity
from .common import Scratch


def fold(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold(3) != 1)
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    out = toxicity.scored(docs, model)
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(fold(10) == 0, F.lit(False))
    scratch = Scratch(spark)
    return scratch.result(hmm.scored(docs, held_out, scratch=scratch).withColumnRenamed("id", "doc_id"))
