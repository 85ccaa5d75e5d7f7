"""A training corpus from ``documents``: filter, deduplicate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import pathlib
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoked_spark.llm import pieces
from evoked_spark.llm.common import Scratch
from evoked_spark.llm.exact_dedup import drop_exact_copies
from evoked_spark.llm.mixing import mixed
from evoked_spark.llm.quality import judged
from evoked_spark.llm.queries_text import MODEL_PATH
from evoked_spark.llm.simhash import drop_near_copies


class Owned:
    """Scratch tables of stages that are called without one.

    They belong to the DataFrame that the stage returned: once that object is
    gone, the next call of any stage deletes them.  A stage keeps its input, so
    results that are handed on without being written stay readable as well.
    Who goes on with a frame derived from a result, and calls more stages, keeps
    the result or hands the stage a ``Scratch`` of their own.
    """

    def __init__(self):
        self.stages: list[tuple[weakref.ref, Scratch, DataFrame]] = []

    def clear_unused(self) -> None:
        while gone := [scratch for result, scratch, _ in self.stages if result() is None]:
            self.stages = [s for s in self.stages if s[1] not in gone]  # lets go of inputs, which can free the stage before
            for scratch in gone:
                scratch.clear()

    def result(self, stage: Callable[[Scratch], DataFrame], spark: SparkSession, docs: DataFrame, scratch: Scratch | None) -> DataFrame:
        if scratch is not None:
            return stage(scratch)
        self.clear_unused()
        own = Scratch(spark)
        out = stage(own)
        self.stages.append((weakref.ref(out), own, docs))
        return out


_owned = Owned()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Drops what the base rules or a certified rule of its language reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return _owned.result(lambda own: judged(docs, labels, scratch=own).where("kept").select("rec.*"), spark, docs, scratch)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return _owned.result(lambda own: drop_exact_copies(docs, scratch=own), spark, docs, scratch)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return _owned.result(lambda own: drop_near_copies(docs, scratch=own), spark, docs, scratch)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return _owned.result(lambda own: mixed(docs, scratch=own), spark, docs, scratch)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The ids of every document, and whether decoding them gives its text back."""
    model = pathlib.Path(MODEL_PATH).read_bytes()

    def encoded(own: Scratch) -> DataFrame:
        rows = pieces.encoded(docs, model, carry=["doc_id", "lang", "source"], verify=True, scratch=own)
        return rows.select("rec.doc_id", "rec.lang", "rec.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")

    return _owned.result(encoded, spark, docs, scratch)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("tokenize", tokenize)]

#: Fingerprints and certified thresholds aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of its scratch tables only the result is left."""
    kept, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        own = Scratch(spark)
        docs = kept.result(stage(spark, docs, sf_dir, scratch=own))
        own.clear()
    return docs
