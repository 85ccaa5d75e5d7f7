"""Registered queries of periodic runs, lines and spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, words
from .lines import without_common_lines
from .periodic import periodic_runs
from .spelling import spelling_forms, word_runs


def made_periodic(text: Column, id_text: Column) -> Column:
    """The text with its words from a place on repeated with a period, where the crc32 of the id says so."""
    h = F.crc32(id_text.cast("binary"))

    def repeat(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = lambda at: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.get(w, F.when(i < at[0], i).otherwise(at[0] + (i - at[0]) % at[1]).cast("int")))
        return F.array_join(F.get(F.transform(F.array(F.array(a, p)), again), F.lit(0)), " ")

    planted = F.get(F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, repeat(w))), F.lit(0))  # the words are split once
    return F.when(h % 10 == 0, F.coalesce(planted, text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    planted = docs.withColumn("text", made_periodic(F.col("text"), F.col("doc_id").cast("string")))
    rows = periodic_runs(planted, carry=["doc_id"])
    ahead = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    order = lambda a, b: F.when(ahead(a, b) != 0, -F.signum(ahead(a, b))).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")
    best = F.get(F.array_sort("runs", order), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = rows.select("rec.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    rows = without_common_lines(docs, carry=["doc_id"], scratch=scratch)
    return scratch.result(rows.select("rec.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


OP12_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS body, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keep AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def with_typos(words_of_docs: DataFrame) -> DataFrame:
    """``word_runs`` with a letter deleted where the crc32 of id and word says so; a null id counts as empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    at = (h % F.length("word")).cast("int")
    deleted = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return words_of_docs.select(F.when(h % 199 == 0, deleted).otherwise(F.col("word")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    return scratch.result(spelling_forms(with_typos(word_runs(docs)), scratch=scratch))
