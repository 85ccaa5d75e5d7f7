"""Registered queries of chat formatting and archives."""

from __future__ import annotations

import pathlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, pieces, warc
from .common import Scratch

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark)
    messages = scratch.save(chat.conversation_tree(rows.unionByName(planted)))
    done = chat.digests(chat.formatted(chat.chosen_paths(messages, scratch=scratch), messages.select("tree", "node", "role", "text")))
    conv_id = F.when(F.col("tree") != "null", F.col("tree")).cast("long")
    return scratch.result(done.select(conv_id.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))


_MARKS = r"'\\|<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]'"
OP6_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(23 + length(role) + length(text) + len(regexp_extract_all(role, {_MARKS})) + len(regexp_extract_all(text, {_MARKS}))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archives made from ``pages``, with the verdict of an audit against a damaged replica.

    The replica is derived from the same pages, by the md5 of their ids: where
    it starts with 00 the first character of the payload is overwritten, with 01
    a character is put before it, and with 02 the record is missing.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    other = F.when(F.col("html").startswith("!"), "?").otherwise("!")
    html = F.when((kind == "00") & (F.length("html") > 0), F.concat(other, F.expr("substring(html, 2)"))).when(kind == "01", F.concat(F.lit("!"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    damaged = pages.where(F.coalesce(kind != "02", F.lit(True))).withColumn("html", html)
    n_files = warc.files_needed(pages)
    ours, theirs = warc.leaves(pages, n_files), warc.leaves(damaged, n_files)
    scratch = Scratch(spark)
    rows = warc.audited(ours, theirs, scratch).where("verdict <> 'extra'")
    return scratch.result(rows.select("page_id", "archive", F.col("start").alias("record_offset"), F.col("length").alias("record_length"), F.col("digest").alias("record_sha256"), (F.col("verdict") != "same").alias("corrupt"), "verdict"))


OP2_SQL = """
WITH records AS (
  SELECT page_id, url, md5(CAST(page_id AS VARCHAR)) AS m, coalesce(html, '') AS html,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
n AS (SELECT greatest(1, CAST(ceil(sum(strlen(html) + 300) / 16777216.0) AS BIGINT)) AS files FROM records),
placed AS (
  SELECT *, CAST('0x' || substr(m, 1, 8) AS BIGINT) % (SELECT files FROM n) AS archive, strlen(record) AS record_length FROM records)
SELECT page_id, archive,
       CAST(sum(record_length) OVER (PARTITION BY archive ORDER BY page_id, url ROWS UNBOUNDED PRECEDING) - record_length AS BIGINT) AS record_offset,
       record_length, sha256(record) AS record_sha256,
       substr(m, 1, 2) = '00' AND length(html) > 0 OR substr(m, 1, 2) IN ('01', '02') AS corrupt,
       CASE WHEN substr(m, 1, 2) = '00' AND length(html) > 0 OR substr(m, 1, 2) = '01' THEN 'differs'
            WHEN substr(m, 1, 2) = '02' THEN 'missing' ELSE 'same' END AS verdict
FROM placed
"""


#: Where the public tokenizers lie; a parameter of the query.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Ids of every whole text as count and digest, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = pathlib.Path(model_path).read_bytes()
    docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    scratch = Scratch(spark)
    rows = pieces.encoded(docs, model, carry=["doc_id", "n_chars"], verify=True, scratch=scratch)
    return scratch.result(rows.select("rec.doc_id", "rec.n_chars", F.col("n_chunks").cast("long").alias("n_chunks"), F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"), "round_trip"))
