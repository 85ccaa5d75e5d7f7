"""Registered query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .mixing import fair_queue


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    scratch = Scratch(spark)
    mix = fair_queue(docs, carry=["doc_id"], scratch=scratch)
    return scratch.result(mix.select("rec.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


#: Common table expressions that mix the relation ``{docs}`` (doc_id, source, text).
MIX_CTES = """
sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM {docs}),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM sized GROUP BY source),
capped0 AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM src),
capped1 AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM capped0),
capped2 AS (
  SELECT *, CAST(CAST(sum(cap) OVER (ORDER BY ratio, rk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS DOUBLE)
            + ratio * CAST(sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, rk ROWS UNBOUNDED PRECEDING) AS DOUBLE) <= budget AS capped
  FROM capped1),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE least(CAST(cap AS DOUBLE),
                         (budget - CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE))
                         / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) * weight) END AS target
  FROM capped2),
queue AS (
  SELECT s.doc_id, s.source, s.size, s.place, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queued
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(queued + c * source_size AS DOUBLE) / nullif(target, 0) AS finish FROM queue, (VALUES (0), (1)) AS v(c)),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, coalesce(doc_id, -1), size RANGE UNBOUNDED PRECEDING) AS running
  FROM copies WHERE finish IS NOT NULL),
verdict AS (
  SELECT *, running <= (SELECT sum(target) FROM targets) AS inside FROM ordered)
"""

OP5_SQL = "WITH " + MIX_CTES.format(docs="documents") + """
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(q.size * coalesce((SELECT count(*) FROM verdict v WHERE v.inside AND v.place = q.place AND v.queued = q.queued
                               AND v.source IS NOT DISTINCT FROM q.source), 0) AS BIGINT) AS taken
FROM queue q
"""
