"""Reading recordings, marker files and behavioural code lists; any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import recording_number
from .binary_frames import BinaryFrames


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def discover(spark: SparkSession, folder: str, pattern: str = "*.vhdr") -> DataFrame:
    """``(recording, path)`` of the matching files, without reading them; fails when there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(stem(F.col("path")).alias("recording"), "path")
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found.orderBy("recording")


def read_frames(spark: SparkSession, folder: str, block_size: int, partitions: int | None = None, partition_bytes: int | None = None) -> DataFrame:
    """``frames``: blocks of ``block_size`` samples of all channels, in volts, of every recording in a folder.

    A recording is split by ranges of frames into ``partitions``, or into as
    many as have about ``partition_bytes``.  A data file without a header is
    ignored, and so is a header without data; frames that are cut off at the
    end of a file are left out.
    """
    spark.dataSource.register(BinaryFrames)
    given = {"partitions": partitions, "partitionBytes": partition_bytes}
    options = {k: str(v) for k, v in given.items() if v is not None}
    return spark.read.format("binary_frames").options(path=folder, blockSize=str(block_size), **options).load()


def parse_markers(lines: DataFrame) -> DataFrame:
    """``markers`` from ``lines(recording, value)``: rows ``Mk<n>=type,description,position,size,channel``.

    Lines with fewer than five fields are skipped; numbers may be written as
    floats and are cut.
    """
    parts = F.split(F.regexp_replace("value", r"^Mk\d+=", ""), ",")
    rows = lines.where(F.col("value").rlike(r"^Mk\d+=")).select("recording", F.regexp_extract("value", r"^Mk(\d+)=", 1).cast("int").alias("mk"), parts.alias("p")).where(F.size("p") >= 5)
    whole = lambda i: F.get("p", F.lit(i)).cast("double").cast("long")
    return rows.select("recording", "mk", F.trim(F.get("p", F.lit(0))).alias("mtype"), F.trim(F.get("p", F.lit(1))).alias("desc"), whole(2).alias("pos"), whole(3).alias("size"), whole(4).cast("int").alias("chan"))


def read_markers(spark: SparkSession, folder: str, pattern: str = "*.vmrk", first_sample: int = 1) -> DataFrame:
    """The markers of all files of a folder; files count samples from ``first_sample``, here the first one is 0."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select(stem(F.col("_metadata.file_path")).alias("recording"), "value")
    return parse_markers(lines).withColumn("pos", F.col("pos") - first_sample)


def read_codes(spark: SparkSession, folder: str, pattern: str = "*.csv", column: str = "EventCode") -> DataFrame:
    """``codes(recording, row_id, code)``: one column of each file, in file order; the recording is the number in the file's name.

    A file is one row here, so that line order is explicit; quoted line breaks
    aren't supported.  Fails where the column is missing.
    """
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(recording_number(stem(F.col("_metadata.file_path"))).alias("recording"), F.split("value", "\r?\n").alias("lines"))
    names = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda n: F.btrim(n, F.lit(' "﻿')))
    at = F.array_position(names, column)
    checked = F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit(f"column {column} missing in the codes of "), F.col("recording"))).cast("long"))
    rows = files.select("recording", checked.alias("at"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row_id", "line"))
    field = F.btrim(F.get(F.split("line", ","), (F.col("at") - 1).cast("int")), F.lit(' "'))
    return rows.where(F.trim("line") != "").select("recording", F.col("row_id").cast("long").alias("row_id"), field.cast("double").cast("int").alias("code"))


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """An epoch table as :func:`evoked_spark.sources.sinks.save_stage` writes it."""
    return spark.read.parquet(path)
