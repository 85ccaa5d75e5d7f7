"""Writing stages and result tables, such that a rerun touches only what it computed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "recording string, stage string, rows long, run string, at timestamp"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_stage(df: DataFrame, folder: str, stage: str, recordings: DataFrame | None = None, run: str = "") -> str:
    """A numbered stage as Parquet, one folder per recording; recordings outside ``df`` stay as they are.

    Only the folders of recordings that ``df`` has are replaced.  A manifest
    beside the stages notes, after the data were written, how many rows each
    recording has; ``recordings`` names those that were worked on and may have
    none.  Tables without recordings are replaced as a whole.
    """
    path = f"{folder}/{stage}"
    if "recording" not in df.columns:
        df.write.mode("overwrite").parquet(path)
        return path
    df.repartition("recording").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(path)
    spark = df.sparkSession
    names = df.select(F.col("recording").cast("string")).distinct()
    written = _read(spark, path)
    if written is None:  # nothing was ever written
        counts = spark.createDataFrame([], "recording string, rows long")
    else:  # of the recordings that have rows in this run; what an earlier run left of others isn't counted
        own = written.select(F.col("recording").cast("string")).join(names, "recording", "left_semi")
        counts = own.groupBy("recording").agg(F.count("*").alias("rows"))
    done = names if recordings is None else recordings.select(F.col("recording").cast("string")).union(names).distinct()
    notes = done.join(counts, "recording", "left").na.fill(0, ["rows"])
    notes = notes.select("recording", F.lit(stage).alias("stage"), "rows", F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    notes.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return path


def finished(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """``(recording, rows)`` of the recordings whose stage is complete, by the last note of each."""
    notes = _read(spark, f"{folder}/manifest", MANIFEST)
    if notes is None:
        return spark.createDataFrame([], "recording string, rows long")
    last = F.row_number().over(W.partitionBy("recording").orderBy(F.desc("at"), F.desc("rows")))
    return notes.where(F.col("stage") == stage).withColumn("place", last).where("place = 1").select("recording", "rows")


def pending(recordings: DataFrame, folder: str, stage: str) -> DataFrame:
    """The recordings that a resumed run still has to do."""
    return recordings.join(finished(recordings.sparkSession, folder, stage), "recording", "left_anti")


def read_stage(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """A stage as its manifest has it: recordings whose writing didn't end, or that have no rows any more, are left out."""
    rows = spark.read.parquet(f"{folder}/{stage}")
    if "recording" not in rows.columns:
        return rows
    rows = rows.withColumn("recording", F.col("recording").cast("string"))
    return rows.join(finished(spark, folder, stage).where("rows > 0").select("recording"), "recording", "left_semi")


def save_csv(df: DataFrame, path: str) -> None:
    """Summaries and metric tables; array columns are written as text joined by blanks."""
    flat = df.select(*[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def save_timeseries(df: DataFrame, path: str) -> None:
    """One folder per subject; those of other subjects stay."""
    df.repartition("subject").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").parquet(path)
