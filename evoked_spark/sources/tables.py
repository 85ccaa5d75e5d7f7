"""The given tables in the roles of epochs, continuous signal, markers and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SFREQ, REL0, BLOCK = 80.0, -16, 64
CHANNELS = ("Fp1", "Fz", "F3", "Cz", "F4")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    volts = F.transform("embedding", lambda x: x.cast("double") * 1e-4)
    channel = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("vec_id") % 5 + 1).cast("int"))
    return v.select(F.expr("vec_id div 5").alias("e"), channel.alias("channel"), volts.alias("values"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.select(F.expr("cast((e div 2) % 10 as string)").alias("recording"), F.col("e").alias("epoch_id"), F.when(F.expr("e % 2 = 0"), "Standard").otherwise("Deviant").alias("condition"), "channel", F.lit("eeg").alias("kind"), F.lit(SFREQ).alias("sfreq"), F.lit(REL0).alias("rel0"), "values")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 blocks of 64 samples make a recording; Fp1 plays an EOG channel."""
    v = _vectors(spark, sf_dir)
    return v.select(F.expr("cast(e div 50 as string)").alias("recording"), "channel", F.when(F.col("channel") == "Fp1", "eog").otherwise("eeg").alias("kind"), F.lit(SFREQ).alias("sfreq"), F.expr("e % 50").alias("block"), F.expr(f"e % 50 * {BLOCK}").alias("start"), "values")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    pos = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.select(F.col("user_id").cast("string").alias("recording"), F.col("event_id").alias("mk"), F.col("event_type").alias("mtype"), F.col("event_type").alias("desc"), pos.alias("pos"), F.lit(1).cast("long").alias("size"), F.lit(1e6).alias("sfreq"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("recording"))


def codes(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Codes of all orders, or of some of them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    own = orders(spark, sf_dir) if own is None else own
    q = F.col("l_quantity").cast("int")
    code = 100 * (1 + (F.col("l_linenumber") - 1) % 4) + F.when(q % 10 == 0, 0).otherwise(10) + F.when(q % 5 == 1, 1).otherwise(0)
    joined = lines.join(own, lines.l_orderkey == own.o_orderkey)
    return joined.select("recording", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row_id"), code.cast("int").alias("code"))
