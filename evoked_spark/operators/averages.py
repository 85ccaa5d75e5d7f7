"""Averages over epochs and recordings, window measures and tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Window
from .epochs import baseline, crop, decimate
from .vectors import vector_sums

MMN = "MMN_DEV_MINUS_STD"


def evoked(epochs: DataFrame) -> DataFrame:
    """``(recording, condition, channel, rel, sfreq, value, n_epochs)``; conditions without epochs have no rows.

    Arrays are added up as they are; what is shuffled is one array per key and
    task, however many epochs there are.  Samples become rows at last.
    """
    sums = vector_sums(epochs, ["recording", "condition", "channel", "sfreq"], ["values"], "rel0")
    long = sums.select("recording", "condition", "channel", "sfreq", "first", F.posexplode(F.arrays_zip("values", "values_n", "rows")).alias("i", "s"))
    return long.select("recording", "condition", "channel", (F.col("first") + F.col("i")).cast("int").alias("rel"), "sfreq", F.try_divide("s.values", "s.values_n").alias("value"), F.col("s.rows").cast("long").alias("n_epochs")).where("n_epochs > 0")


def grand_average(waves: DataFrame) -> DataFrame:
    """Unweighted mean over recordings, of the channels that all recordings of a condition have."""
    n = waves.groupBy("condition").agg(F.countDistinct("recording").alias("n_all"))
    means = waves.groupBy("condition", "channel", "rel").agg(F.avg("value").alias("value"), F.count("*").alias("n_recordings"))
    return means.join(n, "condition").where("n_recordings = n_all").drop("n_all")


def difference(waves: DataFrame, minuend: str = "Deviant", subtrahend: str = "Standard", name: str = MMN, count: str = "min") -> DataFrame:
    """minuend - subtrahend per channel and sample, in one aggregation; only where both exist.

    ``n_epochs`` is the smaller of both counts, or their sum.
    """
    pick = lambda column, c: F.max(F.when(F.col("condition") == c, F.col(column)))
    d = waves.groupBy("recording", "channel", "rel").agg(F.first("sfreq").alias("sfreq"), (pick("value", minuend) - pick("value", subtrahend)).alias("value"), pick("n_epochs", minuend).alias("a"), pick("n_epochs", subtrahend).alias("b"))
    n = F.least("a", "b") if count == "min" else F.col("a") + F.col("b")
    return d.where("value is not null").select("recording", F.lit(name).alias("condition"), "channel", "rel", "sfreq", "value", n.alias("n_epochs"))


def window_means(waves: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Mean amplitude in microvolts per recording, condition, channel and window, bounds included.

    The windows are a parameter, so each sample looks up the ones it lies in;
    nothing is joined.
    """
    t = lambda s: F.rint(F.lit(float(s)) * F.col("sfreq"))
    inside = F.array_compact(F.array(*[F.when(F.col("rel").between(t(w.tmin), t(w.tmax)), F.struct(F.lit(w.name).alias("window"), F.lit(float(w.tmin)).alias("tmin"), F.lit(float(w.tmax)).alias("tmax"))) for w in windows]))
    rows = waves.withColumn("w", F.explode(inside)).select("*", "w.*")
    return rows.groupBy("recording", "condition", "channel", "window", "tmin", "tmax").agg((F.avg("value") * 1e6).alias("mean_uV"), F.max("n_epochs").alias("n_epochs"))


def with_status_rows(rows: DataFrame, recordings: DataFrame, conditions: Sequence[str], status: str) -> DataFrame:
    """Adds a row with ``status`` for each recording and condition that has none; the others are OK."""
    names = F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition")
    wanted = recordings.select("recording").distinct().select("recording", names)
    missing = wanted.join(rows.select("recording", "condition").distinct(), ["recording", "condition"], "left_anti")
    return rows.withColumn("status", F.lit("OK")).unionByName(missing.withColumn("status", F.lit(status)), allowMissingColumns=True)


def erp_metrics(epochs: DataFrame, windows: Sequence[Window] = (Window(),), channels: Sequence[str] = (), conditions: Sequence[str] = ("Standard", "Deviant"), contrast: tuple[str, str] = ("Deviant", "Standard"), name: str = MMN) -> DataFrame:
    """Window amplitudes of the conditions and of their difference, with status rows for what is missing."""
    picked = epochs.where(F.col("channel").isin(*channels)) if channels else epochs
    waves = evoked(picked.where(F.col("condition").isin(*conditions)))
    both = waves.unionByName(difference(waves, *contrast, name=name, count="sum"))
    return with_status_rows(window_means(both, windows), epochs, [*conditions, name], "MISSING_OR_EMPTY").withColumnRenamed("recording", "subject")


def erp_timeseries(epochs: DataFrame, tmin: float, tmax: float, base: tuple[float, float] | None = (-0.2, 0.0), factor: int = 1, channels: Sequence[str] = (), conditions: Sequence[str] = ("Standard", "Deviant"), recordings: DataFrame | None = None, contrast: tuple[str, str] = ("Deviant", "Standard"), name: str = MMN) -> DataFrame:
    """Crop, baseline, average, difference and decimate; one row per sample, in microvolts.

    ``conditions`` are the ones asked for; a recording with epochs but none of
    them has one row of status NO_CONDITIONS, and one of ``recordings`` (those
    of ``epochs`` unless given) without epochs one of status EMPTY_EPOCHS.  The
    difference is given wherever both of its conditions are asked for and there.
    """
    e = crop(epochs.where(F.col("channel").isin(*channels)) if channels else epochs, tmin, tmax)
    e = e.where(F.col("condition").isin(*conditions))
    waves = evoked(baseline(e, *base) if base else e)
    both = waves.unionByName(difference(waves, *contrast, name=name)) if set(contrast) <= set(conditions) else waves
    both = decimate(both, factor)
    rows = both.select(F.col("recording").alias("subject"), "condition", "n_epochs", "channel", (F.col("rel") / F.col("sfreq")).alias("time_s"), (F.col("value") * 1e6).alias("amplitude_uv"), F.lit("OK").alias("status"))
    there = epochs.groupBy("recording").agg(F.bool_or(F.col("condition").isin(*conditions)).alias("asked"))
    every = recordings.select("recording").distinct() if recordings is not None else there.select("recording")
    status = F.when(F.col("asked").isNull(), "EMPTY_EPOCHS").when(~F.col("asked"), "NO_CONDITIONS")
    lost = every.join(there, "recording", "left").select(F.col("recording").alias("subject"), status.alias("status")).where("status is not null")
    return rows.unionByName(lost, allowMissingColumns=True)
