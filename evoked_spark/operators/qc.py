"""Quality-control rows and recording profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_counts(epochs: DataFrame, blink: DataFrame, muscle: DataFrame) -> DataFrame:
    """Per recording: epochs before, flagged by either mask (an epoch can count in both), kept per condition, reject rate."""
    keys = ["recording", "epoch_id"]
    one = epochs.select(*keys, "condition").distinct()
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    e = one.join(mark(blink, "blink"), keys, "left").join(mark(muscle, "muscle"), keys, "left").na.fill(False, ["blink", "muscle"])
    bad = F.col("blink") | F.col("muscle")
    agg = e.groupBy("recording").agg(F.count("*").alias("n_epochs_before_artifact"), F.count_if(F.col("blink")).alias("n_blink_bad"), F.count_if(F.col("muscle")).alias("n_muscle_bad"), F.count_if(bad).alias("n_epochs_dropped"), F.count_if(~bad).alias("n_epochs_final"), F.count_if(~bad & (F.col("condition") == "Standard")).alias("n_standard_final"), F.count_if(~bad & (F.col("condition") == "Deviant")).alias("n_deviant_final"))
    rate = F.coalesce(F.try_divide(F.col("n_epochs_dropped").cast("double"), F.col("n_epochs_before_artifact")), F.lit(0.0))
    return agg.withColumn("epoch_reject_rate", rate)


def with_epoch_status(counts: DataFrame) -> DataFrame:
    """OK, or why a recording gives no averages."""
    status = F.when(F.col("n_epochs_final") == 0, "SKIP_EMPTY_EPOCHS").when((F.col("n_standard_final") == 0) | (F.col("n_deviant_final") == 0), "SKIP_EMPTY_CONDITION").otherwise("OK")
    return counts.withColumn("status", status)


def event_counts(all_codes: DataFrame, used: DataFrame, events: DataFrame, kept_codes: Sequence[int]) -> DataFrame:
    """Per recording of ``all_codes``: codes in all and used, events that got a code, and those whose code is among ``kept_codes``."""
    total = all_codes.groupBy("recording").agg(F.count("*").alias("behavioral_codes_total"))
    n_used = used.groupBy("recording").agg(F.count("*").alias("behavioral_codes_used"))
    n = events.groupBy("recording").agg(F.count("*").alias("n_events_used"), F.count_if(F.col("code").isin(*kept_codes)).alias("n_events_kept_stddev"))
    return total.join(n_used, "recording", "left").join(n, "recording", "left").na.fill(0, ["behavioral_codes_used", "n_events_used", "n_events_kept_stddev"])


def skipped(files: DataFrame, status: DataFrame) -> DataFrame:
    """Recordings that a missing file or a failed alignment keeps from epochs, with the counts of the alignment."""
    found = files.select("recording", F.col("status").alias("files")).join(status, "recording", "full")
    failed = F.when(F.col("files") != "OK", F.col("files")).otherwise(F.coalesce("status", F.lit("SKIP_ALIGNMENT_FAILED")))  # neither markers nor codes: nothing to align
    return found.withColumn("status", failed).where("status <> 'OK'").select("recording", "markers_original", "markers_dropped_by_gap", "markers_dropped_by_auto", "status")


def error(status: Column) -> Column:
    """Why a recording was skipped, in words; empty for OK."""
    words = {
        "SKIP_MISSING_VMRK": "no marker file",
        "SKIP_MISSING_SUBJECT_CSV": "no file of behavioural codes",
        "SKIP_ALIGNMENT_FAILED": "markers can't be aligned with codes",
        "SKIP_EMPTY_EPOCHS": "every epoch was rejected",
        "SKIP_EMPTY_CONDITION": "a condition has no epoch left",
    }
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(""))


def stacked(*tables: DataFrame) -> DataFrame:
    """One table of all rows; a column that a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
