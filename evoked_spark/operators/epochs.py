"""Epochs: cutting, cropping, baselines, removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import samples as S


def samples(epochs: DataFrame, value: str = "v") -> DataFrame:
    """One row per sample: ``values`` and ``rel0`` become ``rel`` and ``value``."""
    keep = [c for c in epochs.columns if c not in ("values", "rel0")]
    return epochs.select(*keep, "rel0", F.posexplode("values").alias("i", value)).withColumn("rel", F.col("rel0") + F.col("i")).drop("i", "rel0")


def crop(epochs: DataFrame, tmin: float, tmax: float) -> DataFrame:
    values, rel0 = S.cropped(F.col("values"), F.col("rel0"), S.bound(tmin, F.col("sfreq")), S.bound(tmax, F.col("sfreq")))
    return epochs.withColumns({"values": values, "rel0": rel0})


def baseline(epochs: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """Subtracts each row's mean over [tmin, tmax]; needs no shuffle.  Rows without a sample there become NULL samples."""
    inside, _ = S.cropped(F.col("values"), F.col("rel0"), S.bound(tmin, F.col("sfreq")), S.bound(tmax, F.col("sfreq")))
    return epochs.withColumn("values", S.shifted(F.col("values"), S.mean(inside)))


def decimate(long: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th sample, such that the event itself stays."""
    return long.where(F.pmod("rel", F.lit(factor)) == 0)


def cut(blocks: DataFrame, events: DataFrame, tmin: float, tmax: float, block_size: int) -> DataFrame:
    """Epochs around events, from blocks of ``block_size`` samples (the last one may be shorter).

    The interval join is an equi-join: an event names the one or two blocks it
    needs.  Epochs that the recording doesn't cover in full are dropped.
    ``events`` has recording, seq, pos and anything else; seq becomes epoch_id.
    """
    rate = blocks.select("recording", "sfreq").distinct()
    e = events.join(rate, "recording").withColumns({"lo": F.col("pos") + S.bound(tmin, F.col("sfreq")), "hi": F.col("pos") + S.bound(tmax, F.col("sfreq"))})
    block = lambda c: F.floor(F.col(c) / block_size).cast("long")
    e = e.drop("sfreq").withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    joined = blocks.join(e, ["recording", "block"])
    first = F.greatest(F.col("lo") - F.col("start"), F.lit(0))
    length = F.greatest(F.least(F.col("hi") - F.col("start") + 1, F.size("values")) - first, F.lit(0)).cast("int")
    part = F.struct("block", F.slice("values", (first + 1).cast("int"), length).alias("v"))
    extra = [c for c in events.columns if c not in ("recording", "seq", "pos")]
    whole = joined.groupBy("recording", "seq", "channel", "kind", "sfreq", "pos", "lo", "hi", *extra).agg(F.flatten(F.sort_array(F.collect_list(part))["v"]).alias("values"))
    full = whole.where(F.size("values") == F.col("hi") - F.col("lo") + 1)
    return full.select("recording", F.col("seq").alias("epoch_id"), *extra, "channel", "kind", "sfreq", "pos", (F.col("lo") - F.col("pos")).cast("int").alias("rel0"), "values")


def touched_by_bad_spans(spans: DataFrame, markers: DataFrame, bucket: int) -> DataFrame:
    """The keys ``(recording, epoch_id)`` of ``spans(recording, epoch_id, lo, hi)`` that a BAD marker overlaps.

    A marker is BAD if its text starts so, in any case; it reaches from pos to
    pos + size.  Both sides name the buckets of samples they reach into, so the
    join is an equi-join on recording and bucket.
    """
    of = lambda low, high: F.explode(F.sequence(F.floor(low / bucket), F.floor(F.greatest(low, high) / bucket))).alias("bucket")
    bad = markers.where(F.lower("desc").startswith("bad")).select("recording", F.col("pos").alias("bad_from"), (F.col("pos") + F.col("size")).alias("bad_to"))
    bad = bad.select("*", of(F.col("bad_from"), F.col("bad_to")))
    own = spans.select("recording", "epoch_id", "lo", "hi", of(F.col("lo"), F.col("hi")))
    return own.join(bad, ["recording", "bucket"]).where("bad_from <= hi and bad_to > lo").select("recording", "epoch_id").distinct()


def events_without_bad_spans(events: DataFrame, markers: DataFrame, sfreq: float, tmin: float, tmax: float, bucket: int = 4096) -> DataFrame:
    """Events whose epoch no BAD marker overlaps; decided before any signal is cut."""
    spans = events.select("recording", F.col("seq").alias("epoch_id"), (F.col("pos") + S.bound(tmin, sfreq)).alias("lo"), (F.col("pos") + S.bound(tmax, sfreq)).alias("hi"))
    touched = touched_by_bad_spans(spans, markers, bucket).withColumnRenamed("epoch_id", "seq")
    return events.join(touched, ["recording", "seq"], "left_anti")


def drop_bad_spans(epochs: DataFrame, markers: DataFrame, bucket: int = 4096) -> DataFrame:
    """Epochs that no BAD marker overlaps; tested once per event, not per channel."""
    spans = epochs.select("recording", "epoch_id", (F.col("pos") + F.col("rel0")).alias("lo"), (F.col("pos") + F.col("rel0") + F.size("values") - 1).alias("hi")).distinct()
    return epochs.join(touched_by_bad_spans(spans, markers, bucket), ["recording", "epoch_id"], "left_anti")


def reject(epochs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Removes flagged epochs from all channels."""
    return epochs.join(flagged.select("recording", "epoch_id").distinct(), ["recording", "epoch_id"], "left_anti")


def in_microvolts(epochs: DataFrame) -> DataFrame:
    return epochs.withColumn("values", S.microvolts(F.col("values")))


def any_over(flag: Column, keys: Sequence[str], df: DataFrame) -> DataFrame:
    """Keys for which any row is flagged."""
    return df.groupBy(*keys).agg(F.bool_or(flag).alias("bad")).where("bad").drop("bad")
