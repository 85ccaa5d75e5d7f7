"""Artifact masks and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import samples as S
from ..functions.windows import moving_exceeds
from ..params import Rejection
from .epochs import any_over, crop
from .streams import window_flags

EPOCH = ["recording", "epoch_id"]


def moving_ptp(epochs: DataFrame, limits: Rejection) -> DataFrame:
    """Epochs where a moving window of any channel spans ``ptp`` microvolts or more."""
    test = crop(epochs, limits.tmin, limits.tmax)
    width, step = S.window_samples(limits.width_ms, F.col("sfreq")), S.window_samples(limits.step_ms, F.col("sfreq"))
    return any_over(moving_exceeds(S.microvolts(F.col("values")), width, step, limits.ptp), EPOCH, test)


def voltage(epochs: DataFrame, limits: Rejection) -> DataFrame:
    """Epochs where any EEG sample reaches a voltage limit."""
    test = crop(epochs.where("kind = 'eeg'"), limits.tmin, limits.tmax)
    uv = S.microvolts(F.col("values"))
    return any_over((F.array_max(uv) >= limits.positive) | (F.array_min(uv) <= limits.negative), EPOCH, test)


def blink_channels(epochs: DataFrame, proxy: Sequence[str] = ("Fp1", "Fp2")) -> DataFrame:
    """``(recording, source, channels)``: the EOG channels if there are any, else the proxies that exist, else none."""
    c = epochs.select("recording", "channel", "kind").distinct().groupBy("recording")
    c = c.agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "eog", F.col("channel")))).alias("eog"), F.sort_array(F.collect_list(F.when(F.col("channel").isin(*proxy), F.col("channel")))).alias("own"))
    return c.select("recording", F.when(F.size("eog") > 0, "eog").when(F.size("own") > 0, F.concat(F.lit("proxy:"), F.concat_ws(",", "own"))).otherwise("none").alias("source"), F.when(F.size("eog") > 0, F.col("eog")).otherwise(F.col("own")).alias("channels"))


def blinks(epochs: DataFrame, limits: Rejection, proxy: Sequence[str] = ("Fp1", "Fp2")) -> DataFrame:
    """:func:`moving_ptp` over each recording's blink channels."""
    chosen = blink_channels(epochs, proxy).select("recording", "channels")
    return moving_ptp(epochs.join(chosen, "recording").where(F.array_contains("channels", F.col("channel"))).drop("channels"), limits)


def clusters(flags: DataFrame, keys: Sequence[str], order: str, flag: str = "flag") -> DataFrame:
    """Runs of consecutive true flags per key."""
    before = F.lag(flag).over(W.partitionBy(*keys).orderBy(order))
    starts = flags.withColumn("starts", F.col(flag) & ~F.coalesce(before, F.lit(False)))
    return starts.groupBy(*keys).agg(F.count_if(F.col("starts")).alias("clusters"))


def continuous_ptp(blocks: DataFrame, limits: Rejection, unit: str = "window") -> DataFrame:
    """Flags of the moving window over a continuous signal: ``(recording, i, flag)``.

    ``unit='window'``: one flag per window start of the global grid, over all
    channels.  ``unit='channel'``: one flag per channel, in channel order.
    Blocks may have any lengths.
    """
    flags = window_flags(blocks, limits.ptp * 1e-6, limits.width_ms, limits.step_ms)
    if unit == "window":
        return flags.groupBy("recording", "i").agg(F.bool_or("flag").alias("flag"))
    return flags.groupBy("recording", F.col("channel").alias("i")).agg(F.bool_or("flag").alias("flag"))


def blink_rate(flags: DataFrame, blocks: DataFrame) -> DataFrame:
    """Clusters per minute of recording time; NULL when that is 0."""
    last = blocks.groupBy("recording").agg(F.max((F.col("start") + F.size("values") - 1) / F.col("sfreq")).alias("seconds"))
    found = clusters(flags, ["recording"], "i")
    rate = F.try_divide(F.coalesce("clusters", F.lit(0)).cast("double"), F.col("seconds") / 60)
    return last.join(found, "recording", "left").select("recording", rate.alias("blinks_per_min"))


def centred_products(x: Column, y: Column, mx: Column, my: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)), F.lit(0.0), lambda s, v: s + v)


def pair_correlations(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(recording, a, b, r)`` for every channel of ``left`` with every one of ``right``; both are blocks.

    Blocks of one recording meet by number and give their means and centred
    products, over the samples that both have if one is longer.  These are merged about the means of the whole, so that a large
    offset costs no digits; r is NULL where a side is constant.
    """
    a = left.select("recording", "block", F.col("channel").alias("a"), F.col("values").alias("x"), S.mean(F.col("values")).alias("mx"))
    b = right.select("recording", "block", F.col("channel").alias("b"), F.col("values").alias("y"), S.mean(F.col("values")).alias("my"))
    met = a.join(b, ["recording", "block"])
    both, even = F.least(F.size("x"), F.size("y")), F.size("x") == F.size("y")
    cut = lambda v: F.when(even, F.col(v)).otherwise(F.slice(v, 1, both))
    centre = lambda v: F.when(even, F.col(f"m{v}")).otherwise(S.mean(F.slice(v, 1, both)))
    met = met.withColumns({"mx": centre("x"), "my": centre("y"), "x": cut("x"), "y": cut("y")}).where(F.size("x") > 0)
    c = lambda p, q: centred_products(F.col(p), F.col(q), F.col(f"m{p}"), F.col(f"m{q}"))
    parts = met.select("recording", "a", "b", F.size("x").cast("double").alias("n"), "mx", "my", c("x", "y").alias("xy"), c("x", "x").alias("xx"), c("y", "y").alias("yy"))
    pair = W.partitionBy("recording", "a", "b")
    whole = lambda m: F.sum(F.col("n") * F.col(m)).over(pair) / F.sum("n").over(pair)
    about = parts.withColumns({"ax": whole("mx"), "ay": whole("my")}).withColumns({"dx": F.col("mx") - F.col("ax"), "dy": F.col("my") - F.col("ay")})
    merged = lambda p, d, e: F.sum(F.col(p) + F.col("n") * F.col(d) * F.col(e))
    s = about.groupBy("recording", "a", "b").agg(F.sum("n").alias("n"), F.first("ax").alias("ax"), F.first("ay").alias("ay"), merged("xy", "dx", "dy").alias("xy"), merged("xx", "dx", "dx").alias("xx"), merged("yy", "dy", "dy").alias("yy"))
    varies = lambda v, m: F.col(v) > F.col("n") * F.pow(F.lit(1e-14) * F.col(m), 2)  # noqa: E731  # beyond the rounding of the mean
    return s.select("recording", "a", "b", F.when(varies("xx", "ax") & varies("yy", "ay"), F.col("xy") / F.sqrt("xx") / F.sqrt("yy")).alias("r"))


def eog_correlation(blocks: DataFrame) -> DataFrame:
    """``(recording, eog_corr_max, eog_corr_mean)`` of |r| over all pairs of EOG and EEG channels; undefined pairs are left out."""
    r = pair_correlations(blocks.where("kind = 'eog'"), blocks.where("kind = 'eeg'"))
    return r.groupBy("recording").agg(F.max(F.abs("r")).alias("eog_corr_max"), F.avg(F.abs("r")).alias("eog_corr_mean"))
