"""Markers, behavioural codes and their alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

PERCENTILES = (25, 50, 75, 90, 95, 99)


def in_order() -> WindowSpec:
    """One window spec for all that looks at neighbouring markers, so that they share a sort."""
    return W.partitionBy("recording").orderBy("pos", "mk")


def with_gaps(markers: DataFrame) -> DataFrame:
    """``previous`` and ``next``: seconds to the neighbours, NULL at the ends."""
    t = F.col("pos") / F.col("sfreq")
    df = markers.withColumn("t", t)
    return df.withColumn("previous", F.col("t") - F.lag("t").over(in_order())).withColumn("next", F.lead("t").over(in_order()) - F.col("t")).drop("t")


def gap_stats(markers: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per recording: markers, and quantiles of their gaps in seconds (NULL with fewer than two).

    Exact and interpolated by default, which holds all different gaps of a
    recording.  With ``accuracy`` they come from a mergeable sketch of bounded
    size: gaps that occur, whose rank is off by n / accuracy at most.
    """
    shares = F.array(*[F.lit(p / 100) for p in PERCENTILES])
    q = F.percentile("previous", shares) if accuracy is None else F.percentile_approx("previous", shares, accuracy)
    stats = with_gaps(markers).groupBy("recording").agg(F.count("*").alias("n"), F.min("previous").alias("gap_min"), q.alias("q"), F.max("previous").alias("gap_max"))
    return stats.select("recording", "n", "gap_min", *[F.get("q", F.lit(i)).alias(f"gap_p{p}") for i, p in enumerate(PERCENTILES)], "gap_max")


def dense(gap_s: float | Column) -> Column:
    """Both gaps at most ``gap_s``; an end has an infinite gap."""
    return F.coalesce((F.col("previous") <= gap_s) & (F.col("next") <= gap_s), F.lit(False))


def keep_by_gap(markers: DataFrame, gap_s: float) -> DataFrame:
    return with_gaps(markers).where(dense(gap_s)).drop("previous", "next")


def candidate_gaps(markers: DataFrame, gaps: Sequence[float] = (0.5, 1, 1.5, 2, 3, 5)) -> DataFrame:
    """How many markers each gap would keep, per recording; one pass, one row per gap."""
    counts = with_gaps(markers).groupBy("recording").agg(*[F.count_if(dense(float(g))).alias(f"g{i}") for i, g in enumerate(gaps)])
    rows = F.array(*[F.struct(F.lit(float(g)).alias("gap_s"), F.col(f"g{i}").alias("kept")) for i, g in enumerate(gaps)])
    return counts.select("recording", F.explode(rows).alias("r")).select("recording", "r.gap_s", "r.kept")


def densest(markers: DataFrame, target: Column) -> DataFrame:
    """The ``target`` markers of each recording with the smallest larger gap; earlier ones first at ties.  Fails where there are fewer."""
    infinite = F.lit(float("inf"))
    score = F.greatest(F.coalesce("previous", infinite), F.coalesce("next", infinite))
    ranked = with_gaps(markers).withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("recording").orderBy("score", "pos", "mk"))).withColumn("available", F.count("*").over(W.partitionBy("recording")))
    too_few = F.raise_error(F.concat(F.lit("fewer markers than wanted in recording "), F.col("recording"))).cast("boolean")
    return ranked.where(F.when(target > F.col("available"), too_few).otherwise(F.col("rank") <= target)).drop("previous", "next", "score", "rank", "available")


def alignment(markers: DataFrame, codes: DataFrame, gap_s: float | None = None, auto_drop: bool = True) -> tuple[DataFrame, DataFrame]:
    """Makes as many markers as codes, per recording: ``(kept markers, status)``.

    First the gap filter, if asked for; then, with more markers than codes and
    ``auto_drop``, the densest ones (gaps taken anew).  The status table has
    one row per recording of either side: ``markers_original``,
    ``markers_dropped_by_gap``, ``markers_dropped_by_auto``, ``n_codes`` and
    ``status``, which is SKIP_ALIGNMENT_FAILED where the numbers still differ
    or two markers share a position.
    """
    filtered = keep_by_gap(markers, gap_s) if gap_s is not None else markers
    before = markers.groupBy("recording").agg(F.count("*").alias("original"), (F.countDistinct("pos") < F.count("*")).alias("repeated"))
    after = filtered.groupBy("recording").agg(F.count("*").alias("filtered"))
    n_codes = codes.groupBy("recording").agg(F.count("*").alias("n_codes"))
    s = before.join(after, "recording", "left").join(n_codes, "recording", "full").na.fill(0, ["original", "filtered", "n_codes"])
    fits = (F.col("filtered") == F.col("n_codes")) | (F.lit(auto_drop) & (F.col("filtered") > F.col("n_codes")))
    ok = fits & ~F.coalesce("repeated", F.lit(False)) & (F.col("n_codes") > 0)
    status = s.select("recording", F.col("original").alias("markers_original"), (F.col("original") - F.col("filtered")).alias("markers_dropped_by_gap"), F.when(ok, F.col("filtered") - F.col("n_codes")).otherwise(0).alias("markers_dropped_by_auto"), "n_codes", F.when(ok, "OK").otherwise("SKIP_ALIGNMENT_FAILED").alias("status"))
    aligned = status.where("status = 'OK'").select("recording", "n_codes")
    return densest(filtered.join(aligned, "recording"), F.col("n_codes")).drop("n_codes"), status


def without_spans(markers: DataFrame) -> DataFrame:
    """Markers that stand for events: those whose description doesn't begin with BAD or EDGE, in any case (a null one doesn't)."""
    return markers.where(~F.coalesce(F.col("desc").rlike("(?i)^(bad|edge)"), F.lit(False)))


def events(kept: DataFrame, codes: DataFrame) -> DataFrame:
    """``(recording, seq, pos, code)``: the i-th kept marker gets the i-th code, by row_id (and code, where it repeats)."""
    a = kept.withColumn("seq", F.row_number().over(in_order())).select("recording", "seq", "pos")
    b = codes.withColumn("seq", F.row_number().over(W.partitionBy("recording").orderBy("row_id", "code"))).select("recording", "seq", "code")
    return a.join(b, ["recording", "seq"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("recording", column).agg(F.count("*").alias("n"))


def first_descriptions(markers: DataFrame, most: int = 30) -> DataFrame:
    """Per recording: how many different descriptions, and the first ``most`` in the order they appear."""
    seen = markers.groupBy("recording", "desc").agg(F.min(F.struct("pos", "mk")).alias("first"))
    ranked = seen.withColumn("rank", F.row_number().over(W.partitionBy("recording").orderBy("first", "desc")))
    listed = F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "desc"))))
    return ranked.groupBy("recording").agg(F.count("*").alias("n_descriptions"), listed.alias("listed")).select("recording", "n_descriptions", F.col("listed.desc").alias("descriptions"))


def top_descriptions(markers: DataFrame, most: int = 10) -> DataFrame:
    counts = value_counts(markers, "desc")
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("recording").orderBy(F.desc("n"), "desc")))
    return ranked.where(F.col("rank") <= most)


def missing_files(recordings: DataFrame, behaviour: DataFrame, marker_files: DataFrame, on_missing_codes: str = "skip", on_missing_markers: str = "warn") -> DataFrame:
    """``(recording, status)``: OK, or which file a recording lacks, the marker file first; policy ``fail`` raises instead, ``warn`` lets pass."""
    have = lambda df, name: df.select("recording").distinct().withColumn(name, F.lit(True))
    joined = recordings.select("recording").distinct().join(have(behaviour, "has_codes"), "recording", "left").join(have(marker_files, "has_markers"), "recording", "left")
    act = lambda policy, what, status: F.raise_error(F.concat(F.lit(f"no {what} for recording "), F.col("recording"))).cast("string") if policy == "fail" else F.lit(None if policy == "warn" else status).cast("string")
    status = F.coalesce(
        F.when(F.col("has_markers").isNull(), act(on_missing_markers, "markers", "SKIP_MISSING_VMRK")),
        F.when(F.col("has_codes").isNull(), act(on_missing_codes, "codes", "SKIP_MISSING_SUBJECT_CSV")),
        F.lit("OK"),
    )
    return joined.select("recording", status.alias("status"))
