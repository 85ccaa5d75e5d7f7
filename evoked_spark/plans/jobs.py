"""The three workloads: preprocessing, metrics and recording profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import artifacts, averages, epochs, ica, labels, markers, qc, signal, tfr
from ..params import Contrast, Ica, Rejection, Tfr, Window
from ..sources import sinks
from ..sources.lineage import written


def preview(rows: DataFrame, *order: str, most: int = 5) -> DataFrame:
    """The first rows of each recording."""
    rank = F.row_number().over(W.partitionBy("recording").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def profile(m: DataFrame, codes: DataFrame, gap_s: float | None = None, gaps: Sequence[float] = (0.5, 1, 1.5, 2, 3, 5), keep: Sequence[int] = (), diagnostics: DataFrame | None = None) -> DataFrame:
    """Markers against codes, one row per recording of either side.

    Marker counts and gap quantiles, markers each of ``gaps`` would keep,
    types, first and most frequent descriptions, counts of all codes, the first
    labelled trials of the kept codes, and the alignment with its status.
    ``diagnostics`` has any further columns per recording.
    """
    used = labels.only_codes(codes, keep)
    _, status = markers.alignment(m, used, gap_s)
    listed = lambda df, name, *columns: df.groupBy("recording").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    first = preview(labels.with_trial_labels(used), "row_id", "code")
    tables = [
        markers.gap_stats(m).withColumnRenamed("n", "n_markers"),
        listed(markers.candidate_gaps(m, gaps), "candidate_gaps", "gap_s", "kept"),
        listed(markers.value_counts(m, "mtype"), "marker_types", "mtype", "n"),
        markers.first_descriptions(m).withColumnRenamed("descriptions", "first_descriptions"),
        listed(markers.top_descriptions(m), "top_descriptions", "rank", "desc", "n"),
        codes.groupBy("recording").agg(F.count("*").alias("n_codes_total")),
        listed(markers.value_counts(codes, "code"), "code_counts", "code", "n"),
        listed(first, "trials", "row_id", "code", "trial_role", "variant", "is_standard", "is_deviant"),
        status.drop("markers_original"),
        *([diagnostics] if diagnostics is not None else []),
    ]
    rows = m.select("recording").union(codes.select("recording")).distinct()
    for table in tables:
        rows = rows.join(table, "recording", "left")
    return rows.na.fill(0, ["n_markers", "n_codes_total", "n_codes"]).na.fill("SKIP_ALIGNMENT_FAILED", ["status"])


def qc_summary(e: DataFrame, limits: Rejection = Rejection(), blink_rate: DataFrame | None = None, eog: DataFrame | None = None) -> DataFrame:
    """Counts, reject rate, blink source and whether component removal is recommended, per recording."""
    counts = qc.with_epoch_status(qc.epoch_counts(e, artifacts.blinks(e, limits), artifacts.voltage(e, limits)))
    source = artifacts.blink_channels(e).select("recording", F.col("source").alias("blink_source"))
    rows = counts.join(source, "recording")
    rows = rows.join(blink_rate.select("recording", "blinks_per_min"), "recording", "left") if blink_rate is not None else rows.withColumn("blinks_per_min", F.lit(None).cast("double"))
    rows = rows.join(eog.select("recording", "eog_corr_max", "eog_corr_mean"), "recording", "left") if eog is not None else rows.withColumn("eog_corr_max", F.lit(None).cast("double"))
    own = F.col("blink_source") == "eog"
    yes, why = ica.recommendation(F.col("epoch_reject_rate"), F.col("eog_corr_max"), F.when(own, F.col("blinks_per_min")), F.when(~own, F.col("blinks_per_min")))
    rows = rows.withColumn("ica_recommended", yes).withColumn("ica_recommend_reason", why)
    drop = [c for c, given in (("blinks_per_min", blink_rate), ("eog_corr_max", eog)) if given is None]
    return rows.drop(*drop).withColumnRenamed("recording", "subject")


@dataclass(frozen=True)
class Preprocessing:
    """Parameters of workload A."""

    contrast: Contrast
    block_size: int
    notch: Sequence[float] = (60.0,)
    low: float | None = 0.1
    high: float | None = 30.0
    tmin: float = -0.2
    tmax: float = 0.6
    baseline: tuple[float, float] | None = (-0.2, 0.0)
    gap_s: float | None = None
    limits: Rejection = Rejection()
    ica: Ica = Ica()
    proxies: Sequence[str] = ("Fp1", "Fp2")
    eog: Sequence[str] = ()
    on_missing_codes: str = "skip"
    on_missing_markers: str = "warn"
    tokens: tuple[str, str] | None = None
    raw_file: str = "%s.vhdr"
    codes_file: str = "subject-%s.csv"

    def __post_init__(self):
        wrong = []
        if self.block_size < 1:
            wrong.append("block_size is at least 1")
        if not self.tmin < self.tmax:
            wrong.append("tmin must be below tmax")
        if self.baseline is not None and (len(self.baseline) != 2 or not self.tmin <= self.baseline[0] <= self.baseline[1] <= self.tmax):
            wrong.append("baseline has two ends in order, inside tmin and tmax")
        if self.low is not None and self.high is not None and not 0 < self.low < self.high:
            wrong.append("0 < low < high")
        if any(f <= 0 for f in self.notch):
            wrong.append("notch frequencies are positive")
        if self.gap_s is not None and self.gap_s <= 0:
            wrong.append("gap_s is positive")
        if self.on_missing_codes not in ("skip", "fail"):
            wrong.append("on_missing_codes is skip or fail")
        if self.on_missing_markers not in ("warn", "skip", "fail"):
            wrong.append("on_missing_markers is warn, skip or fail")
        if self.tokens is not None and len(self.tokens) != 2:
            wrong.append("tokens are two labels")
        if wrong:
            raise ValueError("; ".join(wrong))


def checked_blocks(blocks: DataFrame, sfreq: float, block_size: int) -> DataFrame:
    """The same rows; a job that reads one off the grid fails and says which: another sampling rate, a place that isn't its block's, too many samples."""
    where = F.concat(F.lit(" in recording "), "recording", F.lit(", channel "), "channel", F.lit(", block "), F.col("block").cast("string"))
    fault = (
        F.when(F.abs(F.col("sfreq") - sfreq) > 1e-6 * sfreq, F.concat(F.lit(f"sfreq isn't {sfreq:g}"), where))
        .when(F.col("start") != F.col("block") * block_size, F.concat(F.lit(f"start isn't block x block_size ({block_size})"), where))
        .when(F.size("values") > block_size, F.concat(F.lit(f"more than block_size ({block_size}) samples"), where))
    )
    return blocks.withColumn("values", F.when(fault.isNotNull(), F.raise_error(fault).cast("array<double>")).otherwise(F.col("values")))


def code_facts(codes: DataFrame, contrast: Contrast) -> DataFrame:
    """``(recording, unknown_codes, missing_codes)``: codes of a recording outside the kept ones, and codes of the contrast that it lacks; as text.

    Both are set differences by key: codes against the parameters, and the
    parameters, for each recording, against its codes.
    """
    wanted = sorted({*contrast.standard, *contrast.deviant})
    own = codes.select("recording", "code").distinct()
    listed = lambda df, name: df.groupBy("recording").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_set("code")), lambda c: c.cast("string"))).alias(name))
    unknown = listed(own.where(~F.col("code").isin(*wanted, *contrast.keep)), "unknown_codes")
    each = own.select("recording").distinct().select("recording", F.explode(F.array(*[F.lit(c) for c in wanted])).alias("code"))
    missing = listed(each.join(own, ["recording", "code"], "left_anti"), "missing_codes")
    return own.select("recording").distinct().join(unknown, "recording", "left").join(missing, "recording", "left").na.fill("", ["unknown_codes", "missing_codes"])


FITTED = "recording string, components long, exclude array<int>, candidates array<int>, top_scores array<double>, source string, used string"


def component_facts(fitted: DataFrame, p: Ica) -> DataFrame:
    """What was fitted and found per recording, as columns of text and numbers that a CSV file can hold."""
    text = lambda c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))
    return fitted.select(
        "recording",
        (F.coalesce(F.size("exclude"), F.lit(0)) > 0).alias("ica_applied"),
        text("exclude").alias("ica_exclude"),
        F.lit("fastica").alias("ica_fit_method"),
        F.lit(p.high_pass).alias("ica_fit_l_freq"),
        F.lit(p.low_pass).cast("double").alias("ica_fit_h_freq"),
        F.lit(p.decimate).alias("ica_fit_decim"),
        F.col("components").alias("ica_fit_n_components"),
        F.col("source").alias("ica_find_blink_source"),
        F.when(F.col("source") == "eog", F.col("used")).alias("ica_find_eog_channel_used"),
        F.when(F.col("source") == "proxy", F.coalesce("used", F.lit(""))).alias("ica_find_proxy_channel_used"),
        F.lit(p.threshold).alias("ica_find_corr_thresh"),
        F.lit(p.most).alias("ica_find_max_exclude"),
        text("candidates").alias("ica_find_candidates"),
        text(F.transform("top_scores", lambda x: F.round(x, 6))).alias("ica_find_scores"),
    )


def preprocess(blocks: DataFrame, m: DataFrame, codes: DataFrame, sfreq: float, p: Preprocessing) -> dict[str, DataFrame]:
    """Workload A: clean blocks, epochs, averages, grand averages and QC rows of all recordings at once.

    Recordings that can't be aligned, or end without epochs of a condition,
    appear in ``qc`` with their status and give no averages.  Blocks without an
    EEG channel count as signal, but no epoch reaches into them.  The filtered
    signal, the signal without components, the codes and the cut epochs are
    written to the checkpoint folder, since much is computed from each.
    """
    clean = signal.average_reference(checked_blocks(blocks, sfreq, p.block_size), "referenced")
    kernels = [signal.notch_taps(f, sfreq) for f in p.notch if f < sfreq / 2] + [signal.band_pass_taps(p.low, p.high, sfreq)]
    clean = written(signal.fir(clean, *kernels))  # one ordered pass for all filters; much reads the result
    eog = artifacts.eog_correlation(clean)
    # EOG channels where there are any, else the proxies; no rate without either
    chosen = artifacts.blink_channels(clean, p.proxies).where(F.size("channels") > 0)
    eyes = clean.join(chosen.select("recording", "channels"), "recording").where(F.array_contains("channels", F.col("channel"))).drop("channels")
    rate = artifacts.blink_rate(artifacts.continuous_ptp(eyes, p.limits), clean).join(chosen.select("recording", "source"), "recording")
    own = F.when(F.col("source") == "eog", F.col("blinks_per_min"))
    other = F.when(F.col("source") != "eog", F.col("blinks_per_min"))
    fitted, model = blocks.sparkSession.createDataFrame([], FITTED), blocks.sparkSession.createDataFrame([], ica.MODEL)
    if p.ica.mode != "off":
        recorded = clean.select("recording").distinct().join(rate, "recording", "left")
        wanted = recorded.where(ica.gate(p.ica.mode, own, other, p.ica.gate_per_min)).select("recording")
        # what the fit and the EOG scores need comes from one more pass, over the recordings that are fitted
        both = signal.filtered(clean.join(written(wanted), "recording", "left_semi"), {"fit": [signal.band_pass_taps(p.ica.high_pass, p.ica.low_pass, sfreq)], "eye": [signal.band_pass_taps(*p.ica.eog_band, sfreq)]})
        both = written(both)
        view = lambda c: both.withColumn("values", F.col(c)).drop("fit", "eye")
        model = ica.fit(view("fit"), p.ica)
        eog_blocks = clean.where("kind = 'eog'")
        with_eog = ica.first_channel(eog_blocks, p.eog)
        eye = view("eye").join(with_eog.select("recording"), "recording", "left_semi")
        by_eog = ica.eog_outliers(ica.eog_scores(eye, model, p.eog), p.ica.outlier_z, p.ica.most, p.ica.outlier_rounds)
        proxy = clean.where(F.col("kind") == "eeg").where(F.col("channel").isin(*p.proxies)).join(with_eog, "recording", "left_anti")
        first = ica.first_channel(proxy, p.proxies)  # the first proxy there is, alone
        scores = ica.proxy_scores(ica.sources(clean.where("kind = 'eeg'"), model), proxy.join(first, ["recording", "channel"]))
        exclude = by_eog.withColumn("source", F.lit("eog")).unionByName(ica.rank(scores, p.ica).withColumn("source", F.lit("proxy")))
        used = with_eog.unionByName(first).withColumnRenamed("channel", "used")
        sizes = model.groupBy("recording").agg(F.countDistinct("component").alias("components"))
        fitted = sizes.join(exclude, "recording", "left").join(used, "recording", "left")
        by_kind = F.when(F.col("recording").isNotNull(), F.coalesce("source", F.lit("eog")))  # fitted, but nothing stood out
        fitted = fitted.withColumn("source", by_kind)
        clean, fitted = written(ica.remove(clean, model, exclude)), written(fitted)
    codes = written(codes)
    files = markers.missing_files(blocks, codes, m, p.on_missing_codes, p.on_missing_markers)
    every, codes = codes, labels.only_codes(codes, p.contrast.keep)
    kept, status = markers.alignment(markers.without_spans(m), codes, p.gap_s)
    coded = markers.events(kept, codes)
    tokens = dict(zip(("token1", "token2"), p.tokens or ()))
    events = labels.conditions(labels.with_trial_labels(coded, tokens), p.contrast)
    free = epochs.events_without_bad_spans(events, m, sfreq, p.tmin, p.tmax)
    cut = epochs.cut(clean.where("referenced").drop("referenced"), free.select("recording", "seq", "pos", "code", "condition"), p.tmin, p.tmax, p.block_size)
    cut = written(epochs.baseline(cut, *p.baseline) if p.baseline else cut)
    good = epochs.reject(epochs.reject(cut, artifacts.blinks(cut, p.limits)), artifacts.voltage(cut, p.limits))
    summary = qc_summary(cut, p.limits, rate.drop("source"), eog)
    counts = qc.event_counts(every, codes, coded, (*p.contrast.standard, *p.contrast.deviant))
    aligned = status.select("recording", "markers_original", "markers_dropped_by_gap", "markers_dropped_by_auto")
    rates = rate.select("recording", own.alias("blink_rate_per_min"), other.alias("blink_proxy_rate_per_min"))
    for facts in (aligned, counts, rates, component_facts(fitted, p.ica), code_facts(every, p.contrast)):
        summary = summary.join(facts.withColumnRenamed("recording", "subject"), "subject", "left")
    summary = summary.na.fill(0.0, ["eog_corr_max", "eog_corr_mean", "blink_rate_per_min", "blink_proxy_rate_per_min"]).na.fill(False, ["ica_applied"]).na.fill("", ["ica_exclude"])
    summary = summary.withColumns({"sfreq": F.lit(sfreq), "behavioral_keep_codes": F.lit(" ".join(map(str, p.contrast.keep))), "ica_mode": F.lit(p.ica.mode), **{t: F.lit(tokens.get(t)).cast("string") for t in ("token1", "token2")}})
    skipped = qc.skipped(files, status).withColumnRenamed("recording", "subject")
    rows = qc.stacked(summary, skipped).withColumns({"raw_file": F.format_string(p.raw_file, "subject"), "subject_csv": F.format_string(p.codes_file, "subject"), "error": qc.error(F.col("status"))})
    ok = summary.where("status = 'OK'").select(F.col("subject").alias("recording"))
    waves = averages.evoked(good.join(ok, "recording", "left_semi"))
    return {"signal": clean.drop("referenced"), "ica_model": model, "epochs": good, "evoked": waves, "grand_average": averages.grand_average(waves), "qc": rows}


#: Stages of a run, in the order in which they are made.
STAGES = {"signal": "1_signal", "ica_model": "2_ica_model", "epochs": "3_epochs", "evoked": "4_evoked"}
GRAND_AVERAGE = "5_grand_average"


def save_run(tables: Mapping[str, DataFrame], folder: str, recordings: DataFrame, run: str = "") -> None:
    """The tables of :func:`preprocess` as numbered stages, and its QC rows as CSV.

    Recordings of other runs stay.  The grand average is made of all averages
    that are saved, so a rerun of one recording updates it.
    """
    for name, stage in STAGES.items():
        sinks.save_stage(tables[name], folder, stage, recordings, run)
    every = sinks.read_stage(recordings.sparkSession, folder, STAGES["evoked"])
    sinks.save_stage(averages.grand_average(every), folder, GRAND_AVERAGE)
    sinks.save_csv(tables["qc"], f"{folder}/qc{f'-{run}' if run else ''}")


def metrics(e: DataFrame, windows: Sequence[Window] = (Window(),), grid: Tfr = Tfr(), channels: Sequence[str] = ("Fp1", "Fz", "F3", "Cz", "F4"), tmin: float = -0.2, tmax: float = 0.6, conditions: Sequence[str] = ("Standard", "Deviant"), recordings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Workload B: window amplitudes, waveforms and time-frequency tables of an epoch table.

    The time-frequency method is the grid's, multitaper unless it says morlet.
    ``recordings`` names those that may have no epochs at all; they get status rows.
    """
    labels.require_channels(e, channels)
    picked = e.where(F.col("channel").isin(*channels))
    series = averages.erp_timeseries(picked, tmin, tmax, conditions=conditions, recordings=recordings)
    return {"erp_metrics": averages.erp_metrics(picked, windows, conditions=conditions), "erp_timeseries": series, "tfr_metrics": tfr.tfr_metrics(picked, grid, tmin, tmax, conditions=tuple(conditions))}
