"""Removal of ocular components, and the decision whether to."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import Ica
from ..sources.lineage import work_table, written
from .artifacts import pair_correlations

MODEL = "recording string, component int, channel string, unmix double, mix double"


def recommendation(reject_rate: Column, eog_corr: Column, blink_rate: Column, proxy_rate: Column, per_min: float = 20, loss: float = 0.20, corr: float = 0.30, dedupe: bool = False) -> tuple[Column, Column]:
    """(recommended, reasons joined by +); limits are exceeded strictly.  The blink reason closes the list again unless ``dedupe``."""
    over = lambda c, limit, text: F.when(c > limit, text)
    blink = over(blink_rate, per_min, f"blink_rate>{per_min:g}/min")
    proxy = over(proxy_rate, per_min, f"blink_proxy>{per_min:g}/min")
    reasons = [blink, proxy, over(reject_rate, loss, f"epoch_loss>{loss:.2f}"), over(eog_corr, corr, f"eog_corr>{corr:.2f}"), *([] if dedupe else [blink])]
    text = F.concat_ws("+", *reasons)
    return text != "", text


def gate(mode: str, eog_rate: Column, proxy_rate: Column, threshold: float) -> Column:
    """Whether to fit: always, never, or if the EOG rate, else the proxy rate, reaches the threshold."""
    if mode != "auto":
        return F.lit(mode == "on")
    return F.coalesce(F.coalesce(F.nullif(eog_rate, F.lit(0.0)), proxy_rate) >= threshold, F.lit(False))


def whitening(cov: np.ndarray, mean: np.ndarray, p: Ica) -> np.ndarray:
    """Components x channels: PCA of the signal, scaled as a whole, to a number of components or a share of variance."""
    scale = math.sqrt((np.diag(cov) + (mean - mean.mean()) ** 2).mean()) or 1.0
    u, s, _ = np.linalg.svd(cov / scale**2)
    wanted = p.components or int(np.searchsorted(np.cumsum(s) / max(s.sum(), 1e-300), p.variance, side="right")) + 1
    k = min(wanted, int((s > 1e-12 * max(s[0], 1e-300)).sum()))
    return (u[:, :k] / np.sqrt(s[:k])).T / scale


def orthogonal(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w)
    return u @ v


def first_rotation(k: int, p: Ica) -> np.ndarray:
    return orthogonal(np.random.RandomState(p.seed).normal(size=(k, k)))


def fixed_point(w: np.ndarray, gz: np.ndarray, slope: np.ndarray, n: float) -> np.ndarray:
    """One symmetric round with logcosh: from the sums of tanh(w z) z' and of its slopes over all samples."""
    return orthogonal(gz / n - (slope / n)[:, None] * w)


@dataclass
class Step:
    """How far a round goes: all the way, and half as far whenever ``patience`` rounds bring no progress, so that rounds that circle settle."""

    size: float = 1.0
    best: float = math.inf
    waited: int = 0
    patience: int = 8

    def taken(self, w: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, float]:
        """The next rotation, and how far the rows of ``new`` are off those of w, signs aside."""
        same = (new * w).sum(1)
        off = float(np.max(np.abs(np.abs(same) - 1)))
        out = new if self.size == 1 else orthogonal((1 - self.size) * w + self.size * np.where(same < 0, -1, 1)[:, None] * new)
        self.waited = 0 if off < 0.9 * self.best else self.waited + 1
        self.best = min(self.best, off)
        if self.waited >= self.patience:
            self.size, self.best, self.waited = max(self.size / 2, 1 / 16), off, 0
        return out, off


def thinned(blocks: DataFrame, every: int) -> DataFrame:
    """Blocks with every ``every``-th sample of the whole signal."""
    kept = F.filter("values", lambda v, i: F.pmod(F.col("start") + i, F.lit(every)) == 0)
    return blocks.withColumn("values", kept) if every > 1 else blocks


Matrices = dict[str, tuple[np.ndarray, ...]]


def whole_samples(channels: Sequence[str], rows: Sequence[np.ndarray], names: Sequence[str]) -> np.ndarray:
    """Channels ``names`` x those samples of a frame at which each of them has a value."""
    own = dict(zip(channels, rows))
    n = min(len(own.get(c, ())) for c in names)
    x = np.array([np.asarray(own[c], float)[:n] for c in names]) if n else np.zeros((len(names), 0))
    return x[:, ~np.isnan(x).any(0)]


def _totals(frames: DataFrame, names: dict[str, list[str]], add: Callable[[np.ndarray, tuple[np.ndarray, ...]], np.ndarray], given: Matrices | None) -> dict[str, np.ndarray]:
    """add(whole samples, matrices of the recording), summed over all frames of each recording of ``given`` (None: of all).

    Tasks add up what they read; frames are ordered by recording, so the driver
    gets about one small array per task and recording.
    """
    shared = frames.sparkSession.sparkContext.broadcast((names, given))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        names, given = shared.value
        for batch in batches:
            for r, channels, data in zip(batch["recording"], batch["channels"], batch["data"]):
                if given is None or r in given:
                    part = add(whole_samples(channels, data, names[r]), given[r] if given is not None else ())
                    held[r] = held[r] + part if r in held else part
        if held:
            yield pd.DataFrame({"recording": list(held), "total": [t.ravel() for t in held.values()]})

    out: dict[str, np.ndarray] = {}
    for row in frames.mapInPandas(run, "recording string, total array<double>").collect():
        part = np.asarray(row["total"])
        out[row["recording"]] = out[row["recording"]] + part if row["recording"] in out else part
    shared.unpersist()
    return out


def _fit_wave(frames: DataFrame, names: dict[str, list[str]], p: Ica) -> pd.DataFrame:
    """The models of some recordings; every round is one pass over their frames."""
    sums = _totals(frames, names, lambda x, _: np.append(x.sum(1), x.shape[1]), None)
    mean = {r: t[:-1] / max(t[-1], 1) for r, t in sums.items() if t[-1]}
    n = {r: sums[r][-1] for r in mean}

    def products(x: np.ndarray, own: tuple[np.ndarray, ...]) -> np.ndarray:
        c = x - own[0][:, None]
        return c @ c.T

    cov = {r: t.reshape(len(mean[r]), -1) / n[r] for r, t in _totals(frames, names, products, {r: (m,) for r, m in mean.items()}).items()}
    white = {r: whitening(cov[r], mean[r], p) for r in mean}
    w = {r: first_rotation(len(v), p) for r, v in white.items() if len(v)}

    def moments(x: np.ndarray, own: tuple[np.ndarray, ...]) -> np.ndarray:
        z = own[1] @ (x - own[0][:, None])
        g = np.tanh(own[2] @ z)
        return np.concatenate([(g @ z.T).ravel(), (1 - g**2).sum(1)])

    steps = {r: Step() for r in w}
    open_ = set(w)
    for _ in range(p.iterations):
        if not open_:
            break
        found = _totals(frames, names, moments, {r: (mean[r], white[r], w[r]) for r in open_})
        for r in list(open_):
            k = len(w[r])
            w[r], off = steps[r].taken(w[r], fixed_point(w[r], found[r][: k * k].reshape(k, k), found[r][k * k :], n[r]))
            if off < p.tolerance:
                open_.discard(r)
    rows = []
    for r in sorted(w):
        unmix = w[r] @ white[r]
        mix = np.linalg.pinv(unmix)
        order = np.argsort(-(mix**2).sum(0))
        rows += [(r, i, c, unmix[k, j], mix[j, k]) for i, k in enumerate(order) for j, c in enumerate(names[r])]
    return pd.DataFrame(rows, columns=["recording", "component", "channel", "unmix", "mix"])


def fit(blocks: DataFrame, p: Ica = Ica(), wave: int = 256) -> DataFrame:
    """``ica_model`` rows per recording, from EEG blocks that were filtered before.

    Every sample that decimation leaves takes part, if each channel of the
    recording has a value there: the fit is one of vectors over the channels.
    Recordings with other samples, such as an end that some channels lack, are
    counted in a warning.  Means, covariances and the
    rounds of the fixed point are sums over frames, so a recording may lie in
    any number of tasks; the driver holds the small matrices of ``wave``
    recordings at a time.  Recordings of a wave go through their rounds
    together until each has settled or ``p.iterations`` are over.  A recording
    without such samples, or without variance, has no rows.
    """
    spark = blocks.sparkSession
    kept = thinned(blocks.where("kind = 'eeg'"), p.decimate)
    rows = kept.groupBy("recording", "block").agg(F.sort_array(F.collect_list(F.struct("channel", "values"))).alias("rows"))
    frames = rows.select("recording", "block", F.col("rows.channel").alias("channels"), F.col("rows.values").alias("data"))
    waves = max(1, -(-kept.select("recording").distinct().count() // wave))
    frames = frames.withColumn("wave", F.pmod(F.xxhash64("recording"), F.lit(waves)).cast("int")).repartitionByRange("wave", "recording", "block")
    models, ragged = [], 0
    with work_table(frames, "wave") as path:
        for i in range(waves):  # reads its own folder, again and again
            part = spark.read.schema(frames.schema).parquet(path).where(F.col("wave") == i)
            lengths = F.transform("data", lambda v: F.size(F.filter(v, lambda s: s.isNotNull() & ~F.isnan(s))))
            facts = part.groupBy("recording").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("channels"), F.min(F.size("channels")).alias("fewest"), F.bool_or(F.array_min(lengths) < F.array_max(F.transform("data", F.size))).alias("gaps")).collect()
            names = {r["recording"]: r["channels"] for r in facts}
            ragged += sum(r["gaps"] or r["fewest"] < len(r["channels"]) for r in facts)
            model = spark.createDataFrame(_fit_wave(part, names, p), MODEL)
            models.append(written(model) if waves > 1 else model)
    if ragged:
        warnings.warn(f"{ragged} recordings have samples that some of their channels lack; the fit leaves these samples out", stacklevel=2)
    return reduce(DataFrame.unionAll, models)


def _with_model(blocks: DataFrame, model: DataFrame, *weights: str) -> DataFrame:
    """One row per block that holds all its channels of the model, and the recording's model: products of matrices are local to it."""
    own = blocks.join(model.select("recording", "channel").distinct(), ["recording", "channel"], "left_semi")
    rows = own.groupBy("recording", "block").agg(F.min("start").alias("start"), F.min("sfreq").alias("sfreq"), F.sort_array(F.collect_list(F.struct("channel", "values"))).alias("rows"))
    models = model.groupBy("recording").agg(F.collect_list(F.struct("component", "channel", *weights)).alias("model"))  # components x channels
    return rows.select("recording", "block", "start", "sfreq", F.col("rows.channel").alias("channels"), F.col("rows.values").alias("data")).join(models, "recording")


def _matrix(model: list, channels: list[str], weight: str) -> tuple[list[int], np.ndarray]:
    """The components and their weights, components x channels."""
    place, own = {c: i for i, c in enumerate(channels)}, sorted({m["component"] for m in model})
    row, out = {k: i for i, k in enumerate(own)}, np.zeros((len(own), len(channels)))
    for m in model:
        if m["channel"] in place:
            out[row[m["component"]], place[m["channel"]]] = m[weight]
    return own, out


def _padded(rows: Sequence[np.ndarray]) -> np.ndarray:
    """Channels x samples of the longest row; shorter rows end in zeros, which add nothing to a weighted sum."""
    out = np.zeros((len(rows), max(map(len, rows))))
    for to, v in zip(out, rows):
        to[: len(v)] = v
    return out


def sources(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """Component signals as blocks, channel ``ICAnnn``: weighted sums, at each sample, of the channels of a block that have it."""
    schema = "recording string, component int, block long, start long, sfreq double, values array<double>"

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own, unmix = _matrix(r.model, r.channels, "unmix")
                values = unmix @ _padded(r.data)
                out += [(r.recording, k, r.block, r.start, r.sfreq, v) for k, v in zip(own, values)]
            yield pd.DataFrame(out, columns=["recording", "component", "block", "start", "sfreq", "values"])

    out = _with_model(blocks, model, "unmix").mapInPandas(weigh, schema)
    return out.withColumn("channel", F.format_string("ICA%03d", "component"))


def rank(scores: DataFrame, p: Ica = Ica(), top: int = 10) -> DataFrame:
    """``(recording, exclude, candidates, top_scores)`` from ``scores(recording, component, r)``: |r| at or above the threshold, the largest first."""
    r = F.coalesce("r", F.lit(0.0))
    ranked = scores.withColumn("r", r).withColumn("rank", F.row_number().over(W.partitionBy("recording").orderBy(F.desc(F.abs("r")), "component")))
    pick = lambda test, c: F.sort_array(F.collect_list(F.when(test, F.struct("rank", c))))[c]
    return ranked.groupBy("recording").agg(pick((F.col("rank") <= p.most) & (F.abs("r") >= p.threshold), "component").alias("exclude"), pick(F.col("rank") <= top, "component").alias("candidates"), pick(F.col("rank") <= top, "r").alias("top_scores"))


def proxy_scores(parts: DataFrame, proxy: DataFrame) -> DataFrame:
    """Correlation of each component with the proxy channel's blocks."""
    r = pair_correlations(parts, proxy)
    return r.select("recording", F.regexp_extract("a", "([0-9]+)", 1).cast("int").alias("component"), "r")


def first_channel(blocks: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``(recording, channel)``: each recording's first channel in the order of a list; those outside it follow by name."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]).cast("array<string>"), F.col("channel"))
    return blocks.groupBy("recording").agg(F.min_by("channel", F.struct(F.when(place > 0, place).otherwise(len(order) + 1), "channel")).alias("channel"))


def eog_scores(blocks: DataFrame, model: DataFrame, channels: Sequence[str] = ()) -> DataFrame:
    """Correlation of each component with the first EOG channel in the order of ``channels``; blocks are band-passed before."""
    eog = blocks.where("kind = 'eog'")
    first = eog.join(first_channel(eog, channels), ["recording", "channel"])
    return proxy_scores(sources(blocks.where("kind = 'eeg'"), model), first)


def eog_outliers(scores: DataFrame, z: float = 3.0, most: int = 3, rounds: int = 2) -> DataFrame:
    """``(recording, exclude, candidates, top_scores)``: components whose r is more than ``z`` standard deviations off the mean.

    Mean and deviation are taken anew, without the outliers found so far, in
    each of ``rounds`` rounds.  ``candidates`` are all outliers by |r|,
    ``exclude`` the first ``most`` of them; recordings without any have no row.
    """
    w = W.partitionBy("recording")
    marked = scores.withColumn("out", F.lit(False))
    for _ in range(rounds):
        rest = F.when(~F.col("out"), F.col("r"))
        off = F.abs(F.try_divide(rest - F.avg(rest).over(w), F.stddev_pop(rest).over(w)))
        marked = marked.withColumn("out", F.col("out") | F.coalesce(off > z * (1 + 1e-6), F.lit(False)))  # two components are one deviation off, whatever rounding says
    far = marked.where("out").withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("r")), "component")))
    found = far.groupBy("recording").agg(F.sort_array(F.collect_list(F.struct("rank", "component", "r"))).alias("found"))
    return found.select("recording", F.slice("found.component", 1, most).alias("exclude"), F.col("found.component").alias("candidates"), F.col("found.r").alias("top_scores"))


def remove(blocks: DataFrame, model: DataFrame, exclude: DataFrame) -> DataFrame:
    """Blocks without the excluded components; recordings and channels the model doesn't have stay as they are."""
    out = exclude.select("recording", F.explode("exclude").alias("component"))
    bad = model.join(out, ["recording", "component"])

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                gone = _matrix(r.model, r.channels, "mix")[1].T @ (_matrix(r.model, r.channels, "unmix")[1] @ _padded(r.data))
                out += [(r.recording, c, r.block, v[: len(own)]) for c, v, own in zip(r.channels, gone, r.data)]
            yield pd.DataFrame(out, columns=["recording", "channel", "block", "gone"])

    gone = _with_model(blocks, bad, "unmix", "mix").mapInPandas(shares, "recording string, channel string, block long, gone array<double>")
    joined = blocks.join(gone, ["recording", "channel", "block"], "left")
    return joined.withColumn("values", F.when(F.col("gone").isNull(), F.col("values")).otherwise(F.zip_with("values", "gone", lambda v, g: v - g))).drop("gone")
