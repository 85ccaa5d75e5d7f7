"""Time-frequency power and inter-trial coherence."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import Tfr
from .averages import with_status_rows
from .epochs import baseline, crop
from .vectors import vector_sums

KEY = ["recording", "condition", "channel"]
#: Tapers of a time-bandwidth product of 4.
TAPERS = 3


def morlet(freq: float, cycles: float, sfreq: float, zero_mean: bool = True) -> np.ndarray:
    """A complex wavelet over +-5 standard deviations, scaled to a sum of squares of 2."""
    sigma = cycles / (2 * math.pi * freq)
    n = int(5 * sigma * sfreq)
    t = np.arange(-n, n + 1) / sfreq
    carrier = np.exp(2j * math.pi * freq * t) - (math.exp(-2 * (math.pi * freq * sigma) ** 2) if zero_mean else 0)
    w = carrier * np.exp(-(t**2) / (2 * sigma**2))
    return w * math.sqrt(2) / np.linalg.norm(w)


def tapers(freq: float, cycles: float, sfreq: float, time_bandwidth: float = 4.0) -> list[np.ndarray]:
    """Multitaper wavelets: discrete prolate sequences of cycles / freq seconds times the carrier, demeaned."""
    n = max(int(cycles / freq * sfreq), 3)
    t = (np.arange(n) - (n - 1) / 2) / sfreq
    w, i = time_bandwidth / 2 / n, np.arange(n)
    off = i[1:] * (n - i[1:]) / 2
    matrix = np.diag(((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * w)) + np.diag(off, 1) + np.diag(off, -1)
    _, vectors = np.linalg.eigh(matrix)
    out = []
    for k in range(int(time_bandwidth - 1)):
        x = vectors[:, -1 - k] * np.exp(2j * math.pi * freq * t)
        x = x - x.mean()
        out.append(x * math.sqrt(2) / max(np.linalg.norm(x), 1e-300))
    return out


def _same(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of x convolved with w; as long as the rows, centred."""
    n = x.shape[1] + len(w) - 1
    y = np.fft.ifft(np.fft.fft(x, n, axis=1) * np.fft.fft(w, n)[None, :], axis=1)
    start = (len(w) - 1) // 2
    return y[:, start : start + x.shape[1]]


@lru_cache(maxsize=1024)
def wavelets(freq: float, p: Tfr, sfreq: float, method: str) -> list[np.ndarray]:
    cycles = freq / p.cycles_divisor
    return [morlet(freq, cycles, sfreq)] if method == "morlet" else tapers(freq, cycles, sfreq)


def sums(epochs: DataFrame, p: Tfr, method: str | None = None, salt: int = 8) -> DataFrame:
    """Per recording, condition, channel, frequency and sample: ``power`` and ``itc`` over epochs, and ``n_epochs``.

    ``method`` is the one of ``p`` unless given.  A group's epochs are dealt to
    ``salt`` tasks by hash; each returns arrays of power and of unit phasors per
    taper, which are added element by element and divided last.  Every
    ``p.decim``-th sample from the first on is given.
    """
    freqs, method = p.freqs, method or p.method
    n_tapers = 1 if method == "morlet" else TAPERS
    names = [f"{part}{k}" for k in range(n_tapers) for part in ("power", "re", "im")]

    def transform(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in group["values"]])
        sfreq, rows = float(group["sfreq"].iloc[0]), []
        for f in freqs:
            row = []
            for w in wavelets(f, p, sfreq, method):
                z = _same(x, w)
                size = np.abs(z)
                unit = np.divide(z, size, out=np.zeros_like(z), where=size > 0)
                row += [(size**2).sum(0), unit.real.sum(0), unit.imag.sum(0)]
            rows.append((f, np.full(x.shape[1], float(len(x))), *row))
        out = pd.DataFrame(rows, columns=["frequency", "n", *names])
        for c in (*KEY, "sfreq", "rel0"):
            out[c] = group[c].iloc[0]
        return out

    schema = "frequency double, n array<double>, " + ", ".join(f"{c} array<double>" for c in names) + ", recording string, condition string, channel string, sfreq double, rel0 int"
    salted = epochs.select(*KEY, "sfreq", "rel0", "values", F.size("values").alias("size"), F.pmod(F.xxhash64("epoch_id"), F.lit(salt)).alias("salt"))
    parts = salted.where("size > 0").groupBy(*KEY, "sfreq", "rel0", "size", "salt").applyInPandas(transform, schema)
    merged = vector_sums(parts, [*KEY, "frequency", "sfreq"], ["n", *names], "rel0")
    long = merged.select(*KEY, "frequency", "sfreq", "first", F.posexplode(F.arrays_zip("n", *names)).alias("i", "v")).where(F.col("i") % p.decim == 0)
    v = lambda c: F.col(f"v.{c}")
    mean = lambda of: sum((of(k) for k in range(1, n_tapers)), of(0)) / v("n") / n_tapers
    power, itc = mean(lambda k: v(f"power{k}")), mean(lambda k: F.sqrt(v(f"re{k}") * v(f"re{k}") + v(f"im{k}") * v(f"im{k}")))
    return long.where("v.n > 0").select(*KEY, "frequency", "sfreq", (F.col("first") + F.col("i")).cast("int").alias("rel"), power.alias("power"), itc.alias("itc"), v("n").cast("long").alias("n_epochs"))


def evoked_power(waves: DataFrame, p: Tfr, method: str | None = None) -> DataFrame:
    """Power of the condition averages in ``waves(recording, condition, channel, rel, sfreq, value)``."""
    rows = waves.groupBy(*KEY).agg(F.first("sfreq").alias("sfreq"), F.min("rel").alias("rel0"), F.sort_array(F.collect_list(F.struct("rel", "value")))["value"].alias("values"))
    one = sums(rows.withColumn("epoch_id", F.lit(0)), p, method, salt=1)
    return one.select(*KEY, "frequency", "sfreq", "rel", F.col("power").alias("evoked"))


def rescaled(df: DataFrame, columns: list[str], base: tuple[float, float], mode: str) -> DataFrame:
    """A baseline in the time-frequency plane, per key and frequency; ratios with a zero baseline are NULL."""
    w = W.partitionBy(*KEY, "frequency")
    inside = F.col("rel").between(F.rint(F.lit(base[0]) * F.col("sfreq")), F.rint(F.lit(base[1]) * F.col("sfreq")))
    new = {}
    for c in columns:
        x, m = F.col(c), F.avg(F.when(inside, F.col(c))).over(w)
        ratio = F.try_divide(x, m)
        log = F.when(ratio > 0, F.log10(ratio))
        new[c] = {
            "mean": x - m,
            "ratio": ratio,
            "logratio": log,
            "percent": F.try_divide(x - m, m),
            "zscore": F.try_divide(x - m, F.stddev_pop(F.when(inside, x)).over(w)),
            "zlogratio": log,
        }[mode]
    out = df.withColumns(new)
    if mode == "zlogratio":
        out = out.withColumns({c: F.try_divide(F.col(c), F.stddev_pop(F.when(inside, F.col(c))).over(w)) for c in columns})
    return out


def tfr_metrics(epochs: DataFrame, p: Tfr = Tfr(), tmin: float = -0.2, tmax: float = 0.6, epoch_baseline: tuple[float, float] | None = (-0.2, 0.0), conditions: tuple[str, ...] = ("Standard", "Deviant"), method: str | None = None) -> DataFrame:
    """Total, evoked and induced power and coherence as one tidy table with status rows.

    Induced power is total minus evoked, both after the baseline.  Fails where
    one has a channel, frequency or time that the other lacks.
    """
    from .averages import evoked

    e = crop(epochs.where(F.col("condition").isin(*conditions)), tmin, tmax)
    e = baseline(e, *epoch_baseline) if epoch_baseline else e
    one, other = sums(e, p, method).withColumn("in_total", F.lit(True)), evoked_power(evoked(e), p, method).withColumn("in_evoked", F.lit(True))
    both = one.join(other, [*KEY, "frequency", "sfreq", "rel"], "full")
    differ = F.raise_error(F.concat(F.lit("axes of total and evoked power differ in recording "), F.col("recording"))).cast("double")
    both = both.withColumn("power", F.when(F.col("in_total").isNull() | F.col("in_evoked").isNull(), differ).otherwise(F.col("power"))).drop("in_total", "in_evoked")
    if p.baseline:
        both = rescaled(both, ["power", "evoked", "itc"], p.baseline, p.mode)
    rows = both.select("recording", "condition", "channel", "frequency", (F.col("rel") / F.col("sfreq")).alias("time"), F.col("power").alias("total_power"), F.col("evoked").alias("evoked_power"), (F.col("power") - F.col("evoked")).alias("induced_power"), "itc", "n_epochs")
    return with_status_rows(rows, epochs, conditions, "MISSING_CONDITION").withColumnRenamed("recording", "subject")
