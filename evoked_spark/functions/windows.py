"""Moving windows over sample arrays, in time linear in the samples whatever the width."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sliding(a: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of(a[..., i : i + width]) for every i, along the last axis.

    Values run forward and backward inside stretches of ``width``; a window is
    the end of one stretch and the beginning of the next.
    """
    n = a.shape[-1] - width + 1
    if n <= 0:
        return a[..., :0]
    fill = np.repeat(a[..., -1:], -a.shape[-1] % width, axis=-1)
    parts = np.concatenate([a, fill], axis=-1).reshape(*a.shape[:-1], -1, width)
    ahead = of.accumulate(parts, axis=-1).reshape(*a.shape[:-1], -1)
    behind = of.accumulate(parts[..., ::-1], axis=-1)[..., ::-1].reshape(*a.shape[:-1], -1)
    return of(behind[..., :n], ahead[..., width - 1 : width - 1 + n])


def peak_to_peak(a: np.ndarray, width: int) -> np.ndarray:
    return sliding(a, width, np.maximum) - sliding(a, width, np.minimum)


@F.pandas_udf(T.BooleanType())
def _exceeds(values: pd.Series, width: pd.Series, step: pd.Series, limit: pd.Series) -> pd.Series:
    out = np.zeros(len(values), bool)
    sizes = values.map(len).to_numpy()
    kinds = pd.DataFrame({"n": sizes, "w": width, "s": step, "l": limit})
    for (n, w, s, most), rows in kinds.groupby(["n", "w", "s", "l"]).indices.items():
        if n:  # rows of one kind together
            x = np.stack([np.asarray(v, float) for v in values.iloc[rows]])
            with np.errstate(invalid="ignore"):
                out[rows] = (peak_to_peak(x, min(int(w), int(n)))[:, :: int(s)] >= most).any(1)
    return pd.Series(out)


def moving_exceeds(values: Column, width: Column, step: Column, limit: float) -> Column:
    """Whether a window of ``width`` samples at 0, step, 2 step ... spans ``limit`` or more.

    Data shorter than a window is one window; an empty or null array never exceeds.
    """
    empty = F.array().cast("array<double>")
    return _exceeds(F.coalesce(values, empty), width, step, F.lit(float(limit)))
