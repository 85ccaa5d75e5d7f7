"""Functions of sample arrays; ``rel`` is a sample's offset from its event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(seconds: float, sfreq: Column | float) -> Column:
    """A time as a sample offset, rounded half to even; bounds are inclusive."""
    rate = sfreq if isinstance(sfreq, Column) else F.lit(sfreq)
    return F.rint(F.lit(float(seconds)) * rate).cast("int")


def cropped(values: Column, rel0: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The samples with low <= rel <= high, and the rel of the first one."""
    start = F.greatest(low - rel0, F.lit(0))
    length = F.greatest(F.least(high - rel0 + 1, F.size(values)) - start, F.lit(0))
    return F.slice(values, start + 1, length), rel0 + start


def mean(values: Column) -> Column:
    """NULL for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def shifted(values: Column, by: Column) -> Column:
    """values - by, with ``by`` computed once."""
    return F.element_at(F.transform(F.array(by), lambda m: F.transform(values, lambda x: x - m)), 1)


def microvolts(values: Column) -> Column:
    return F.transform(values, lambda x: x * 1e6)


def peak_to_peak(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def window_samples(ms: float, sfreq: Column | float) -> Column:
    """max(1, round(ms * sfreq / 1000))."""
    rate = sfreq if isinstance(sfreq, Column) else F.lit(sfreq)
    return F.greatest(F.rint(F.lit(float(ms)) * rate / 1000).cast("int"), F.lit(1))
