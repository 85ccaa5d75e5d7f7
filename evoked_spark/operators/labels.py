"""Projections and filters of events, channels and recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..params import CodeScheme, Contrast


def only_recordings(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the named recordings, in any case; no names keep all."""
    return df.where(F.lower("recording").isin(*[n.lower() for n in names])) if names else df


def only_codes(df: DataFrame, keep: Sequence[int]) -> DataFrame:
    return df.where(F.col("code").isin(*keep)) if keep else df


def with_trial_labels(events: DataFrame, tokens: dict[str, str] | None = None, scheme: CodeScheme = CodeScheme()) -> DataFrame:
    """Decoded digits, flags, variant, roles and labels appended to rows with a ``code``."""
    code = F.col("code")
    a, b, c = C.digits(code)
    roles = C.roles(code, scheme)
    out = events.withColumns({"digit_a": a, "digit_b": b, "digit_c": c, **C.flags(code, scheme), "variant": C.variant(code, scheme), **roles})
    named = {name.replace("role", "label"): C.label(F.col(name), tokens or {}) for name in roles}
    return out.withColumns(named)


def conditions(events: DataFrame, contrast: Contrast) -> DataFrame:
    """Standard and deviant events only, with ``condition_id`` 1 or 2 and ``condition``."""
    standard = F.col("code").isin(*contrast.standard)
    kept = events.where(F.col("code").isin(*contrast.standard, *contrast.deviant))
    return kept.withColumn("condition_id", F.when(standard, 1).otherwise(2)).withColumn("condition", F.when(standard, "Standard").otherwise("Deviant"))


def pick_channels(df: DataFrame, wanted: Sequence[str] = (), aux: Sequence[str] = (), eog: Sequence[str] = ()) -> DataFrame:
    """Drops auxiliary channels, marks EOG ones, keeps the wanted ones that exist."""
    df = df.where(~F.col("channel").isin(*aux)) if aux else df
    df = df.withColumn("kind", F.when(F.col("channel").isin(*eog), "eog").otherwise(F.col("kind"))) if eog else df
    return df.where(F.col("channel").isin(*wanted)) if wanted else df


def require_channels(df: DataFrame, wanted: Sequence[str]) -> None:
    """Fails if none of the wanted channels exists."""
    if wanted and df.where(F.col("channel").isin(*wanted)).isEmpty():
        raise ValueError(f"none of the channels {list(wanted)} exists")
