"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 2 bits of each other share a variant within 1 bit of
both.  Every distinct fingerprint emits itself and its 64 one-bit variants; the
shuffle on variants brings such fingerprints together.  A variant's members are
one of 65 known fingerprints, so they are kept as one 64-bit mask and a flag:
the group is never a list, its aggregation is a bit-or that combines before the
shuffle, and all members of a variant are within 2 bits of each other, so a
star to the smallest one links the same documents as all pairs would.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components

SHINGLE = 3
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text in UTF-8, as a signed 64-bit integer; 0 without words.

    Shingles are 3 words of the text with A-Z lower-cased, joined by single
    spaces, repeats included; fewer words are one shingle.  A bit is 1 if it is
    set in over half of the shingles' XXH64 (seed 42).
    """
    import numpy as np
    from xxhash import xxh64_digest

    tokens = text.lower().split()  # bytes: only A-Z, and only space and U+0009..U+000D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(tokens) - SHINGLE + 1, 1)
    starts, ends = starts[:n], ends[-n:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):  # a giant text is counted block by block
        digests = b"".join([xxh64_digest(joined[i:j], 42) for i, j in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([0 if t is None else fingerprint(t) for t in text], dtype="int64")


def links(prints: DataFrame) -> DataFrame:
    """``(u, v)``: pairs of different fingerprints from ``prints(fp)`` at 2 or fewer bits.

    Any two fingerprints within 2 bits are linked directly or through the
    smallest member of a variant they share.
    """
    one = F.lit(1).cast("long")
    flips = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit"))
    shifted = F.when(F.col("bit") < 64, F.call_function("shiftleft", one, F.col("bit"))).otherwise(F.lit(0).cast("long"))
    variants = flips.select(F.col("fp").bitwiseXOR(shifted).alias("variant"), shifted.alias("mask"), (F.col("bit") == 64).alias("own"))
    members = variants.groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
    members = members.where(F.bit_count("mask") + F.col("own").cast("int") > 1)
    set_bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", one, b)), lambda m: F.col("mask").bitwiseAND(m) != 0)
    prints_in = F.concat(F.transform(set_bits, lambda m: F.col("variant").bitwiseXOR(m)), F.when(F.col("own"), F.array("variant")).otherwise(F.array().cast("array<bigint>")))
    stars = members.select(prints_in.alias("all")).select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u <> v").distinct()
    return stars.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)


def components(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint of ``rows(id, fp)``; component_id is the smallest id reachable."""
    prints = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = scratch.save(connected_components(links(prints), scratch))
    linked = prints.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = scratch.save(linked)
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return scratch.save(linked.join(least.hint("merge"), "root").select("fp", "root", "component_id"))


def with_prints(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None, scratch: Scratch) -> DataFrame:
    """``rec``, ``id``, ``fp`` and ``uid`` of every row, written once: fingerprints aren't computed again."""
    rec = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(rec.alias("rec"), F.col(f"`{id_col}`").alias("id"), fingerprints(F.col(f"`{text_col}`").cast("string").cast("binary")).alias("fp"))
    return scratch.save(rows.withColumn("uid", F.monotonically_increasing_id()))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``rec`` (its columns, or those in ``carry``), ``uid``, ``id``, ``fp`` and ``component_id``.

    A null text has no words; texts without words have fingerprint 0 and are
    linked like any other.  A null id never names a component unless all ids
    of it are null.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = with_prints(docs, id_col, text_col, carry, scratch)
    return rows.join(components(rows.select("id", "fp"), scratch).hint("merge"), "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest id (null last).

    Of repeated rows with that id one stays.  Which rows stay is found on ids
    and fingerprints; whole rows are shuffled once.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = with_prints(docs, id_col, text_col, None, scratch)
    narrow = rows.select("uid", "id", "fp").join(components(rows.select("id", "fp"), scratch).hint("merge"), "fp")
    stays = scratch.save(narrow.where("id <=> component_id").groupBy("root").agg(F.min("uid").alias("uid")).select("uid"))
    return rows.join(stays.hint("merge"), "uid", "left_semi").select("rec.*")
