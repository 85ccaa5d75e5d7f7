"""Exact dedup by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes.  The root splits the texts by their
length and first digit; each later level splits every group that still has
several members by its next digit.  A group is finished when it is a singleton
or when its texts have ended; members of an ended group are equal byte for
byte, so no digest decides anything.  Digits widen by ``growth`` from level to
level: a text of length n takes part in at most log(n) levels, and only texts
that agree with another one on everything before are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unpacked


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, first: int = 128, growth: int = 32, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``rec`` (the input columns), ``keep_id``, ``group_size``, ``kept``.

    ``carry`` names the columns that ``rec`` holds; without it, all of them.
    A text that isn't carried is let go as soon as its group is finished.

    Of equal texts the row with the largest id stays; a null id is smaller than
    any other, and of repeated rows with that id exactly one stays.  A null text
    equals an empty one.  An empty table gives an empty result.

    Counts and the largest id of each group are aggregated before the shuffle;
    rows meet their group in an equi-join, which the adaptive planner splits
    where a group of copies is hot.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    whole = carry is None or text_col in carry
    rec = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    state = docs.select(rec.alias("rec"), F.col(f"`{id_col}`").alias("id"), (F.lit(None).cast("binary") if whole else body).alias("body"), F.lit(0).cast("long").alias("node"))
    content = F.coalesce(F.col(f"rec.`{text_col}`").cast("string"), F.lit("")).cast("binary") if whole else F.col("body")
    done, offset, width = [], 0, first
    while True:
        keyed = state.withColumn("size", F.octet_length(content)).withColumn("digit", F.substring(content, offset + 1, width))
        groups = keyed.groupBy("node", "size", "digit").agg(F.count("*").alias("n"), F.max("id").alias("keep_id")).where("n > 1")
        groups = scratch.save(groups.withColumn("child", F.monotonically_increasing_id()))
        joined = keyed.join(groups.hint("merge"), ["node", "size", "digit"], "left").withColumn("ended", F.col("size") <= offset + width)
        level = scratch.save(joined.select("rec", "id", F.when(F.col("child").isNotNull() & ~F.col("ended"), F.col("body")).alias("body"), F.col("child").alias("node"), "n", "keep_id", "ended", F.monotonically_increasing_id().alias("uid")))
        scratch.drop(groups)
        done.append(level.where("node is null").select("rec", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))
        ended = level.where("node is not null and ended")
        # one row of each group stays even where rows are repeated with the same id
        stays = scratch.save(ended.where("id <=> keep_id").groupBy("node").agg(F.max("uid").alias("stays")))
        done.append(ended.join(stays.hint("merge"), "node").select("rec", "keep_id", F.col("n").alias("group_size"), (F.col("uid") == F.col("stays")).alias("kept")))
        active = level.where("node is not null and not ended")
        if active.isEmpty():
            return reduce(DataFrame.unionAll, done)
        # finished rows stay in the level's table; only the active ones go on
        state = active.select("rec", "id", "body", "node")
        offset, width = offset + width, width * growth


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return unpacked(radix_groups(docs, id_col, text_col, scratch=scratch).where("kept"), "rec")
