"""Mixing sources to target weights by weighted fair queueing.

Every document joins the queue of its source in a shuffled order.  A copy of a
document finishes at the virtual time (tokens of its source queued so far, this
copy included) / (target of the source).  All copies are put in one global
order of finish time and the mix is cut where the token budget is used up, so
every source has then been served in proportion to its target.

All cumulative sums are two-level: sums per bucket of the order, offsets over
the bounded table of buckets, and a running sum inside one bucket.  A source
with a third of all rows is therefore spread over all its buckets, and no
global sort goes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, words

#: Weights that the sources take in turn, by code point order of their names.
WEIGHTS = (3, 1, 2)
#: Copies that one task orders at the cut, and the finest buckets of finish times.
EDGE_COPIES, FINEST = 10_000, 2**40


def source_targets(sizes: DataFrame, budget_share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources share ``budget_share`` of all tokens by weight; a target stops at
    ``most`` times its source's size and the excess is shared again by weight,
    which ends at target = min(cap, level * weight) for one common level.  The
    capped sources are those with the smallest cap / weight, found by one pass
    over the sources in that order.  Null is a source of its own and comes last.
    One row per source meets in one task: sources are a closed list, not rows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    s = s.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget_share)))
    s = s.withColumn("caps_to", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("rest", F.sum("weight").over(W.partitionBy()) - F.sum("weight").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("capped", F.col("caps_to") + F.col("ratio") * F.col("rest") <= F.col("budget"))
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(W.partitionBy()), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(W.partitionBy())
    level = F.try_divide(F.col("budget") - spent, open_weight.cast("double"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def fair_queue(docs: DataFrame, most: int = 2, budget_share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", buckets: int = 1024, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``rec`` (its columns, or those in ``carry``), ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``).

    The shuffle is the md5 of the seed and the id, so reruns agree; ids that
    are equal or null queue by size and then in any order, which changes no
    count.  A document is taken whole; the last one that would pass the budget
    and all behind it stay out.  An empty text has no tokens and costs nothing;
    a source without tokens has target 0 and is not taken.  An empty table
    gives an empty mix.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    size = F.size(words(F.col(f"`{text_col}`").cast("string"))).cast("long")
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary"))
    rec = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(rec.alias("rec"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), shuffled.alias("place"))
    rows = scratch.save(rows.withColumn("slot", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")))
    targets = scratch.save(source_targets(rows.select("source", "size"), budget_share, most, weights))

    queue = F.concat(F.lit("="), F.col("source"))  # a key that null sources can be joined by
    keyed = lambda df: df.withColumn("queue", F.coalesce(queue, F.lit("null"))).drop("source")
    slots = keyed(rows).groupBy("queue", "slot").agg(F.sum("size").alias("slot_size"))
    before = F.coalesce(F.sum("slot_size").over(W.partitionBy("queue").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = scratch.save(slots.select("queue", "slot", before.alias("before")))
    inside = F.sum("size").over(W.partitionBy("queue", "slot").orderBy("place", "size").rowsBetween(W.unboundedPreceding, 0))
    queued = keyed(rows).withColumn("inside", inside).join(slots, ["queue", "slot"]).join(keyed(targets), "queue")
    queued = queued.withColumn("queued", F.col("before") + F.col("inside"))

    def place(copy: int) -> Column:
        """Where a copy stands in the global order."""
        finish = F.try_divide((F.col("queued") + F.lit(copy) * F.col("source_size")).cast("double"), F.col("target"))
        return F.struct(finish.alias("finish"), F.col("place"), F.col("size"))

    # a target is reached at time 1; time 2 and later matter only where single documents outweigh targets
    bucket_of = lambda key, scale: F.least(F.floor(key["finish"] * scale), F.lit(2 * scale)).cast("long")
    narrow = scratch.save(queued.select("size", "place", "source_size", "target", "queued"))
    copies = narrow.select(F.explode(F.array(*[place(i) for i in range(most)])).alias("key")).where("key.finish is not null")

    # the cut: the bucket where the budget is used up, split by the same rule until it is small, and the last copy inside it
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    edge, last, start, scale, inside = None, None, 0, buckets, copies
    while True:
        sums = inside.groupBy(bucket_of(F.col("key"), scale).alias("bucket")).agg(F.sum("key.size").alias("tokens"), F.count("*").alias("n"))
        upto = F.lit(start) + F.sum("tokens").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        crossing = sums.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("bucket").first()
        if crossing is None:  # only where everything is taken
            break
        edge, start = crossing["bucket"], crossing["upto"] - crossing["tokens"]
        inside = inside.where(bucket_of(F.col("key"), scale) == edge)
        if crossing["n"] <= EDGE_COPIES or scale * buckets > FINEST:
            break
        scale *= buckets
    if edge is not None:
        running = F.lit(start) + F.sum("key.size").over(W.orderBy("key").rangeBetween(W.unboundedPreceding, 0))
        last = inside.withColumn("running", running).where(F.col("running") <= budget).agg(F.max("key")).first()[0]

    def taken(copy: int) -> Column:
        key = place(copy)
        if edge is None:
            return F.when(key["finish"].isNotNull(), 1).otherwise(0)
        inside_cut = bucket_of(key, scale) < edge
        if last is not None:
            cut = F.struct(*[F.lit(last[c]).cast(kind).alias(c) for c, kind in (("finish", "double"), ("place", "string"), ("size", "long"))])
            inside_cut |= (bucket_of(key, scale) == edge) & (key <= cut)
        return F.when(key["finish"].isNotNull() & inside_cut, 1).otherwise(0)

    taken_copies = sum((taken(i) for i in range(1, most)), taken(0)).cast("long")
    return queued.select("rec", "size", "source_size", "target", taken_copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    queue = fair_queue(docs, **options)
    return queue.select("rec", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("rec.*")
