"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose signal is above a cutoff.  Labelled rows
choose the cutoffs, per stratum (language), in two halves.  The first half picks
a cutoff for every rule and puts the rules in order of what they gain.  The
second, held out, tests the growing unions of rules in that order: "the first m
rules together reject more than the allowed share of good documents" is tested
with the exact binomial tail at level ``confidence / number of strata``, until a
union fails.  Tests in an order fixed beforehand need no further correction
(fixed-sequence testing), and strata share the level (Bonferroni); so with
probability 1 - ``confidence`` no stratum rejects more than ``false_rejection``
of its good documents.  Rules behind the last certified union reject nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, words

#: Signal name -> the cutoffs that may be chosen for it.
CUTOFFS = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "upper_ratio": (0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "shout_ratio": (0.02, 0.05, 0.1, 0.2, 0.3),
    "digit_ratio": (0.05, 0.1, 0.2, 0.3, 0.5),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.6),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.3),
    "word_length": (9.0, 10.0, 12.0, 15.0, 20.0),
}
WINDOW = 8


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(grams: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window found at least twice; ``grams`` holds one hash per window, in order."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twin = lambda e, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == e["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == e["h"]))
        starts = F.sort_array(F.transform(F.filter(pairs, twin), lambda e: e["p"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["at"])).alias("n"), p.alias("at"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    return F.when(repeats, _bind(pairs, covered)).otherwise(0)


def with_signals(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """``rec`` (the columns of each row, or those in ``carry``), ``stratum``, the counts and the rule signals.

    Counts are taken over the whole text; a null text has no words.  Ratios of
    a text without words are 0.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rec = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    # every array becomes a column of its own before a lambda reads it
    a = docs.select(rec.alias("rec"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("stratum"), text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    window = lambda i: F.xxhash64(F.slice("w", i, WINDOW))
    grams = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), window)).otherwise(F.array().cast("array<bigint>"))
    count = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    b = a.select("rec", "stratum", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), count("[^#*$%&|<>]+").cast("long").alias("n_symbols"), count("[^A-Z]+").alias("n_upper"), count("[^!]+").alias("n_shout"), count("[^0-9]+").alias("n_digits"), lines.alias("lines"), grams.alias("grams"))
    c = b.select("rec", "stratum", "n_words", "word_chars", "n_symbols", "n_upper", "n_shout", "n_digits", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("grams")).cast("long").alias("n_repeat_words"))
    share = lambda part, of: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of)), F.lit(0.0))
    signals = {"symbol_ratio": share("n_symbols", "word_chars"), "upper_ratio": share("n_upper", "word_chars"), "shout_ratio": share("n_shout", "word_chars"), "digit_ratio": share("n_digits", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return c.select("rec", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), *[v.alias(k) for k, v in signals.items()])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in the log domain; 1 where k is at or above n * p."""
    import math

    odds = math.log(p) - math.log1p(-p)
    first = F.struct((n * F.lit(math.log1p(-p))).alias("log_term"), F.exp(n * F.lit(math.log1p(-p))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["log_term"] + F.ln((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("log_term"), (acc["total"] + F.exp(term)).alias("total"))

    some = F.aggregate(F.sequence(F.lit(1).cast("long"), k.cast("long")), first, step, lambda acc: acc["total"])
    return F.when(k >= n * p, 1.0).when(k <= 0, F.exp(n * F.lit(math.log1p(-p)))).otherwise(F.least(some, F.lit(1.0)))


def thresholds(labelled: DataFrame, cutoffs: dict[str, tuple[float, ...]] = CUTOFFS, false_rejection: float = 0.05, confidence: float = 0.05, cost: int = 20) -> DataFrame:
    """``(stratum, rule, cutoff)`` certified on ``labelled(stratum, good, held_out, <signals>)``.

    Of the cutoffs of a rule the one with the most bad rejected minus ``cost``
    times the good rejected is tried, the largest at ties, and none if that gain
    isn't above 0.  With a level of 0.01 (5 strata) a union without a hit needs
    90 good held-out labels of its stratum.
    """
    names = list(cutoffs)
    pairs = [(r, c) for r in names for c in cutoffs[r]]
    gains = [(F.count_if(~F.col("good") & (F.col(r) > c)) - cost * F.count_if(F.col("good") & (F.col(r) > c))).alias(f"gain_{i}") for i, (r, c) in enumerate(pairs)]
    tried = labelled.where("not held_out").groupBy("stratum").agg(*gains)
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"gain_{i}").alias("gain"), F.lit(c).alias("cutoff")) for i, (r, c) in enumerate(pairs)])
    best = tried.select("stratum", F.explode(tests).alias("t")).groupBy("stratum", "t.rule").agg(F.max(F.struct("t.gain", "t.cutoff")).alias("b")).where("b.gain > 0")
    place = F.row_number().over(W.partitionBy("stratum").orderBy(F.desc("b.gain"), "rule"))
    order = best.select("stratum", "rule", F.col("b.cutoff").alias("cutoff"), place.alias("place"))
    # one row per stratum: rule -> (place, cutoff)
    table = order.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("place", "cutoff")))).alias("order"))
    held = labelled.where("held_out and good").join(table, "stratum")
    hit = F.least(*[F.when(F.col(r) > F.try_element_at("order", F.lit(r))["cutoff"], F.try_element_at("order", F.lit(r))["place"]) for r in names], F.lit(len(names) + 1))
    counts = held.withColumn("hit", hit).groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("hit") <= m).alias(f"k_{m}") for m in range(1, len(names) + 1)])
    unions = counts.select("stratum", "n", F.posexplode(F.array(*[F.col(f"k_{m}") for m in range(1, len(names) + 1)])).alias("m", "k"))
    strata = labelled.agg(F.count_distinct("stratum")).first()[0]
    passes = binomial_tail(F.col("k"), F.col("n"), false_rejection) <= confidence / max(strata, 1)
    upto = unions.groupBy("stratum").agg(F.coalesce(F.min(F.when(~passes, F.col("m"))), F.lit(len(names))).alias("upto"))
    return order.join(upto, "stratum").where("place <= upto").select("stratum", "rule", "cutoff")


def judged(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """:func:`with_signals` of every row, with ``kept``: passes the base rules and every certified rule of its stratum.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1); of repeated labels the
    lowest counts, null ones don't.  Without labels only the base rules act.
    An empty table gives an empty result.  The limit on false rejection is for
    the certified rules, among documents that pass the base rules; what the base
    rules reject of the good documents comes on top.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    id_name = id_col if carry is None or id_col in carry else None
    rows = scratch.save(with_signals(docs, text_col, lang_col, carry if id_name or carry is None else [*carry, id_col]))
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") == 1).alias("good"))
    passed = rows.where("not base_failed").select(F.col(f"rec.`{id_col}`").alias("label_id"), "stratum", *CUTOFFS)
    labelled = scratch.save(passed.join(marks.hint("merge"), "label_id").withColumn("held_out", F.pmod(F.xxhash64("label_id"), F.lit(2)) == 1))
    chosen = scratch.save(thresholds(labelled))
    # one row per stratum; a map from rule to cutoff
    table = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    rejected = reduce(lambda x, y: x | y, [F.coalesce(F.col(r) > F.try_element_at("cutoffs", F.lit(r)), F.lit(False)) for r in CUTOFFS])
    return rows.join(table, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected).drop("cutoffs")
