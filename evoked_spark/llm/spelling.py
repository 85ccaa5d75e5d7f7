"""Spelling variants by blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced code point have
letter counts whose squared distance is at most two, and lengths that are equal
or adjacent.  The alphabet is cut into three classes; one edit touches at most
two of them, so near words agree in all counts of at least one class.  Words
are blocked by class, by a bucket of their counts there, and by length, and
large blocks are cut into tiles.  For each pair of tiles of equal or adjacent
length one matrix product gives all squared distances; pairs at most two apart
are compared letter by letter.  A pair is given in the first class in which
its words agree, so it comes once.

Buckets are as many as a fixed number of words each needs, so the work grows
with the vocabulary and not with its square; tiles bound what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .lines import LOWER, UPPER

#: The letters of words, after A-Z were lower-cased: a rule, as a pattern and as code points.
WORD = "[a-zÀ-ÿ]+"
ALPHABET = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
CLASSES = 3
#: Words of a bucket, on average; letters of a tile; numbers of a part of the comparison.
BUCKET_WORDS, TILE_LETTERS, PART = 4096, 16_384, 4_000_000

COLUMN = np.zeros(256, np.int64)
COLUMN[ALPHABET] = np.arange(len(ALPHABET))
CLASS_OF = np.array(ALPHABET) % CLASSES


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, word)`` for every maximal run of letters of whole texts, A-Z lower-cased; a null text has none."""
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).alias("word"))


def vocabulary(words: DataFrame, least_length: int, least_n: int) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough; counts combine before they are shuffled."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def class_letters(word: Column, c: int) -> Column:
    """The word's letters of one class, in order: equal for equal counts."""
    others = "".join(chr(x) for x in ALPHABET if x % CLASSES != c)
    return F.array_join(F.array_sort(F.split(F.translate(word, others, ""), "")), "")


def tiles(words: DataFrame, buckets: int) -> DataFrame:
    """``(class, bucket, length, tile, words, ns)``: the blocks of ``words(word, n)``, cut into tiles of about ``TILE_LETTERS`` letters."""
    keys = F.array(*[F.struct(F.lit(c).alias("class"), F.pmod(F.xxhash64(F.lit(c), class_letters(F.col("word"), c)), F.lit(buckets)).alias("bucket")) for c in range(CLASSES)])
    rows = words.select("word", "n", F.length("word").alias("length"), F.explode(keys).alias("k")).select("word", "n", "length", "k.*")
    block = ["class", "bucket", "length"]
    sizes = rows.groupBy(*block).agg(F.ceil(F.count("*") * F.col("length") / TILE_LETTERS).alias("tiles"))
    dealt = rows.join(sizes.hint("merge"), block).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")))
    listed = dealt.groupBy(*block, "tile").agg(F.collect_list(F.struct("word", "n")).alias("w"))
    return listed.select(*block, "tile", F.col("w.word").alias("words"), F.col("w.n").alias("ns"))


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letters; all letters are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(x: np.ndarray) -> np.ndarray:
    """Rows of counts per letter of the alphabet, in a type that holds their squares exactly."""
    n, size = len(x), len(ALPHABET)
    at = (np.arange(n)[:, None] * size + COLUMN[x]).ravel()
    return np.bincount(at, minlength=n * size).reshape(n, size).astype(np.float32 if x.shape[1] < 1000 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b differ by exactly one edit; b's words are as long or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= a.shape[1]


def near_in_tiles(a: list[str], b: list[str], same: bool, own_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words of two tiles of one class that agree in it and in none before."""
    x, y = letters(a), letters(b)
    p, q = letter_counts(x), letter_counts(y)
    square = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
    i, j = np.nonzero(square <= 2)
    if same:  # a tile with itself: each pair once, no word with itself
        i, j = i[i < j], j[i < j]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    part = max(1, PART // max(len(ALPHABET), y.shape[1]))
    for at in range(0, len(i), part):
        s, t = i[at : at + part], j[at : at + part]
        edit = one_edit(x[s], y[t])
        s, t = s[edit], t[edit]
        differ = p[s] != q[t]
        agree = np.stack([~differ[:, CLASS_OF == c].any(1) for c in range(own_class + 1)], 1)
        first = agree[:, own_class] & ~agree[:, :own_class].any(1)
        found.append((s[first], t[first]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (i[:0], j[:0])


def near_pairs(words: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """``(word, n, near, near_n)``: both directions of every pair of near words of ``words(word, n)``."""
    cut = scratch.save(tiles(words, buckets))
    block = ["class", "bucket", "length"]
    other = ["tile", "words", "ns"]
    left = cut.select(*block, *other)
    renamed = [F.col(c).alias(f"{c}_b") for c in other]
    right = cut.select(*block, F.lit(True).alias("same_length"), *renamed).unionAll(cut.select("class", "bucket", F.col("length") - 1, F.lit(False), *renamed))
    pairs = left.join(right.hint("merge"), block).where(~F.col("same_length") | (F.col("tile") <= F.col("tile_b")))
    pairs = pairs.select("class", (F.col("same_length") & (F.col("tile") == F.col("tile_b"))).alias("same"), "words", "ns", "words_b", "ns_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                c, same, words_a, ns_a, words_b, ns_b = (batch.column(x)[k] for x in range(6))
                a, b, na, nb = words_a.values, words_b.values, ns_a.values, ns_b.values
                i, j = near_in_tiles(a.to_pylist(), b.to_pylist(), same.as_py(), c.as_py())
                if len(i):
                    i, j = pa.array(i), pa.array(j)
                    mine, theirs = [a.take(i), na.take(i)], [b.take(j), nb.take(j)]
                    for columns in (mine + theirs, theirs + mine):
                        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])

    return pairs.mapInArrow(compare, "word string, n long, near string, near_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: follows forms to the last one, twice as far in each round."""
    state = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.save(state.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(state)
        state = moved
        if moved.where("moved").isEmpty():
            return state.select("word", "root")


def spelling_forms(words: DataFrame, least_length: int = 6, least_n: int = 5, ratio: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every different word of ``words(..., word)``, one row per occurrence, that is long and frequent enough.

    ``form`` is the near word with the largest count, the first in code-point
    order at ties, if it occurs at least ``ratio`` times as often; else null.
    ``root`` follows forms to the last one and is the word itself where there is
    none.  Words consist of the letters of ``WORD``; null words are left out.
    Repeated rows are occurrences of their own.  An empty table gives an empty
    result.
    """
    scratch = scratch or Scratch(words.sparkSession)
    counts = scratch.save(vocabulary(words.where(F.col("word").isNotNull()).select("word"), least_length, least_n))
    buckets = max(1, -(-counts.count() // BUCKET_WORDS))
    pairs = near_pairs(counts, buckets, scratch)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = scratch.save(counts.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(judged.where("form is not null").select("word", "form"), scratch)
    return judged.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
