"""Periodic runs of words by multi-scale minimizers.

A run is a maximal stretch of words with smallest period q that is at least
``LEAST`` words and three periods long.

Periods below ``2 * FIRST`` are found by direct lag scans: a run of lag p has
at least L = max(24, 3p) - p places in a row where a word equals the one p
later, so looking at every L-th place meets each run.

A scale k = FIRST, 2 FIRST, 4 FIRST ... covers the periods from 2k up to 4k.
Its minimizers are the smallest hashes of k words in windows of k such starts.
In a run of period p, windows p apart have the same words, so their minimizers
are equal and p apart; the windows that have a partner start at p + 2 places
or more, all residues of the period.  Every pair of equal minimizers from 2k up
to 4k apart is a seed, which is extended both ways word by word.  Groups of k
words inside a run of a period up to k / 3, found before, are no minimizers:
a period of p words can't consist of them alone, and any other group occurs at
most twelve times in 4k words, so seeds are as many as minimizers but for a
constant.

A text is one row; texts are worked on independently, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, TIMES = 24, 3
#: Words of the smallest minimizer; characters of texts worked on together (one text may have more).
FIRST, TOGETHER = 32, 4_000_000
WORD = re.compile("[^\x20\x09-\x0d]+")
NONE = np.uint64(2**64 - 1)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())]))


def sliding(a: np.ndarray, k: int, of: np.ufunc) -> np.ndarray:
    """of(a[i : i + k]) for every i, by running values inside blocks of k."""
    n = len(a) - k + 1
    if n <= 0:
        return a[:0]
    blocks = np.concatenate([a, np.repeat(a[-1:], -len(a) % k)]).reshape(-1, k)
    ahead = of.accumulate(blocks, axis=1).ravel()
    behind = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(behind[:n], ahead[k - 1 : k - 1 + n])


def doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from those of k words."""
    x = (h[:-k] ^ (h[:-k] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.minimum(x ^ (x >> np.uint64(32)), NONE - np.uint64(1))


def extended(w: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The longest [a, b) around x with w[i] == w[i + p]; x itself may be no such place."""
    ends = []
    for step in (1, -1):
        at, size = x, 64
        while True:
            lo, hi = (at, min(at + size, len(w) - p)) if step > 0 else (max(at - size, 0), at)
            if lo >= hi:
                break
            same = w[lo:hi] == w[lo + p : hi + p]
            same = same if step > 0 else same[::-1]
            good = int(same.argmin()) if not same.all() else hi - lo
            at += step * good
            if good < hi - lo:
                break
            size *= 2
        ends.append(at)
    return ends[1], ends[0]


def _likely(w: np.ndarray, x: np.ndarray, p: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether samples of the ``half`` places before or after x agree with a lag of p: true wherever all of either do."""
    last, either = len(w) - 1, np.zeros(len(x), bool)
    for sign in (1, -1):
        left = np.flatnonzero(~either)
        for part in (8, 4, 2, 1):
            at = x[left] + sign * (half[left] // part)
            left = left[w[np.clip(at, 0, last)] == w[np.clip(at + p[left], 0, last)]]
        either[left] = True
    return either


def _grow(w: np.ndarray, seeds: np.ndarray, lags: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Extends seeds, given by lag and then by place, to runs: (start, length) -> smallest period."""
    need = np.maximum(LEAST, TIMES * lags) - lags
    keep = _likely(w, seeds, lags, (need - 1) // 2)
    lag, end = 0, 0
    for x, p in zip(seeds[keep].tolist(), lags[keep].tolist()):
        if p == lag and x < end:
            continue
        a, b = extended(w, x, p)
        lag, end = p, b
        if b - a + p >= max(LEAST, TIMES * p):
            key = (a, b - a + p)
            found[key] = min(p, found.get(key, p))


def find_runs(texts: list[np.ndarray], short: int = 2 * FIRST) -> list[list[tuple[int, int, int]]]:
    """(start, period, length) of the runs of each text, in this order; words are numbers from 0 on.

    ``short`` is twice the words of the smallest minimizer, which must be at least LEAST.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ends = -1 - np.arange(len(texts))  # after each text a word of its own
    w = np.concatenate([np.append(t, e) for t, e in zip(texts, ends)]) if texts else np.zeros(0, np.int64)
    found: dict[tuple[int, int], int] = {}
    longest = int(sizes.max(initial=0))
    for p in range(1, min(short, longest // TIMES + 1)):
        step = max(LEAST, TIMES * p) - p
        x = np.arange(step - 1, len(w) - p, step)
        x = x[w[x] == w[x + p]]
        _grow(w, x, np.full(len(x), p), found)

    k, own, place = 1, np.arange(len(texts)), np.arange(len(w))
    h = ((w + len(texts) + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)
    while 6 * max(k, short // 2) <= longest:
        live = sizes[own] >= 6 * max(k, short // 2)  # only these have room for three periods
        if not live.all():
            stays = np.repeat(live, sizes[own] + 1)
            h, place, own = h[stays], place[stays], own[live]
        if k >= short // 2:
            _scale(w, h, place, k, found)
        h = np.concatenate([doubled(h, k), np.full(min(k, len(h)), NONE)])
        k *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, length), p in found.items():
        i = int(np.searchsorted(begin, a, side="right")) - 1
        out[i].append((a - int(begin[i]), p, length))
    return [sorted(runs) for runs in out]


def _scale(w: np.ndarray, h: np.ndarray, place: np.ndarray, k: int, found: dict[tuple[int, int], int]) -> None:
    """Runs with a period from 2k up to 4k; h are hashes of k words, ``place`` says where in w each begins."""
    cover = np.zeros(len(w) + 1, np.int32)
    for (a, length), p in found.items():
        if 3 * p <= k <= length:
            cover[a] += 1
            cover[a + length - k + 1] -= 1
    h = np.where(np.cumsum(cover)[place] > 0, NONE, h)
    low = sliding(h, k, np.minimum)
    if not len(low):
        return
    edge = np.zeros(k - 1, np.uint64)
    chosen = np.flatnonzero((sliding(np.concatenate([edge, low, edge]), k, np.maximum) == h) & (h != NONE))
    order = chosen[np.argsort(h[chosen], kind="stable")]
    hs, at = h[order], place[order]
    seeds, lags, j = [], [], 1
    while j < len(hs):
        lag = at[j:] - at[:-j]
        near = (hs[j:] == hs[:-j]) & (lag < 4 * k)
        if not near.any():
            break
        good = near & (lag >= 2 * k)
        seeds.append(at[:-j][good])
        lags.append(lag[good])
        j += 1
    if seeds:
        x, p = np.concatenate(seeds), np.concatenate(lags)
        order = np.lexsort((x, p))
        _grow(w, x[order], p[order], found)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that follow the first period of a run that contains them."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, period, length in runs:
        keep[start + period : start + length] = False
    return " ".join(compress(words, keep.tolist()))


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``rec`` (the columns ``carry``, or all), ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are (start, period, length), counted in words, by start and then
    period; ``collapsed`` has the text's words joined by one space, without the
    repetitions of runs.  A null or empty text has no words and no runs.  Rows
    that are repeated are each returned; an empty table gives an empty result.
    """
    rec = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(rec.alias("rec"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, at = 0, 0
            sizes = [len(t) for t in batch.column("text").to_pylist()]
            for i, n in enumerate([*sizes, TOGETHER + 1]):
                if i > at and total + n > TOGETHER:
                    yield _found(batch.slice(at, i - at))
                    total, at = 0, i
                total += n

    schema = rows.select("rec").schema.add("n_words", "long").add("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "period", "length")]))).add("collapsed", "string")
    return rows.mapInArrow(find, schema)


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids: dict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    words = [WORD.findall(t) for t in batch.column("text").to_pylist()]
    numbers = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64)
    runs = find_runs(np.split(numbers, np.cumsum([len(x) for x in words])[:-1]))
    named = [[{"start": s, "period": p, "length": n} for s, p, n in own] for own in runs]
    columns = [batch.column("rec"), pa.array([len(x) for x in words], pa.int64()), pa.array(named, RUNS), pa.array(list(map(collapsed, words, runs)), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["rec", "n_words", "runs", "collapsed"])
