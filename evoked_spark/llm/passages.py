"""Substring dedup with compact windows.

A token is a 5-word shingle.  For one hash function, a compact window (l, c, r)
stands for all token ranges [i, j] with l <= i <= c <= j <= r: their min-hash
is the one at c.  The windows of at least ``RUN`` tokens are the upper nodes of
the Cartesian tree over the hashes.  Windows of two functions are intersected,
so every range of RUN tokens lies in exactly one joint window, whose signature
is made of its two minima.

RUN is chosen so that nothing is missed: passages of at least ``T`` shingles
and Jaccard similarity 0.8 have at most a ninth of their shingles apart, and
each place where they come apart costs 4, so they have RUN shingles in a row in
common, and these share a signature under any number of functions.

Documents that share a signature are linked to one of them, the smallest, not
to each other: no group is listed, the minimum combines before the shuffle, and
the equi-join on signatures can be split where a passage is hot.  Linked
documents are then compared word by word around the windows; links that hold
are joined to components.

A group whose smallest document shares the signature but no passage may hold two
others that do share one.  Groups that still span several components therefore
meet again by what a pair has in common whose passages differ by single words:
50 words with one word changed, left out or put in (or 45 words as they are),
or 50 words of which two parts are swapped.  Passages that are similar in
another way, such as parts that are swapped and a word changed beside them,
have no such key; they meet by their signatures alone and stay apart where the
smallest document of these isn't similar to them.  A document sends the
hashes of its windows with one word left out, in steps of growing length;
of each only those go on that documents of other components send too.  Equal
hashes of the last step are similar passages, so there the smallest document never
fails and one round is enough, however many documents share a common line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

SHINGLE, PASSAGE_WORDS, SIMILARITY = 5, 50, 0.8
T = PASSAGE_WORDS - SHINGLE + 1
#: Shingles of two similar passages of T shingles that must hit, and how many of these are in a row at least: one place where they come apart leaves two runs.
NEED = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * T))
RUN = (NEED + 1) // 2
#: Words of a run, and of a passage of which one word is left out; how often the words between are halved.
HALF, REST, DEPTH = RUN + SHINGLE - 1, PASSAGE_WORDS - 1, 2
FUNCTIONS = 2
#: Bytes of text hashed at a time.
BLOCK = 1 << 21

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_ODD = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that are joined by NUL bytes, and the text each is in.

    A word is a run of anything but space, U+0009..U+000D and the NUL that ends a text.
    """
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13)) | (raw == 0)
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power = np.full(len(raw), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_BYTE[raw] * power)])
    back = np.full(len(raw), _INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return _mix((sums[stops] - sums[starts]) * back[starts]), np.searchsorted(np.flatnonzero(raw == 0), starts)


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of such texts, and the text each is in; a shingle that would span two texts isn't one."""
    words, owner = word_hashes(text)
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - SHINGLE + 1
    hashes = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        hashes += words[j : n + j] * _ODD[j]
    whole = owner[:n] == owner[SHINGLE - 1 :]
    return _mix(hashes)[whole], owner[:n][whole]


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = pick(out[:-step], out[step:]), have + step
    return out


def compact_windows(h: np.ndarray, first: np.ndarray, last: np.ndarray, t: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``t`` values; texts are the ranges first[i]..last[i] of each position i.

    Only a value that is the minimum of some t values in a row can be the
    centre of such a window, and so can only such a value bound one; the stack
    that builds the Cartesian tree runs over those, a few per cent of all.
    """
    if len(h) < t:
        return (np.zeros(0, np.int64),) * 3
    low = _slide(h, t, np.minimum)
    low[last[: len(low)] - np.arange(len(low)) < t - 1] = 0  # would cross into the next text
    padded = np.concatenate([np.zeros(t - 1, np.uint64), low, np.zeros(t - 1, np.uint64)])
    c = np.flatnonzero((_slide(padded, t, np.maximum) == h) & (h > 0))
    value, begin, end = h[c].tolist(), first[c].tolist(), last[c].tolist()
    place = c.tolist()
    left, right, stack = [0] * len(place), [0] * len(place), []
    for i, v in enumerate(value):
        while stack and (begin[stack[-1]] != begin[i] or value[stack[-1]] > v):
            j = stack.pop()
            right[j] = place[i] - 1 if begin[j] == begin[i] else end[j]
        left[i] = place[stack[-1]] + 1 if stack else begin[i]
        stack.append(i)
    for j in stack:
        right[j] = end[j]
    l, r = np.array(left, np.int64), np.array(right, np.int64)
    wide = r - l + 1 >= t
    return l[wide], c[wide], r[wide]


def joint_windows(h: np.ndarray, owner: np.ndarray, t: int = RUN, functions: int = FUNCTIONS) -> tuple[np.ndarray, ...]:
    """Signature, text, and the shingle range, within the text, of every joint window: all its ranges of ``t`` shingles have the same minima."""
    if not len(h):
        return (np.zeros(0, np.int64),) * 4
    change = np.flatnonzero(np.diff(owner)) + 1
    begin, end = np.concatenate([[0], change]), np.concatenate([change, [len(h)]]) - 1
    first, last = np.repeat(begin, end - begin + 1), np.repeat(end, end - begin + 1)
    signature = start = stop = least = most = None
    for k in range(functions):
        own = _mix(h * _ODD[8 + k]) | np.uint64(1)
        lk, ck, rk = compact_windows(own, first, last, t)
        if k == 0:
            signature, start, stop, least, most = own[ck], lk, rk, ck, ck
            continue
        # both kinds of windows come ordered by their centres; a joint one has both centres within t
        lo, hi = np.searchsorted(ck, np.maximum(start, most - t + 1), "left"), np.searchsorted(ck, np.minimum(stop, least + t - 1), "right")
        n = np.maximum(hi - lo, 0)
        i = np.repeat(np.arange(len(start)), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        start, stop, least, most = np.maximum(start[i], lk[j]), np.minimum(stop[i], rk[j]), np.minimum(least[i], ck[j]), np.maximum(most[i], ck[j])
        fits = (start <= least) & (most <= stop) & (stop - start + 1 >= t) & (most - least < t)
        signature = _mix(signature[i] * _ODD[6] + own[ck[j]] * _ODD[7])[fits]
        start, stop, least, most = start[fits], stop[fits], least[fits], most[fits]
    return signature.view(np.int64), owner[least], np.maximum(start, most - t + 1) - first[least], np.minimum(stop, least + t - 1) - first[least]


def window_rows(texts: DataFrame) -> DataFrame:
    """``(key, row, lo, hi)`` of every joint window of ``texts(row, body)``; the key is its signature."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at = batch["row"].to_numpy(), 0
            bodies = [b.replace(b"\0", b" \x01 ") for b in batch["body"]]
            while at < len(bodies):
                upto, size = at, 0
                while upto < len(bodies) and (size == 0 or size + len(bodies[upto]) <= BLOCK):
                    size += len(bodies[upto]) + 1
                    upto += 1
                signature, owner, lo, hi = joint_windows(*shingles(b"\0".join(bodies[at:upto])))
                yield pd.DataFrame({"key": signature, "row": rows[at + owner], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})
                at = upto

    return texts.mapInPandas(make, "key long, row long, lo int, hi int")


def _occurrences(part: np.ndarray, spots: np.ndarray, y: np.ndarray, at_y: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (p, q) with part[p] = y[q], p in spots and q in at_y, in ranges of diagonals of about ``most`` pairs at a time."""
    ids = np.unique(y[at_y], return_inverse=True)
    keys = ids[1].astype(np.int64) * len(y) + at_y
    keys.sort()
    base = np.searchsorted(ids[0], part[spots]).astype(np.int64) * len(y)
    total = int((np.searchsorted(keys, base + len(y)) - np.searchsorted(keys, base)).sum())
    first, last = int(at_y[0] - spots[-1]), int(at_y[-1] - spots[0])
    step = last - first + 1 if total <= most else max(1, most // len(spots))
    for low in range(first, last + 1, step):
        start = np.searchsorted(keys, base + np.clip(spots + low, 0, len(y)))
        n = np.searchsorted(keys, base + np.clip(spots + min(low + step, last + 1), 0, len(y))) - start
        place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.repeat(spots, n), keys[place] % len(y)


def _segments(p: np.ndarray, q: np.ndarray, band: np.ndarray, t: int, need: int, holds, split: bool) -> Iterator[tuple[int, int, int, int]]:
    """Segments of pairs of one band of diagonals that hold; with ``split``, one that doesn't is cut at its widest gap, down to single windows."""
    order = np.lexsort((q, p, band))
    p, q, band = p[order], q[order], band[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(band)) + 1, [len(p)]])
    for at, upto in zip(edges[:-1], edges[1:]):
        if upto - at < need:
            continue
        u, v = p[at:upto], q[at:upto]
        own = np.unique(u)
        good = np.flatnonzero(np.searchsorted(own, own + t) - np.arange(len(own)) >= need)
        todo = [good[i] for i in np.split(np.arange(len(good)), np.flatnonzero(np.diff(own[good]) > t) + 1)] if len(good) else []
        while todo:
            run = todo.pop()
            i, j = own[run[0]], own[np.searchsorted(own, own[run[-1]] + t) - 1]
            there = v[np.searchsorted(u, i) : np.searchsorted(u, j, "right")]
            segment = int(i), int(j), int(there.min()), int(there.max())
            if holds(*segment):
                yield segment
            elif split and len(run) > 1:
                gaps = np.diff(own[run])
                cut = len(run) // 2 if gaps.max() == gaps.min() else int(gaps.argmax()) + 1
                todo += [run[:cut], run[cut:]]


def ranges(lo: np.ndarray, hi: np.ndarray, around: int, size: int) -> list[tuple[int, int]]:
    """The spans lo..hi, widened on both sides, within 0..size-1; those that touch are one."""
    if not len(lo) or size <= 0:
        return []
    order = np.argsort(lo, kind="stable")
    lo, reach = np.maximum(lo[order] - around, 0), np.maximum.accumulate(np.minimum(hi[order] + around, size - 1))
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1] + 1]))
    return list(zip(lo[first].tolist(), reach[np.append(first[1:] - 1, len(lo) - 1)].tolist()))


def packed(lo: Column, hi: Column) -> Column:
    return F.call_function("shiftleft", lo.cast("long"), F.lit(32)) + hi


def unpacked(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spans = np.asarray(spans, np.int64)
    return spans >> 32, spans & 0xFFFFFFFF


def novel(x: np.ndarray, spans: list[tuple[int, int]], t: int = T) -> list[tuple[int, int]]:
    """The parts of disjoint, ordered spans of x that are in the first of equal ranges of t values.

    A text that repeats itself is compared once, not once per repeat.
    """
    keys = stretches(x, t)
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(lo, hi - t + 2) for lo, hi in spans if hi - lo + 1 >= t]])
    if not len(starts):
        return []
    _, first = np.unique(keys[starts], return_index=True)
    if len(first) == len(starts):
        return [(lo, hi) for lo, hi in spans if hi - lo + 1 >= t]
    kept = np.sort(starts[first])
    return ranges(kept, kept + t - 1, 0, len(x))


def sorted_spots(y: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the spans, the order of the values there, and the values in that order."""
    at = np.concatenate([np.zeros(0, np.int64), *[np.arange(lo, hi + 1) for lo, hi in spans]])
    order = np.argsort(y[at], kind="stable")
    return at, order, y[at][order]


def shared_passages(parts: list[tuple[int, np.ndarray]], y: np.ndarray, y_spans: list[tuple[int, int]] | None, t: int = T, similarity: float = SIMILARITY, spots: tuple[np.ndarray, ...] | None = None) -> list[tuple[int, int, int, int]]:
    """Passages (start, stop, start in y, stop in y), in shingles, of at least t shingles and that Jaccard similarity.

    ``parts`` holds (offset, shingle hashes) of ranges of one text, y the hashes
    of another, of which only the given disjoint, ordered ranges are compared.
    ``spots`` gives what :func:`sorted_spots` makes of these, where it is known.  Where hits of a
    part stand once in y, all near one diagonal, the whole run is tested, and else
    against all places in y that it hits, where these are about as long.
    Otherwise every occurrence in y counts, and the pairs are split by diagonals:
    in bands from wide, for passages with words put in or left out, to single
    diagonals, where each window with enough hits holds.
    """
    at_y, order, sorted_y = spots or sorted_spots(y, y_spans)
    need = int(np.ceil(2 * similarity / (1 + similarity) * t))
    found = []
    for lo, part in parts:
        if len(part) < t or not len(sorted_y):
            continue
        where = np.minimum(np.searchsorted(sorted_y, part), len(sorted_y) - 1)
        hit = sorted_y[where] == part
        sums = np.concatenate([[0], np.cumsum(hit)])
        good = np.flatnonzero(sums[t:] - sums[:-t] >= need)
        if not len(good):
            continue

        def holds(i: int, j: int, a: int, b: int, part=part) -> bool:
            if j - i + 1 < need or b - a + 1 < need:
                return False
            mine, theirs = np.unique(part[i : j + 1]), np.unique(y[a : b + 1])
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            return both >= similarity * (len(mine) + len(theirs) - both)

        for run in np.split(good, np.flatnonzero(np.diff(good) > t) + 1):
            spots = run[0] + np.flatnonzero(hit[run[0] : run[-1] + t])
            match = at_y[order[where[spots]]]
            shifts = match - spots
            length = int(spots[-1] - spots[0]) + 1
            after = np.minimum(where[spots] + 1, len(sorted_y) - 1)
            once = not ((sorted_y[after] == part[spots]) & (after > where[spots])).any()
            if once and np.ptp(shifts) <= max(t // 4, length // 8):
                whole = int(spots[0]), int(spots[-1]), int(match.min()), int(match.max())
                if holds(*whole):
                    found.append((lo + whole[0], lo + whole[1], whole[2], whole[3]))
                    continue
            wanted = at_y[np.isin(y[at_y], part[spots])]
            every = int(spots[0]), int(spots[-1]), int(wanted[0]), int(wanted[-1])
            if abs(length - (every[3] - every[2] + 1)) <= max(t // 4, length // 8) and holds(*every):
                found.append((lo + every[0], lo + every[1], every[2], every[3]))
                continue  # whatever else holds lies inside
            mine, theirs = np.zeros(len(part), bool), np.zeros(len(y), bool)
            for p, q in _occurrences(part, spots, y, wanted):
                widths = [1, t // 4]
                while 2 * widths[-1] <= length // 4:
                    widths.append(2 * widths[-1])
                kept: list[tuple[int, int, int, int]] = []
                for w, shift in [(w, shift) for w in reversed(widths) for shift in ((0, w) if w > 1 else (0,))]:
                    band = (q - p + shift) // (2 * w) if w > 1 else q - p
                    outside = np.ones(len(p), bool)
                    for i, j, a, b in kept:
                        outside &= (p < i) | (p > j) | (q < a) | (q > b)
                    live = np.isin(band, band[outside])  # another band's segments would lie inside those kept
                    held = [*kept, *_segments(p[live], q[live], band[live], t, need, holds, w <= t // 4)]
                    kept = []
                    for i, j, a, b in sorted(set(held), key=lambda s: (s[0] - s[1], s[2] - s[3], s)):
                        if not any(k[0] <= i and j <= k[1] and k[2] <= a and b <= k[3] for k in kept):
                            kept.append((i, j, a, b))
                for i, j, a, b in kept:
                    found.append((lo + i, lo + j, a, b))
                    mine[i : j + 1] = theirs[a : b + 1] = True
                if mine[spots].all() and theirs[wanted].all():
                    break  # further diagonals of a text that repeats itself add no place
    return found


def stretches(x: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` shingles in a row."""
    if len(x) < width:
        return np.zeros(0, np.uint64)
    power, back = _powers(len(x))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(x * power)])
    return _mix((sums[width:] - sums[:-width]) * back[: len(x) - width + 1] + np.uint64(width))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, back = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    power[:1] = back[:1] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(back)


class Sums:
    """Running sums of word hashes, which give the hash of any stretch of words."""

    def __init__(self, words: np.ndarray):
        power, self.back = _powers(len(words))
        self.n, self.sums = len(words), np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * power)])

    def stretch(self, starts: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[starts + width] - self.sums[starts]) * self.back[starts]


def interval_keys(words: Sums, starts: np.ndarray, kinds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, kind) of passages of REST words from each start but for an interval, in which what is apart may be.

    The words behind the run are halved ``depth`` times; kind k is the k-th part
    of them, and those of a start's kind of one depth less are taken.  What
    stands behind the interval may be up to two words further off.
    """
    width, out = (REST - HALF) >> depth, []
    for kind in range(1 << depth):
        low = HALF + kind * width
        high, own = low + width, starts[kinds == kind >> 1]
        for off in range(3 if high < REST else 1):
            i = own[own + (REST + off if high < REST else low) <= words.n]
            behind = words.stretch(i + high + off, REST - high) * _ODD[7] if high < REST else np.uint64(0)
            out.append((words.stretch(i, low) * _ODD[6] + behind + np.uint64(kind), i, np.full(len(i), kind)))
    keys, at, kind = (np.concatenate(x) for x in zip(*out))
    return _mix(keys), at, kind


def passage_keys(words: Sums, starts: np.ndarray, kinds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of similar passages from each start: equal keys are 45 equal words, or REST with one or two words left out of either."""
    out = []
    for size in (NEED + SHINGLE - 1, REST):
        i = np.unique(starts[starts + size <= words.n])
        out.append((words.stretch(i, size) + np.uint64(size), i))
    width = (REST - HALF) >> depth
    for gone in (1, 2):
        fits = starts + REST + gone <= words.n
        i, first = starts[fits][:, None], HALF + kinds[fits] * width
        j = i + first[:, None] + np.arange(width + 1)  # words j .. j + gone - 1 are left out
        before = (words.sums[j] - words.sums[i]) * words.back[i]
        rest = (words.sums[i + REST + gone] - words.sums[j + gone]) * words.back[i + gone]
        out.append(((before + rest + np.uint64(REST)).ravel(), np.repeat(starts[fits], width + 1)))
    keys, at = (np.concatenate(x) for x in zip(*out))
    return _mix(keys), at


def rotation_keys(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of the windows of PASSAGE_WORDS that hold a run from one of ``starts``; equal for windows that are each other with two parts swapped.

    The key is the sum of the hashes of all shingles of the window read as a
    circle, so it doesn't depend on where the circle is cut.
    """
    n, size = len(words), PASSAGE_WORDS
    if n < size or not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h += words[j : n - SHINGLE + 1 + j] * _ODD[j]
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_mix(h))])
    i = np.unique(starts[:, None] - np.arange(size - HALF + 1))
    i = i[(i >= 0) & (i + size <= n)]
    key = sums[i + size - SHINGLE + 1] - sums[i]
    for over in range(1, SHINGLE):  # shingles over the cut
        turn = np.zeros(len(i), np.uint64)
        for j in range(SHINGLE):
            turn += words[i + (size - SHINGLE + over + j) % size] * _ODD[j]
        key += _mix(turn)
    return _mix(key), i


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Verified links ``(row, id, other_row, other_id, start, stop, other_start, other_stop)``, positions in words, stop exclusive.

    ``row`` stands for an id: the id itself where it is a whole number, else
    its hash.  Rows that share an id are one document, repeated rows count once,
    and rows with a null id aren't compared.  Each document with a repeated
    passage is linked to the smallest that shares a signature with it; copies
    are not expanded into all pairs.  Of ranges of 50 words that a text repeats
    the first is compared.  Null texts and texts under 50 words have no
    passage.  An empty table gives no link.
    """
    links, more, _ = _links(docs, id_col, text_col, scratch or Scratch(docs.sparkSession))
    return links.unionAll(more)


def _links(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links by signatures, those of undecided groups, and the components ``(node, root)`` of the first."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(node_of(docs, id_col).alias("row"), F.col(f"`{id_col}`").alias("id"), body.cast("binary").alias("body")).where("id is not null")
    kind = dict(texts.dtypes)["id"]
    link = f"row long, id {kind}, other_row long, other_id {kind}, start int, stop int, other_start int, other_stop int"
    clean = lambda b: b.replace(b"\0", b" \x01 ")

    def starred(members: DataFrame, hubs: DataFrame) -> DataFrame:
        """``(row, other_row, spans, other_spans)``: each row of ``members(key, row, lo, hi)`` with the hub of its key."""
        chosen = members.join(hubs.withColumnRenamed("hub", "row").hint("merge"), ["key", "row"]).groupBy("key").agg(F.min("lo").alias("other_lo"), F.max("hi").alias("other_hi"))
        chosen = scratch.save(hubs.join(chosen.hint("merge"), "key"))
        linked = members.join(chosen.hint("merge"), "key").where("row <> hub")
        spans = [F.collect_set(packed(F.col(f"{c}lo"), F.col(f"{c}hi"))).alias(f"{c}spans") for c in ("", "other_")]  # at most the windows of one document
        pairs = scratch.save(linked.groupBy("row", F.col("hub").alias("other_row")).agg(*spans))
        scratch.drop(chosen)
        return pairs

    def hubs_of(rows: DataFrame) -> DataFrame:
        """``(key, hub)`` of the keys with several rows; one order for all keys, so that copies are compared with one document each."""
        hubs = rows.groupBy("key").agg(F.min("row").alias("hub"), F.max("row").alias("last"))
        return hubs.where("hub < last").select("key", "hub")

    def own_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            los, sizes, hashes = [], [], []
            for text, spans in zip(batch["body"], batch["spans"]):
                x = shingles(clean(text))[0]
                parts = novel(x, ranges(*unpacked(spans), T - RUN, len(x)))
                los.append(np.array([lo for lo, _ in parts], np.int64))
                sizes.append(np.array([hi + 1 - lo for lo, hi in parts], np.int64))
                hashes.append(np.concatenate([np.zeros(0, np.int64), *[x[lo : hi + 1].view(np.int64) for lo, hi in parts]]))
            yield batch[["row", "id", "other_row", "other_spans"]].assign(los=los, sizes=sizes, hashes=hashes)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, text, y, spans, spots = None, None, None, None, None  # rows come ordered by the other document
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if known != r.other_row or text != r.body:
                    known, text, y, spans = r.other_row, r.body, shingles(clean(r.body))[0], None
                parts = list(zip(r.los.tolist(), np.split(r.hashes.view(np.uint64), np.cumsum(r.sizes)[:-1])))
                there = ranges(*unpacked(r.other_spans), T - RUN, len(y))
                if there != spans:  # copies share the same parts with it
                    spans, spots = there, sorted_spots(y, novel(y, there))
                out += [(r.row, r.id, r.other_row, r.other_id, i, j + SHINGLE, a, b + SHINGLE) for i, j, a, b in shared_passages(parts, y, None, spots=spots)]
            yield pd.DataFrame(out, columns=["row", "id", "other_row", "other_id", "start", "stop", "other_start", "other_stop"])

    def verified(pairs: DataFrame) -> DataFrame:
        """What holds of the links; only the parts of a text that may be repeated travel to the other one."""
        mine = texts.join(pairs.hint("merge"), "row").select("row", "id", "other_row", "spans", "other_spans", "body")
        mine = mine.mapInPandas(own_parts, f"row long, id {kind}, other_row long, other_spans array<long>, los array<long>, sizes array<long>, hashes array<long>")
        other = texts.select(F.col("row").alias("other_row"), F.col("id").alias("other_id"), "body")
        both = mine.where(F.size("los") > 0).join(other.hint("merge"), "other_row").select("row", "id", "other_row", "other_id", "other_spans", "los", "sizes", "hashes", "body")
        links = scratch.save(both.mapInPandas(verify, link).distinct())
        scratch.drop(pairs)
        return links

    rows = scratch.save(window_rows(texts.select("row", "body")))
    hubs = scratch.save(hubs_of(rows))
    members = scratch.save(rows.join(hubs.hint("merge"), "key", "left_semi"))
    scratch.drop(rows)
    links = verified(starred(members, hubs))
    scratch.drop(hubs)

    # groups of three and more that aren't one component yet
    roots = scratch.save(components_of(links, scratch))
    once = members.groupBy("key", "row").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rooted = scratch.save(once.join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row")))
    scratch.drop(members)
    unlike = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("n > 2 and a < b").select("key")
    undecided = rooted.join(unlike.hint("merge"), "key", "left_semi").groupBy("row", "root").agg(F.collect_set(packed(F.col("lo"), F.col("hi"))).alias("spans"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                words, x = word_hashes(clean(r.body))[0], shingles(clean(r.body))[0]
                lo, hi = unpacked(r.spans)
                own = np.zeros(len(x), bool)
                for i, j in ranges(lo, hi - RUN + 1, 0, len(x)):
                    own[i : j + 1] = True  # where a run with the signature may start
                for i, j in novel(x, ranges(lo, hi, T - RUN, len(x)), NEED):
                    out.append((r.row, r.root, i, words[i : j + SHINGLE].view(np.int64), np.flatnonzero(own[i : j - RUN + 2]) << 3))
            yield pd.DataFrame(out, columns=["row", "root", "at", "words", "alive"])

    around = texts.join(undecided.hint("merge"), "row").select("row", "root", "spans", "body")
    around = around.mapInPandas(contexts, "row long, root long, at int, words array<long>, alive array<long>")
    around = scratch.save(around.withColumn("part", F.monotonically_increasing_id()))
    scratch.drop(rooted)
    sends, places = "key long, root long, part long, mark long", "key long, root long, row long, lo int, hi int"
    table = lambda out, schema: pd.DataFrame({c.split()[0]: np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k, c in enumerate(schema.split(", "))})

    def placed(r, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys of passages with the document and the shingles they may reach over."""
        lo = r.at + at
        return keys, np.full(len(keys), r.root), np.full(len(keys), r.row), lo, np.minimum(lo + PASSAGE_WORDS + 1, r.at + len(r.words) - SHINGLE)

    def steps(depth: int):
        """Sends the keys of one depth; passages are read forwards and backwards, so that what is apart is in their second half."""

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    words, n = r.words.view(np.uint64), len(r.words)
                    both = [Sums(words), Sums(words[::-1])] if depth else [Sums(words)]
                    starts, way, kinds = r.alive >> 3, (r.alive >> 2) & 1, r.alive & 3
                    for backwards in (0, 1) if depth else (0,):
                        here, own = way == backwards, both[backwards]
                        if depth <= DEPTH:
                            keys, at, kind = interval_keys(own, starts[here], kinds[here], depth)
                            marks = (at << 3) | (backwards << 2) | kind
                            if not depth:  # a run is the same both ways
                                keys, marks = np.tile(keys, 2), np.concatenate([marks, ((n - HALF - at) << 3) | 4])
                        else:
                            keys, at = passage_keys(own, starts[here], kinds[here], DEPTH)
                            marks = np.maximum(n - at - PASSAGE_WORDS - 1, 0) if backwards else at
                        keys = _mix(keys + np.uint64(backwards)).view(np.int64)
                        out.append((keys, np.full(len(keys), r.root), np.full(len(keys), r.part), marks) if depth <= DEPTH else placed(r, keys, marks))
                yield table(out, sends if depth <= DEPTH else places)

        return step

    def rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                forwards = r.alive[(r.alive >> 2) & 1 == 0] >> 3
                keys, at = rotation_keys(r.words.view(np.uint64), forwards)
                out.append(placed(r, keys.view(np.int64), at))
            yield table(out, places)

    def elsewhere(sent: DataFrame) -> DataFrame:
        """Those of which documents of other components send the key too."""
        several = sent.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
        return sent.join(several.hint("merge"), "key", "left_semi")

    met = around
    for depth in range(DEPTH + 2):
        met = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")  # few bytes, much work
        if depth == 1:  # a run that others have may be one of two parts that are swapped
            turned = scratch.save(met.mapInPandas(rotations, places))
        sent = scratch.save(met.mapInPandas(steps(depth), sends if depth <= DEPTH else places))
        met = elsewhere(sent)
        if depth <= DEPTH:
            marks = met.groupBy("part").agg(F.collect_set("mark").alias("alive"))  # at most the places of one part of a text
            met = scratch.save(around.drop("alive").join(marks.hint("merge"), "part"))
        else:
            met = scratch.save(met.distinct().unionAll(elsewhere(turned).distinct()))
            scratch.drop(turned)
        scratch.drop(sent)
    hubs = scratch.save(hubs_of(met))
    own = met.join(hubs.hint("merge"), "key")
    hub_root = scratch.save(own.where("row = hub").groupBy("key").agg(F.min("root").alias("hub_root")))
    apart = own.join(hub_root.hint("merge"), "key").where("row = hub or root <> hub_root").select("key", "row", "lo", "hi")
    pairs = starred(apart, hubs)
    scratch.drop(around, met, hubs, hub_root)
    return links, verified(pairs), roots


def node_of(docs: DataFrame, id_col: str) -> Column:
    own = F.col(f"`{id_col}`")
    return own.cast("long") if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(own)


def components_of(links: DataFrame, scratch: Scratch) -> DataFrame:
    return connected_components(links.select(F.col("row").alias("u"), F.col("other_row").alias("v")), scratch)


def joined_components(roots: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``(node, root)`` after ``more(row, other_row)`` has joined some of ``roots(node, root)``: found among roots alone."""
    new = more.select(F.explode(F.array("row", "other_row")).alias("node")).distinct().join(roots.hint("merge"), "node", "left_anti")
    known = scratch.save(roots.unionAll(new.select("node", F.col("node").alias("root"))))
    ends = more.select("row", "other_row").distinct()
    for end, name in (("row", "u"), ("other_row", "v")):
        ends = ends.join(known.select(F.col("node").alias(end), F.col("root").alias(name)).hint("merge"), end)
    above = connected_components(ends.select("u", "v"), scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return known.join(above.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``component_id``, ``star_links``, ``n_passages``, ``first_word``, ``last_word``, ``longest``.

    component_id is the smallest row (see :func:`repeated_passages`) that is
    linked to it through any chain, itself included: for whole numbers the
    smallest id; null for a null id.  star_links counts the documents it was
    verified against, not all it shares a passage with.  Without a repeated
    passage the counts are 0 and the positions null.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    first, more, roots = _links(docs, id_col, text_col, scratch)
    links = first.unionAll(more)
    ends = links.select("row", "other_row", "start", "stop").unionAll(links.select("other_row", "row", "other_start", "other_stop"))
    per_link = ends.groupBy("row", "other_row").agg(F.count("*").alias("passages"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.col("stop") - F.col("start")).alias("longest"))
    rows = scratch.save(per_link.groupBy("row").agg(F.count("*").alias("star_links"), F.sum("passages").alias("n_passages"), F.min("start").alias("first_word"), F.max("stop").alias("last_word"), F.max("longest").alias("longest")))
    roots = scratch.save(joined_components(roots, more, scratch))
    rows = scratch.save(rows.join(roots.withColumnRenamed("node", "row").hint("merge"), "row"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.when(F.col(f"`{id_col}`").isNotNull(), node_of(docs, id_col)).alias("row"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("star_links", "n_passages")]
    return own.join(rows.hint("merge"), "row", "left").select("id", F.coalesce("root", "row").alias("component_id"), *counts, "first_word", "last_word", F.coalesce("longest", F.lit(0)).alias("longest"))
