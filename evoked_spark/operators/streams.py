"""One pass over the ordered blocks of a channel, with state carried from block to block.

The blocks of a recording and channel come to one task in order and stream
through it; what it holds is bounded by the kernels or windows, not by the
recording.  One sort serves a whole chain of filters.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.windows import peak_to_peak

#: Samples that are filtered together at least.
LEAST_TOGETHER = 8192


def reflected(x: np.ndarray, n: int, at_start: bool) -> np.ndarray:
    """n samples beyond an end, by odd reflection about the end sample; zeros where the signal is too short."""
    if at_start:
        return reflected(x[::-1], n, False)[::-1]
    have = max(min(n, len(x) - 1), 0)
    return np.concatenate([2 * x[-1:] - x[-2 : -2 - have : -1], np.zeros(n - have)])


class Fir:
    """A zero-phase filter by overlap-save; true ends are padded by odd reflection."""

    def __init__(self, taps: np.ndarray):
        self.taps, self.half = np.asarray(taps, float), len(taps) // 2
        self.size = 1 << (max(LEAST_TOGETHER, 2 * len(taps)) + len(taps) - 2).bit_length()
        self.kernel = np.fft.rfft(self.taps, self.size)
        self.ready: list[np.ndarray] = []  # samples that aren't filtered yet
        self.n_ready = 0
        self.before: np.ndarray | None = None  # 2 half samples before them; None until the signal has begun
        self.last = np.zeros(0)  # of the signal, for the end

    def _filtered(self, x: np.ndarray) -> np.ndarray:
        """The fully overlapping part of x with the kernel."""
        lap, out = len(self.taps) - 1, []
        step = self.size - lap
        for at in range(0, len(x) - lap, step):
            part = x[at : at + self.size]
            y = np.fft.irfft(np.fft.rfft(part, self.size) * self.kernel, self.size)
            out.append(y[lap : len(part)])
        return np.concatenate(out) if out else x[:0]

    def _go(self) -> np.ndarray:
        x = np.concatenate([self.before, *self.ready])
        y = self._filtered(x)
        self.before, self.ready, self.n_ready = x[len(x) - 2 * self.half :], [], 0
        return y

    def push(self, x: np.ndarray) -> np.ndarray:
        """The filtered samples that are certain by now."""
        if not self.half:
            return x * self.taps[0]
        self.last = np.concatenate([self.last, x])[-self.half - 1 :]
        self.ready.append(x)
        self.n_ready += len(x)
        if self.n_ready < max(LEAST_TOGETHER, 2 * len(self.taps)):
            return x[:0]
        self._begin()
        return self._go()

    def _begin(self) -> None:
        if self.before is None:
            self.ready = [np.concatenate(self.ready)]
            first = self.ready[0][: self.half + 1]
            self.ready.insert(0, reflected(first, self.half, True))  # the first output is that of the first sample
            self.before = np.zeros(0)

    def finish(self) -> np.ndarray:
        if not self.half or not len(self.last):
            return np.zeros(0)
        self._begin()
        self.ready.append(reflected(self.last, self.half, False))
        return self._go()


class Chain:
    """Filters one after the other."""

    def __init__(self, kernels: Sequence[np.ndarray]):
        self.filters = [Fir(k) for k in kernels]

    def push(self, x: np.ndarray, since: int = 0) -> np.ndarray:
        for f in self.filters[since:]:
            x = f.push(x)
        return x

    def finish(self) -> np.ndarray:
        out = [self.push(f.finish(), i + 1) for i, f in enumerate(self.filters)]
        return np.concatenate(out) if out else np.zeros(0)


class Cutter:
    """Cuts a stream into the lengths of blocks that were put in before."""

    def __init__(self):
        self.parts: deque[np.ndarray] = deque()
        self.held = 0

    def put(self, x: np.ndarray) -> None:
        if len(x):
            self.parts.append(x)
            self.held += len(x)

    def take(self, n: int) -> np.ndarray:
        got: list[np.ndarray] = []
        while n:
            part = self.parts.popleft()
            if len(part) > n:
                self.parts.appendleft(part[n:])
                part = part[:n]
            got.append(part)
            n -= len(part)
            self.held -= len(part)
        return np.concatenate(got) if got else np.zeros(0)


def _ordered(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("recording", "channel").sortWithinPartitions("recording", "channel", "block")


def _samples(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column("values")[i].values.to_numpy(zero_copy_only=False).astype(float)


def filtered(blocks: DataFrame, chains: Mapping[str, Sequence[np.ndarray]]) -> DataFrame:
    """Adds a column per chain of filters (``values`` is replaced), in one pass and with one sort.

    Each chain begins at ``values``.  Blocks may have any lengths, of 0 too,
    and may be shorter than a kernel.
    """
    names = list(chains)
    kernels = [list(chains[c]) for c in names]
    added = [c for c in names if c != "values"]
    schema = T.StructType([*blocks.schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in added]])
    order = [f.name for f in schema.fields]
    plain = [c for c in order if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, cut, waiting = None, [], [], deque()

        def complete(ended: bool) -> Iterator[pa.RecordBatch]:
            rows, values = [], [[] for _ in names]
            if ended and state:
                for s, c in zip(state, cut):
                    c.put(s.finish())
            while waiting and all(c.held >= waiting[0][1] for c in cut):
                row, n = waiting.popleft()
                rows.append(row)
                for out, c in zip(values, cut):
                    out.append(c.take(n))
            if rows:
                table = pa.Table.from_batches(rows).combine_chunks()
                made = {c: table.column(c).combine_chunks() for c in plain} | {c: pa.array(v, pa.list_(pa.float64())) for c, v in zip(names, values)}
                yield pa.RecordBatch.from_arrays([made[c] for c in order], names=order)

        for batch in batches:
            recording, channel, meta = batch.column("recording").to_pylist(), batch.column("channel").to_pylist(), batch.select(plain)
            for i in range(len(batch)):
                if state and key != (recording[i], channel[i]):
                    yield from complete(True)
                    state = []
                if not state:
                    key, state, cut = (recording[i], channel[i]), [Chain(k) for k in kernels], [Cutter() for _ in names]
                x = _samples(batch, i)
                waiting.append((meta.slice(i, 1), len(x)))
                for s, c in zip(state, cut):
                    c.put(s.push(x))
            yield from complete(False)
        yield from complete(True)

    return _ordered(blocks).mapInArrow(run, schema)


def window_flags(blocks: DataFrame, limit: float, width_ms: float, step_ms: float) -> DataFrame:
    """``(recording, channel, i, flag)``: whether the window that begins at sample i * step of the recording spans ``limit`` volts or more.

    Windows begin at 0, step, 2 step ... of the whole signal and lie inside it;
    a signal shorter than a window is one window.  Blocks may have any lengths.
    """
    schema = "recording string, channel string, i long, flag boolean"
    samples = lambda ms, rate: max(1, round(ms * rate / 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, next_start, seen, width, step = None, np.zeros(0), 0, 0, 1, 1

        def rows(first: int, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(flags):
                n = len(flags)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(flags)], names=["recording", "channel", "i", "flag"])

        def end() -> Iterator[pa.RecordBatch]:
            if key is not None and 0 < seen < width:
                yield from rows(0, np.array([held.max() - held.min() >= limit]))

        for batch in batches:
            recording, channel, rate = (batch.column(c).to_pylist() for c in ("recording", "channel", "sfreq"))
            for i in range(len(batch)):
                if key != (recording[i], channel[i]):
                    yield from end()
                    key, held, next_start, seen = (recording[i], channel[i]), np.zeros(0), 0, 0
                    width, step = samples(width_ms, rate[i]), samples(step_ms, rate[i])
                x = _samples(batch, i)
                held = np.concatenate([held, x])  # from sample seen + len(x) - len(held) on
                seen += len(x)
                begin = seen - len(held)
                if next_start + width <= seen:
                    flags = peak_to_peak(held[next_start - begin :], width)[::step] >= limit
                    yield from rows(next_start // step, flags)
                    next_start += step * len(flags)
                held = held[max(0, min(next_start, seen) - begin) :]
        yield from end()

    return _ordered(blocks.select("recording", "channel", "sfreq", "block", "values")).mapInArrow(run, schema)
