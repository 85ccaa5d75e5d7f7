"""Sums of sample arrays: element-wise, mergeable, without a row per sample.

Each task adds up the arrays of a key that it meets and gives one partial row
per key; partial rows are shuffled, ordered by key and added as they stream by.
What travels is keys x tasks arrays, and no task holds more than a bounded
table of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that the table of a task holds before it is given out.
MOST_HELD = 4_000_000


class Sums:
    """Sums and counts of arrays that begin at different places, of one key."""

    def __init__(self, width: int):
        self.width, self.first, self.table = width, 0, np.zeros((1 + 2 * width, 0))

    def add(self, first: int, table: np.ndarray) -> None:
        """``table``: rows, then sum and number of the values that are there, for each vector."""
        if not self.table.shape[1]:
            self.first, self.table = first, table.copy()
            return
        if not table.shape[1]:
            return
        low, high = min(first, self.first), max(first + table.shape[1], self.first + self.table.shape[1])
        if (low, high) != (self.first, self.first + self.table.shape[1]):
            wide = np.zeros((len(table), high - low))
            wide[:, self.first - low : self.first - low + self.table.shape[1]] = self.table
            self.first, self.table = low, wide
        self.table[:, first - self.first : first - self.first + table.shape[1]] += table


def _matrix(column: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten()
    return pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), n)


def vector_sums(df: DataFrame, keys: Sequence[str], vectors: Sequence[str], first: str | None = None) -> DataFrame:
    """Per key: ``first``, ``rows``, and of each vector the arrays ``<name>`` and ``<name>_n``.

    The arrays of a row are equally long and begin at ``first`` (0 without such
    a column), which may differ from row to row; a sum spans all places that
    occur.  ``rows`` counts the rows with a place, ``<name>_n`` those with a
    value there: nulls and NaN aren't added.  A null array is left out with its
    row.  Keys may be null.  An empty table gives an empty result.
    """
    keys, width = list(keys), len(vectors)
    source = df.select(*keys, (F.col(first).cast("long") if first else F.lit(0).cast("long")).alias("first"), *[F.col(v).cast("array<double>").alias(f"v{i}") for i, v in enumerate(vectors)])
    source = source.where(" and ".join(f"v{i} is not null" for i in range(width)))
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*source.select(*keys).schema.fields, T.StructField("first", T.LongType()), *[T.StructField(f"t{i}", numbers) for i in range(1 + 2 * width)]])

    def given(held: dict[tuple, Sums], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if held:
            of = list(held)
            columns = [pa.array([k[i] for k in of], t) for i, t in enumerate(types)]
            columns += [pa.array([s.first for s in held.values()], pa.int64())]
            columns += [pa.array([s.table[i] for s in held.values()], pa.list_(pa.float64())) for i in range(1 + 2 * width)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "first", *[f"t{i}" for i in range(1 + 2 * width)]])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sums] = {}
        n_held, types = 0, []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            lengths = pc.list_value_length(batch.column("v0"))
            own = pa.table({**{f"k{i}": batch.column(k) for i, k in enumerate(keys)}, "first": batch.column("first"), "n": lengths}).to_pandas()
            for group, rows in own.groupby([*own.columns], dropna=False, sort=False).indices.items():
                head = batch.slice(int(rows[0]), 1)
                key = tuple(head.column(k)[0].as_py() for k in keys)
                n = int(group[-1])
                table = np.empty((1 + 2 * width, n))
                table[0] = len(rows)
                for i in range(width):
                    x = _matrix(batch.column(f"v{i}"), rows, n)
                    there = ~np.isnan(x)
                    table[1 + 2 * i], table[2 + 2 * i] = np.where(there, x, 0.0).sum(0), there.sum(0)
                sums = held.setdefault(key, Sums(width))
                before = sums.table.size
                sums.add(int(group[-2]), table)
                n_held += sums.table.size - before
            if n_held > MOST_HELD:
                yield from given(held, types)
                held, n_held = {}, 0
        yield from given(held, types)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sums] = {}
        types = []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            columns = [batch.column(k).to_pylist() for k in keys]
            for r in range(len(batch)):
                key = tuple(c[r] for c in columns)
                if key not in held and held:  # rows are ordered: the key before is complete
                    yield from given(held, types)
                    held = {}
                table = np.stack([batch.column(f"t{i}")[r].values.to_numpy(zero_copy_only=False) for i in range(1 + 2 * width)])
                held.setdefault(key, Sums(width)).add(batch.column("first")[r].as_py(), table)
        yield from given(held, types)

    partial = source.mapInArrow(combine, schema)
    merged = partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)
    named = [F.col("t0").alias("rows")] + [c for i, v in enumerate(vectors) for c in (F.col(f"t{1 + 2 * i}").alias(v), F.col(f"t{2 + 2 * i}").alias(f"{v}_n"))]
    return merged.select(*keys, "first", *named)
