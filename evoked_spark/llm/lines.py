"""Line dedup by a sharded minimal perfect hash.

Lines are known by two 64-bit hashes of their key.  A count of documents per
hash, combined before it is shuffled, gives the lines that many documents hold.
These are dealt to shards; each shard becomes a minimal perfect hash (bit
arrays by levels, about 4 bits a line) over compact arrays: the second hash as
fingerprint, the documents that hold the line, and the one that keeps it.

Documents send hashes and line numbers, not lines, to the shards.  A task reads
its rows ordered by shard with the shard's arrays first, so it holds one shard
at a time, and answers only with the lines that are found.  Lines that exceed
the share of one task are fewer than there are tasks: their arrays are sent to
all tasks and answer where the documents are, so no shard is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch

BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of a shard, on average: a shard's arrays take a few MB.
SHARD_LINES = 65_536
GAMMA = 2.0


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK_CHARS)), UPPER, LOWER)


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` for each line; other levels give other places."""
    x = h1.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30)) ^ (h2.view(np.uint64) << np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray]:
    """(bits of each level, places of each level, slot of each line) for different lines (h1, h2).

    A level has twice as many places as lines; a line that has its place alone
    stays there, the others go to the next level.  The slot is the rank of the
    place among all that are taken.
    """
    left, bits, sizes, slots, before = np.arange(len(h1)), [], [], np.zeros(len(h1), np.int64), 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _spots(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        slots[left[stays]] = before + np.cumsum(alone)[at[stays]] - 1
        before += int(alone.sum())
        bits.append(np.packbits(alone).tobytes())
        sizes.append(size)
        left = left[~stays]
    return bits, sizes, slots


class Shard:
    """The arrays of one shard, ready for look-ups."""

    def __init__(self, bits: list[bytes], sizes: list[int], prints: np.ndarray):
        self.levels, before = [], 0
        for b, size in zip(bits, sizes):
            taken = np.unpackbits(np.frombuffer(b, np.uint8), count=size).astype(bool)
            rank = np.cumsum(taken, dtype=np.int32)
            self.levels.append((size, taken, rank, before))
            before += int(rank[-1])
        self.prints = prints

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each line, -1 where the fingerprint there is another one."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (size, taken, rank, before) in enumerate(self.levels):
            at = _spots(h1[left], h2[left], level, size)
            here = taken[at]
            out[left[here]] = before + rank[at[here]] - 1
            left = left[~here]
        if len(self.prints):
            out[(out >= 0) & (self.prints[out] != h2)] = -1
        return out


def long_lines(docs: DataFrame, least_chars: int, once: bool) -> DataFrame:
    """``(id, text_hash, line_no, h1, h2)`` of the lines of ``docs(id, body)`` whose key has ``least_chars`` code points.

    ``once``: each key once per row, and without its line number.
    """
    keys = F.transform(F.split("body", "\n", -1), line_key)
    if once:
        rows = docs.select("id", F.explode(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= least_chars))).alias("key"))
    else:  # the text is hashed once, before it becomes lines
        whole = docs.select("id", F.xxhash64("body").alias("text_hash"), keys.alias("keys"))
        rows = whole.select("id", "text_hash", F.posexplode("keys").alias("line_no", "key")).where(F.length("key") >= least_chars)
    return rows.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit("second"), "key")}).drop("key")


def packed(bits: list[bytes], sizes: list[int], prints: np.ndarray, counts: np.ndarray, keeps: pa.Array) -> bytes:
    """A shard's arrays as one value; rows that carry none then cost nothing."""
    batch = pa.RecordBatch.from_arrays([pa.array(prints), pa.array(counts), keeps], names=["prints", "counts", "keeps"])
    batch = batch.replace_schema_metadata({"sizes": ",".join(map(str, sizes)), "bits": b"".join(bits)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_shard(value: bytes) -> tuple[Shard, pa.Array, pa.Array]:
    """The shard, and its counts and keepers by slot."""
    with pa.ipc.open_stream(value) as stream:
        batch = stream.read_next_batch()
    sizes = [int(x) for x in batch.schema.metadata[b"sizes"].decode().split(",")]
    ends = np.cumsum([-(-n // 8) for n in sizes])
    bits = [batch.schema.metadata[b"bits"][e - -(-n // 8) : e] for n, e in zip(sizes, ends)]
    return Shard(bits, sizes, batch.column("prints").to_numpy()), batch.column("counts"), batch.column("keeps")


def line_index(lines: DataFrame, shards: int) -> DataFrame:
    """``(shard, arrays)``: minimal perfect hashes over ``lines(h1, h2, n, keep)``, one row per shard that has lines.

    The arrays by slot are fingerprints, counts and keepers; ``keep`` is of any type.
    """
    kind = to_arrow_type(lines.schema["keep"].dataType)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = group["h1"].to_numpy(np.int64), group["h2"].to_numpy(np.int64)
        bits, sizes, slots = perfect_hash(h1, h2)
        order = np.argsort(slots)
        keeps = group["keep"].astype(object).where(group["keep"].notna(), None).to_numpy()[order]
        arrays = packed(bits, sizes, h2[order], group["n"].to_numpy(np.int64)[order], pa.array(list(keeps), kind))
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "arrays": [arrays]})

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def probed(lines: DataFrame, index: DataFrame, shards: int, keep_type: str) -> DataFrame:
    """The rows of ``lines(id, text_hash, line_no, h1, h2)`` that the index has, with ``n`` and ``keep``."""
    own = ["id", "text_hash", "line_no", "h1", "h2"]
    asked = lines.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.lit(True).alias("asks"), *own)
    both = asked.unionByName(index.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    ordered = both.repartition("shard").sortWithinPartitions("shard", "asks")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, counts, keeps = None, None, None, None
        for batch in batches:
            asks, numbers = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("shard").to_numpy()
            heads = np.flatnonzero(~asks)
            for at, to in zip([0, *(heads + 1)], [*heads, len(asks)]):
                if at:
                    number = numbers[at - 1]
                    shard, counts, keeps = unpacked_shard(batch.column("arrays")[at - 1].as_py())
                mine = at + np.flatnonzero(numbers[at:to] == number) if shard else []
                if not len(mine):
                    continue
                rows = batch.select(own).take(pa.array(mine))
                slot = shard.find(rows.column("h1").to_numpy(), rows.column("h2").to_numpy())
                hit = np.flatnonzero(slot >= 0)
                rows, slot = rows.take(pa.array(hit)), pa.array(slot[hit])
                yield pa.RecordBatch.from_arrays([*rows.columns, counts.take(slot), keeps.take(slot)], names=[*own, "n", "keep"])

    types = dict(lines.dtypes)
    return ordered.mapInArrow(answer, f"id {types['id']}, text_hash long, line_no int, h1 long, h2 long, n long, keep {keep_type}")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, least_chars: int = 40, least_docs: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``rec`` (the columns ``carry``, or all), ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key of ``least_chars`` code points that ``least_docs`` rows hold loses all
    its lines but those in the rows with the largest id that holds it.  A null
    text is one empty line.  Each row counts as a document, also where ids or
    whole rows repeat; rows that share the largest id all keep the line.  A null
    id is smaller than any other.  A text whose lines all go is empty.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rec = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(rec.alias("rec"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    held = long_lines(rows, least_chars, once=True).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= least_docs)
    held = scratch.save(held)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    total, n_lines = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # lines with more than the share of a task: fewer than there are tasks
    frequent = F.col("n") * tasks > F.lit(total)
    shards = max(tasks, -(-n_lines // SHARD_LINES))
    index = scratch.save(line_index(held.where(~frequent), shards))
    asked = long_lines(rows, least_chars, once=False)
    hot = held.where(frequent).select("h1", "h2", "n", "keep")
    answered = scratch.save(asked.join(F.broadcast(hot), ["h1", "h2"], "left"))
    here = answered.where("n is not null").select("id", "text_hash", "line_no", "keep")
    there = probed(answered.where("n is null").select("id", "text_hash", "line_no", "h1", "h2"), index, shards, dict(held.dtypes)["keep"]).select("id", "text_hash", "line_no", "keep")
    gone = here.unionByName(there).where(~F.col("id").eqNullSafe(F.col("keep")))
    gone = gone.groupBy("id", "text_hash").agg(F.collect_set("line_no").alias("gone")).select(F.col("id").alias("gone_id"), "text_hash", "gone")
    rows = rows.withColumn("own_hash", F.xxhash64("body"))
    joined = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    lines = F.split("body", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), "gone")
    picked = F.get(F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")), F.lit(0))  # the text is split once
    out = joined.withColumn("n_lines", F.size(lines).cast("long"))
    return out.select("rec", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("body")).otherwise(picked).alias("kept_text"))
