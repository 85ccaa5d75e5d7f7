"""Shared helpers: scratch tables, words, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and U+0009..U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing and the session runs on this machine alone
    (tests, a notebook), a new temporary folder is made and stored in the
    session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Tables written to the shared folder to cut lineage between rounds.

    A written table outlives the loss of executors, unlike a local checkpoint.
    ``drop`` frees one that no later plan reads, ``result`` all but the one it
    writes, and ``clear`` all; what is left goes when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.made: set[str] = set()
        _open.add(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.made.add(path)
        return out

    def result(self, df: DataFrame) -> DataFrame:
        """``df``, written; all other tables are deleted, so nothing else may read them."""
        before = set(self.made)
        out = self.save(df)
        for path in before:
            self._delete(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(self.paths.pop(id(table)))

    def clear(self) -> None:
        """Deletes all tables; for when what was made from them is written elsewhere."""
        self.paths.clear()
        self.made.clear()
        self._delete(self.base)
        _open.discard(self)

    def _delete(self, path: str) -> None:
        self.made.discard(path)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


_open: set[Scratch] = set()


@atexit.register
def _clear_all() -> None:
    for scratch in list(_open):
        with contextlib.suppress(Exception):  # the session may have ended before
            scratch.clear()


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df``, chosen by a hash of ``key``; all of them if there are no more.

    A filter: nothing is sorted, and no task or driver sees more than the sample.
    """
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(n)) < most)


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def unpacked(df: DataFrame, struct_name: str) -> DataFrame:
    """The columns of one struct."""
    return df.select(f"{struct_name}.*")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(u, v)``; root is the smallest node of its component.

    Alternates large-star and small-star rounds until nothing changes.  Minima
    are aggregated before they are shuffled, and the joins are plain equi-joins
    whose hot keys the adaptive planner can split, so a hub costs no single task.
    Rows with a null end are ignored; an empty input gives an empty result.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    current, seen = scratch.save(edges), None
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first: a join of plain rows on both sides can be split where a node is hot
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(current, low, large, least)
        current = after
        if state == seen:
            break
        seen = state
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
