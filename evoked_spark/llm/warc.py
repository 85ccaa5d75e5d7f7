"""WARC archives and their Merkle fixity audit.

Records are hashed, and the hashes of ordered offset ranges are hashed again,
about ``FANOUT`` at a time, up to one root per archive.  Ranges end where the
hash of a record's id says so, so both replicas cut alike.  Two replicas are
compared root by root; only the children of nodes that differ are compared
next, down to the damaged records.  Archives are cut at a target size, so a file, its order
and its tree are bounded however large the collection is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

FANOUT = 16
#: Bytes of an archive file, about; and what a header takes, about.
FILE_BYTES, HEADER_BYTES = 16 << 20, 300
_END = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One response record as text; its bytes are the text in UTF-8.  Null fields are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text(page_id), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), text(url)),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(text(html)).cast("string")),
        F.lit(""),
    ]
    return F.concat(*[part for line in lines for part in (line, F.lit(_END))], text(html), F.lit(_END + _END))


def files_needed(pages: DataFrame, target: int = FILE_BYTES) -> int:
    size = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + HEADER_BYTES)
    total = pages.agg(size).first()[0] or 0
    return max(1, -(-total // target))


def archive_of(page_id: Column, n_files: int) -> Column:
    digest = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_files


def leaves(pages: DataFrame, n_files: int) -> DataFrame:
    """``(page_id, archive, key, idx, start, stop, length, digest)``: a replica's records in the order of their offsets.

    Records are ordered by page_id (null first), url and content, so repeated
    rows have a defined place.  ``key`` is the record's id and url, with a
    number where they repeat; ``digest`` is that of the record alone.  An empty
    table gives no archive.
    """
    body = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", "url", archive_of(F.col("page_id"), n_files).alias("archive"), F.octet_length(body).cast("long").alias("length"), F.sha2(body.cast("binary"), 256).alias("digest"))
    order = W.partitionBy("archive").orderBy("page_id", "url", "length", "digest")
    again = F.row_number().over(W.partitionBy("archive", "page_id", "url").orderBy("length", "digest"))
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), again.cast("string"))
    rows = rows.withColumn("idx", F.row_number().over(order).cast("long") - 1).withColumn("stop", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("key", key)
    return rows.select("page_id", "archive", "key", "idx", (F.col("stop") - F.col("length")).alias("start"), "stop", "length", "digest")


def height_of(*replicas: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the records that bring the longest archive down to one root."""
    most = max((r.agg(F.max("idx")).first()[0] or 0) + 1 for r in replicas)
    height = 1
    while fanout**height < most:
        height += 1
    return height


def tree(replica: DataFrame, scratch: Scratch, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of a replica's trees, records first, one root per archive last: ``(archive, node, up, start, stop, digest)``.

    A range of level l ends before a record the hash of whose key is divisible
    by fanout to the l, and is named after the record it begins with (the first
    one has no name).  So a record that is put in, lost or longer changes its
    own ranges and moves no border of another.  A range's digest is that of its
    parts' names and digests in the order of their offsets; offsets aren't in it.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 60))
    before = W.partitionBy("archive").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    ups = {f"up{i}": F.coalesce(F.last(F.when(F.pmod(place, F.lit(fanout**i)) == 0, F.col("key")), ignorenulls=True).over(before), F.lit("")) for i in range(1, height)}
    ups[f"up{height}"] = F.lit("")
    level = scratch.save(replica.select("archive", F.col("key").alias("node"), "start", "stop", "digest", *[c.alias(n) for n, c in ups.items()]))
    levels = [level]
    for i in range(1, height + 1):
        parts = F.sort_array(F.collect_list(F.struct("start", "node", "digest")))  # about fanout of them
        joined = F.array_join(F.transform(parts, lambda c: F.concat_ws(":", c["node"], c["digest"])), "|")
        above = [F.first(f"up{j}").alias(f"up{j}") for j in range(i + 1, height + 1)]
        rows = levels[-1].groupBy("archive", f"up{i}").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(joined.cast("binary"), 256).alias("digest"), *above)
        levels.append(scratch.save(rows.withColumnRenamed(f"up{i}", "node")))
    return [df.withColumn("up", F.col(f"up{i + 1}") if i < height else F.lit("")).select("archive", "node", "up", "start", "stop", "digest") for i, df in enumerate(levels)]


def mismatches(ours: list[DataFrame], theirs: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``(archive, node, verdict)`` of the records that ``differs``, or that are ``missing`` or ``extra`` in the other replica, by descending from differing roots only."""
    suspects = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if suspects is not None:
            a, b = (df.join(suspects, ["archive", "up"], "left_semi") for df in (a, b))
        a, b = a.select("archive", "node", "digest"), b.select("archive", "node", F.col("digest").alias("other"))
        verdict = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("differs")
        found = scratch.save(a.join(b, ["archive", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("archive", "node", verdict.alias("verdict")))
        suspects = found.select("archive", F.col("node").alias("up"))
    return found


def audited(ours: DataFrame, theirs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The records of ``ours`` (as from :func:`leaves`) with ``verdict`` and ``moved``, and after them those that only the other replica has.

    ``verdict`` is same, differs, missing (in the other replica) or extra (only
    there).  ``moved`` says that an equal record lies at another offset in the
    other replica, which is no damage of its own; null if there is none.
    """
    scratch = scratch or Scratch(ours.sparkSession)
    ours, theirs = scratch.save(ours), scratch.save(theirs)
    height = height_of(ours, theirs)
    found = mismatches(tree(ours, scratch, height), tree(theirs, scratch, height), scratch).withColumnRenamed("node", "key")
    there = theirs.select("archive", "key", F.col("start").alias("their_start"))
    rows = ours.join(found.where("verdict <> 'extra'"), ["archive", "key"], "left").join(there, ["archive", "key"], "left")
    verdict = F.coalesce("verdict", F.lit("same"))
    rows = rows.select(*ours.columns, verdict.alias("verdict"), F.when(verdict == "same", F.col("start") != F.col("their_start")).alias("moved"))
    extra = theirs.join(found.where("verdict = 'extra'"), ["archive", "key"]).select(*ours.columns, "verdict", F.lit(None).cast("boolean").alias("moved"))
    return rows.unionByName(extra)


def write_archives(pages: DataFrame, path: str, n_files: int) -> None:
    """Writes real archive files, one folder per archive, records in offset order."""
    body = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(archive_of(F.col("page_id"), n_files).alias("archive"), "page_id", "url", body.alias("body"))
    order = ["archive", "page_id", "url", F.octet_length("body"), F.sha2(F.col("body").cast("binary"), 256)]  # as in leaves()
    line = F.col("body").substr(F.lit(1), F.length("body") - 2)  # the writer ends each line itself
    ordered = rows.repartition("archive").sortWithinPartitions(*order).select("archive", line.alias("value"))
    ordered.write.partitionBy("archive").option("lineSep", _END).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(url, record_id, start, stop, html)`` of the response records in files as written above; one bounded file per row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, at = [], 0
                while at < len(content):
                    head = content.index(b"\r\n\r\n", at)
                    fields = dict(line.split(": ", 1) for line in content[at:head].decode().split(_END)[1:])
                    stop = head + 4 + int(fields["Content-Length"])
                    out.append((fields["WARC-Target-URI"], fields["WARC-Record-ID"], at, stop + 4, content[head + 4 : stop].decode()))
                    at = stop + 4
                yield pd.DataFrame(out, columns=["url", "record_id", "start", "stop", "html"])

    return files.select("content").mapInPandas(records, "url string, record_id string, start long, stop long, html string")
