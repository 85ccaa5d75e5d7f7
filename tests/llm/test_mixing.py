"""Source mixing against a plain version of the same rule."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evoked_spark.llm import mixing
from evoked_spark.llm.mixing import fair_queue, mixed


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size)
    while open_:  # share, stop those above, share again
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] >= 2 * total[s]]
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in above:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.remove(s)
    queue = []
    for s in names:
        own = sorted((hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], n, i) for i, (n, r) in enumerate(zip(size, rows)) if r[2] == s)
        for c in (0, 1):
            queued = c * total[s]
            for place, key, n, i in own:
                queued += n
                if target[s]:
                    queue.append((queued / target[s], place, key, n, i))
    taken, used, budget = [0] * len(rows), 0, sum(target.values())
    for *_, n, i in sorted(queue):
        used += n
        if used > budget:
            break
        taken[i] += 1
    return target, size, taken


@pytest.mark.parametrize("seed, edge", [(0, 10_000), (1, 10_000), (2, 10_000), (2, 0), (1, 3)])
def test_mix_matches_plain_version(spark, monkeypatch, seed, edge):
    monkeypatch.setattr(mixing, "EDGE_COPIES", edge)  # the bucket at the cut is split again and again
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None][: 3 + seed]
    rows = [(i, None if i % 17 == 0 else " ".join("w" * rng.randrange(0, 60)), rng.choice(names + names[:1] * 6)) for i in range(300)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, slot string")
    target, size, taken = plain(rows)
    got = {r.rec.doc_id: r for r in fair_queue(docs).collect()}
    for (i, _, s), n, t in zip(rows, size, taken):
        assert got[i].size == n and got[i].target == pytest.approx(target[s]) and got[i].copies == t
    for s in names:
        used = sum(got[i].copies * got[i].size for i, _, own in rows if own == s)
        assert abs(used - target[s]) <= 2 * max(size)
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(taken)


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert fair_queue(spark.createDataFrame([], schema)).count() == 0
    none = fair_queue(spark.createDataFrame([(1, None, None), (None, "", "a")], schema)).collect()
    assert [r.copies for r in none] == [0, 0]
    same = spark.createDataFrame([(7, "a b c", "s")] * 6 + [(None, "d e", None)] * 4, schema)
    rows = fair_queue(same).collect()
    assert len(rows) == 10 and sorted(r.copies for r in rows) == sorted(r.copies for r in fair_queue(same).collect())


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "w " * 1_500_000, "a"), (2, "x" * 2_000_000, "a"), (3, "w\x0b" * 700_000, "b"), (4, "one two", "b"), (5, "\x85 \u3000", None)]
    target, size, taken = plain(rows)
    assert size == [1_500_000, 1, 700_000, 2, 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "target", "copies", "copy", "queue", "bucket", "place", "finish"):
        docs = docs.withColumn(c, F.lit("other"))
    got = {r.doc_id: r.copies for r in fair_queue(docs).select("rec.doc_id", "copies").collect()}
    assert [got[i] for i, *_ in rows] == taken
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(taken) and out.where("size <> 'other' or copies <> 'other'").count() == 0
