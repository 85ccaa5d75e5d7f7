"""Exact dedup against counting equal strings."""

import random
from collections import defaultdict

from evoked_spark.llm.exact_dedup import drop_exact_copies, radix_groups


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    stems = ["", "a", "a" * 130, "a" * 5000, "b" * 128, "é" * 64, "\x00", "x" * 127 + "é"]
    texts = [s + rng.choice(["", "", "y", "é", "\x00", "z" * 300]) for s in stems for _ in range(12)]
    rows = [(rng.choice([i, None, i // 2]), rng.choice([t, t, None]), "k", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, n long")
    want = defaultdict(list)
    for i, t, _, _ in rows:
        want[t or ""].append(i)
    got = defaultdict(list)
    for r in radix_groups(docs, first=2, growth=3).collect():
        got[r.rec.text or ""].append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for text, members in got.items():
        ids = [i for i in want[text] if i is not None]
        keep = max(ids) if ids else None
        assert all(m.keep_id == keep and m.group_size == len(members) for m in members)
        assert [m.rec.doc_id for m in members if m.kept] == [keep]


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "t", "a"), (1, "t", "a"), (2, "u", "b")], "doc_id long, text string, kept string")
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "t", "a"), (2, "u", "b")]
    assert drop_exact_copies(docs.where("false")).count() == 0


def test_carried_columns(spark):
    docs = spark.createDataFrame([(i, "same" * 100 if i % 3 else f"own {i}") for i in range(9)], "doc_id long, text string")
    rows = radix_groups(docs, carry=["doc_id"], first=4, growth=4).collect()
    assert {r.rec.doc_id for r in rows if r.kept} == {0, 3, 6, 8} and len(rows) == 9
