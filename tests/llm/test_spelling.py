"""Spelling variants against brute force."""

import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evoked_spark.llm import registry
from evoked_spark.llm import spelling
from evoked_spark.llm.spelling import letter_counts, letters, one_edit, spelling_forms, word_runs

DIR = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def holes(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def brute_force(counts, least_length=6, least_n=5, ratio=5):
    """Near words meet by deleting a letter of either; each meeting is checked."""
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_n}
    meet = defaultdict(set)
    for w in n:
        for x in holes(w) | {w}:
            meet[x].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            for b in group:
                same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
                if same or len(a) + 1 == len(b) and a in holes(b) or len(b) + 1 == len(a) and b in holes(a):
                    near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def counts_of(rng):
    base = ["".join(rng.choice("aeiont") for _ in range(rng.randrange(5, 9))) for _ in range(150)] + ["éàüßÿ×÷a", "straße", "ÀÀÀÀÀÀ", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabcabc", "z" * 3000]
    counts = Counter()
    for w in base:
        n = rng.choice([5, 6, 30, 200])
        counts[w] = max(counts[w], n)
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice("aeiontéx")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[i:] + w[:i]])
            counts[v] = max(counts[v], rng.choice([1, 4, 5, n // 5, n]))
    counts["zeroth"], counts["zeroeth"], counts["zeroethe"], counts["zeroethes"] = 5000, 900, 150, 20  # a chain of forms
    return counts


@pytest.mark.parametrize("bucket, tile", [(4096, 16_384), (20, 60)])
def test_matches_brute_force(spark, monkeypatch, bucket, tile):
    monkeypatch.setattr(spelling, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(spelling, "TILE_LETTERS", tile)
    counts = counts_of(random.Random(6))
    words = spark.createDataFrame([(w, c) for w, c in counts.items()], "word string, c long").selectExpr("explode(array_repeat(word, cast(c as int))) as word")
    got = sorted(tuple(r) for r in spelling_forms(words).collect())
    want = brute_force(counts)
    assert got == want
    assert sum(r[1] is not None for r in want) > 40
    assert ("zeroethes", "zeroethe", "zeroth") in {r[:3] for r in got}


def test_edits_and_counts():
    a, b = letters(["abcdef", "aaaaaa", "abcdef"]), letters(["abcdefg", "aaaaaaa", "axbcdfe"])
    assert one_edit(a, b).tolist() == [True, True, False]
    assert one_edit(a, letters(["abcdef", "abaaaa", "abdcef"])).tolist() == [False, True, False]
    x = letter_counts(letters(["éaé", "zzz"]))
    assert x.sum(1).tolist() == [3, 3] and x.max(1).tolist() == [2, 3]


def test_runs_of_letters_and_edge_rows(spark):
    rows = [(1, "Don't STOP éÀx×y 1a2"), (2, None), (3, ""), (None, "œuvre"), (1, "Don't STOP éÀx×y 1a2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id or 0, r.word) for r in word_runs(docs).collect())
    one = [(1, w) for w in ("don", "t", "stop", "éÀx×y", "a")]
    assert got == sorted(one * 2 + [(0, "uvre")])
    assert spelling_forms(word_runs(docs)).count() == 0
    assert spelling_forms(docs.select("text").withColumnRenamed("text", "word").where("false")).count() == 0
    nulls = spark.createDataFrame([(None, 1), ("abcdef", 2)] * 5, "word string, n long")
    assert [tuple(r) for r in spelling_forms(nulls).collect()] == [("abcdef", None, "abcdef", 5, 0, None)]


def test_query_matches_brute_force(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            at = h % len(w)
            counts[w[:at] + w[at + 1 :] if h % 199 == 0 else w] += 1
    got = sorted(tuple(r) for r in registry.QUERIES["op13_spelling_variants"](spark, DIR).collect())
    assert got == brute_force(counts)
    assert len(got) > 500 and np.mean([r[4] for r in got]) > 0.5
