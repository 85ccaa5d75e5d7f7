"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np

from evoked_spark.llm import registry
from evoked_spark.llm.periodic import FIRST, collapsed, extended, find_runs, periodic_runs, sliding

DIR = "/root/testdata/sf0.001"


def plain_runs(w):
    """Every lag at every place; the smallest period of a stretch wins."""
    n, found = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(24, 3 * p):
                found.setdefault((i, length), p)
            i = j + 1
    return sorted((s, p, length) for (s, length), p in found.items())


def periodic(rng, alphabet, p, times, rest):
    unit = [rng.randrange(alphabet) for _ in range(p)]
    return unit * times + unit[:rest]


def texts(rng):
    out = [[], [1], [7] * 23, [7] * 24, [7] * 5000, [1, 2] * 12, [1, 2, 3] * 8 + [1], [1, 2] * 11 + [1]]
    for alphabet in (2, 4, 50, 10**6):
        for p in (1, 5, 8, 20, 63, 64, 65, 97, 127, 128, 129, 200, 255, 256, 300):
            times = rng.choice([2, 3, 3, 4, 6])
            body = periodic(rng, alphabet, p, times, rng.randrange(p))
            noise = [rng.randrange(alphabet) for _ in range(rng.randrange(80))]
            out.append(noise + body + noise[::-1] + periodic(rng, alphabet, rng.randrange(1, 90), 3, 0))
    # periods made of long short-period parts, and runs that overlap
    for a, b in ((70, 3), (100, 100), (31, 90)):
        unit = [1] * a + [2] * b + [1, 2] * 20
        out.append(unit * 4 + [5] * 30)
        out.append([rng.randrange(3)] * a + unit * 3 + unit[: len(unit) // 2] + [9])
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    out.append(fib[-1])  # runs of exponent 3 and more at every scale
    return out


def test_runs_match_brute_force():
    rng = random.Random(3)
    all_texts = texts(rng)
    got = find_runs([np.array(t, np.int64) for t in all_texts])
    for t, runs in zip(all_texts, got):
        assert runs == plain_runs(t), (len(t), runs[:3])
    assert sum(p >= 4 * FIRST for runs in got for _, p, _ in runs) > 5
    alone = [find_runs([np.array(t, np.int64)])[0] for t in all_texts]
    assert alone == got


def test_small_random_texts():
    rng = random.Random(9)
    for _ in range(300):
        t = [rng.randrange(rng.choice([2, 3])) for _ in range(rng.randrange(250))]
        if rng.random() < 0.5 and t:
            a = rng.randrange(len(t))
            p = 1 + (len(t) - a) // (3 + rng.randrange(8))
            t = t[:a] + [t[a + (i - a) % p] for i in range(a, len(t))]
        assert find_runs([np.array(t, np.int64)])[0] == plain_runs(t)


def test_sliding_and_extending():
    a = np.array([3, 1, 4, 1, 5, 9, 2, 6], np.uint64)
    for k in range(1, 9):
        assert sliding(a, k, np.minimum).tolist() == [a[i : i + k].min() for i in range(9 - k)]
    assert len(sliding(a, 9, np.minimum)) == 0
    w = np.array([9] + [1, 2, 3] * 100 + [8])
    assert extended(w, 150, 3) == (1, 298) and extended(w, 1, 3) == (1, 298)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(40)) + "\n"
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "y"), (None, long * 50_000, "z"), (4, "a b " * 12, "z"), (4, "a b " * 12, "z")]
    docs = spark.createDataFrame(rows, "runs long, text string, collapsed string")
    out = periodic_runs(docs).collect()
    assert sorted((r.rec.runs is None, r.rec.runs) for r in out) == sorted((r[0] is None, r[0]) for r in rows)
    for r in out:
        if r.rec.runs is None:
            assert [tuple(x) for x in r.runs] == [(0, 40, 2_000_000)] and r.n_words == 2_000_000 and r.collapsed == long.strip()
        elif r.rec.runs == 4:
            assert [tuple(x) for x in r.runs] == [(0, 2, 24)] and r.collapsed == "a b"
        else:
            assert r.n_words == 0 and r.runs == [] and r.collapsed == ""
    assert periodic_runs(docs.where("false")).count() == 0


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = registry.QUERIES["op11_periodic_runs"](spark, DIR).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        planted += bool(runs)
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-(10**9) * x[2] // x[1], x[0], x[1]), default=None)
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
        listed = "".join(f"{s},{length},{p}\n" for s, p, length in runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        keep = [True] * n
        for s, p, length in runs:
            keep[s + p : s + length] = [False] * (length - p)
        rest = " ".join(x for x, k in zip(words, keep) if k)
        assert r.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest() and rest == collapsed(words, runs)
    assert planted > 5
