"""SimHash near-dedup against a brute-force version."""

import random

import xxhash
from pyspark.sql import functions as F

from evoked_spark.llm.simhash import drop_near_copies, fingerprint, links, near_copies


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    return {f: root(f) for f in prints}


def test_fingerprint():
    for text in ["", " \n\t", "one", "Two WORDS", "a b c", "a  b\tc\nd", "É É é x y\x0bz", "a b c d", "w " * 500]:
        assert fingerprint(text.encode()) % 2**64 == plain_fingerprint(text), text


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    prints = {0, -1}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(6):
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                base ^= 1 << b
            prints.add(base - 2**64 if base >= 2**63 else base)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = links(frame).collect()
    unsigned = {p % 2**64 for p in prints}
    assert all(bin((u ^ v) % 2**64).count("1") <= 2 for u, v in found)
    parent = {p: p for p in unsigned}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in found:
        parent[root(u % 2**64)] = root(v % 2**64)
    want = plain_components(unsigned)
    groups = lambda f: {frozenset(x for x in unsigned if f(x) == r) for r in {f(x) for x in unsigned}}
    assert groups(root) == groups(want.get)


def test_edge_cases(spark):
    rows = [(1, "same text here", "x"), (2, "same text here", "y"), (2, "same text here", "y"), (3, None, None), (None, "", "z"), (4, "quite another one of them", "w"), (5, "q" * 100_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.rec.doc_id, r.rec.text): r.component_id for r in near_copies(docs).collect()}
    assert got[(2, "same text here")] == 1 and got[(None, "")] == 3 and got[(3, None)] == 3
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert near_copies(docs.where("false")).count() == 0
    assert drop_near_copies(docs.where(F.lit(False))).count() == 0
