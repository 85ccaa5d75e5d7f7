"""Compact windows and substring dedup against brute-force versions."""

import random

import numpy as np

from evoked_spark.llm.common import Scratch, connected_components
from evoked_spark.llm.passages import DEPTH, PASSAGE_WORDS, RUN, Sums, T, compact_windows, interval_keys, joined_components, joint_windows, passage_classes, passage_keys, repeated_passages, rotation_keys, shared_passages, shingles, word_hashes


def test_compact_windows_cover_every_range_once():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 60, 80).astype(np.uint64)  # with ties
    begin = np.array([0, 30])
    first, last = np.repeat(begin, [30, 50]), np.repeat([29, 79], [30, 50])
    t = 5
    l, c, r = compact_windows(h, first, last, t)
    for a, b in ((0, 29), (30, 79)):
        for i in range(a, b + 1):
            for j in range(i + t - 1, b + 1):
                own = [k for k in range(len(c)) if l[k] <= i <= c[k] <= j <= r[k]]
                assert len(own) == 1 and h[c[own[0]]] == h[i : j + 1].min()


def test_shingles_do_not_depend_on_place():
    a, owner = shingles(b"one two three four five six\0x\0One  two\nthree four FIVE")
    assert owner.tolist() == [0, 0, 2] and a[0] == a[2] != a[1]


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(n)]


def documents(rng):
    shared, near = words(rng, 50), words(rng, 120)
    changed = list(near)
    changed[60] = "changed"
    docs = [words(rng, rng.randrange(0, 400)) for _ in range(30)]
    docs += [words(rng, 70) + shared + words(rng, 30), shared + words(rng, 200), words(rng, 5) + shared]
    docs += [words(rng, 40) + near + words(rng, 10), changed + words(rng, 90)]
    docs += [words(rng, 60) + shared[:40] + words(rng, 60)]  # too short a part
    return [" ".join(d) for d in docs]


def test_planted_passages_are_found_and_others_left(spark):
    texts = documents(random.Random(5))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "y"), (2, texts[2], "x"), (None, texts[4] + " tail", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    all_rows = passage_classes(docs).collect()
    assert sorted((r.id is None, r.id) for r in all_rows) == sorted((r[0] is None, r[0]) for r in rows)
    got = {r.id: r for r in all_rows if r.star_links}
    assert set(got) == {30, 31, 32, 33, 34}
    assert all(r.component_id == r.id and r.first_word is None and r.longest == 0 for r in all_rows if not r.star_links)
    assert got[30].component_id == got[31].component_id == got[32].component_id == 30
    assert got[33].component_id == got[34].component_id == 33
    assert got[31].first_word == 0 and got[31].last_word == 50
    assert repeated_passages(docs.where("false")).count() == 0


def test_every_shared_run_meets():
    rng = random.Random(8)
    shared = " ".join(words(rng, RUN + 4))
    a, b = " ".join(words(rng, 33)) + " " + shared, shared + " " + " ".join(words(rng, 57))
    one, two = (joint_windows(*shingles(t.encode())) for t in (a, b))
    assert set(one[0]) & set(two[0])


def edited(rng, passage, how):
    """A passage of 50 words or more that has Jaccard similarity 0.8 or more with the given one."""
    out, at = list(passage), rng.randrange(1, len(passage) - 1)
    if how == "change":
        out[at] = "other"
    elif how == "put in":
        out.insert(at, "other")
    elif how == "put in two":
        out[at:at] = ["other", "more"]
    elif how == "leave out":
        del out[at]
    return out


def test_similar_passages_send_an_equal_key_in_every_step():
    rng = random.Random(14)
    for n in range(300):
        how = ("change", "put in", "put in two", "leave out", "copy")[n % 5]
        passage = words(rng, PASSAGE_WORDS + (how == "leave out"))
        pair = [word_hashes(" ".join(words(rng, 25) + p + words(rng, 25)).encode())[0] for p in (passage, edited(rng, passage, how))]
        met = False
        for way in (1, -1):
            ends = []
            for w in pair:
                n, w = len(w), Sums(w[::way])
                steps, at, kinds = [], np.arange(n - 24), np.zeros(n - 24, int)
                for depth in range(DEPTH + 1):
                    keys, at, kinds = interval_keys(w, at, kinds, depth)
                    steps.append(set(keys.tolist()))
                ends.append([*steps, set(passage_keys(w, at, kinds, DEPTH)[0].tolist())])
            met |= all(a & b for a, b in zip(*ends))
        assert met, how


def test_all_pairs_are_found_beside_less_similar_documents(spark):
    """Against brute force over all pairs: Jaccard similarity of 50-word passages, in groups of template texts."""
    rng, texts = random.Random(15), []
    for n in range(60):
        passage = words(rng, 50)
        less = list(passage)
        for at in (10, 25, 40):
            less[at] = "less"
        near = edited(rng, passage, ("change", "put in", "copy")[n % 3])
        texts += [words(rng, rng.randrange(5, 40)) + p + words(rng, rng.randrange(5, 40)) for p in (less, passage, near)]
    common = words(rng, 44)
    texts += [words(rng, 30) + common + words(rng, 30) for _ in range(80)]  # a common line, but no 45 words in common
    twin = words(rng, 5)
    texts += [words(rng, 30) + common + twin + words(rng, 30) for _ in range(2)]
    hashes = [shingles(" ".join(w).encode())[0].tolist() for w in texts]
    sets = [[set(h[i : i + T]) for i in range(len(h) - T + 1)] for h in hashes]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if len(set(hashes[i]) & set(hashes[j])) >= 36 and any(len(a & b) >= 0.8 * len(a | b) for a in sets[i] for b in sets[j])}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    root = {r.id: r.component_id for r in passage_classes(docs).collect()}
    assert len(links) > 55 and all(root[i] == root[j] for i, j in links)
    own = list(range(len(texts)))
    for i, j in sorted(links):  # the classes of brute force: no more is linked
        own = [min(own[i], own[j]) if c in (own[i], own[j]) else c for c in own]
    assert [root[i] for i in range(len(texts))] == own


def test_windows_that_are_rotations_have_equal_keys():
    rng = random.Random(17)
    for cut in (1, 7, 20, 25, 40, 49):
        p, (a, b) = words(rng, 50), (words(rng, 30), words(rng, 12))
        one, two = (word_hashes(" ".join(w).encode())[0] for w in (a + p + b, b + p[cut:] + p[:cut] + a))
        here, there = (dict(zip(*(x.tolist() for x in rotation_keys(w, np.arange(len(w) - 24))))) for w in (one, two))
        assert [(here[k], there[k]) for k in set(here) & set(there)].count((30, 12)) == 1
    assert len(rotation_keys(one[:40], np.array([0]))[0]) == 0


def test_swapped_halves_beside_documents_that_hold_both_apart(spark):
    """Against brute force: parts of 25 and of 20 and 30 words swapped, under a smaller document with neither in a row."""
    rng, texts = random.Random(18), []
    for n in range(30):
        cut = (25, 20, 30)[n % 3]
        p = words(rng, 50)
        x, y = p, p[cut:] + p[:cut]
        texts += [p[:cut] + words(rng, 60) + p[cut:], words(rng, 30) + x + words(rng, 10), words(rng, 10) + y + words(rng, 30)]
    hashes = [shingles(" ".join(w).encode())[0].tolist() for w in texts]
    sets = [[set(h[i : i + T]) for i in range(len(h) - T + 1)] for h in hashes]
    links = {(i, j) for g in range(0, len(texts), 3) for i in range(g, g + 3) for j in range(g, i) if any(len(a & b) >= 0.8 * len(a | b) for a in sets[i] for b in sets[j])}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    root = {r.id: r.component_id for r in passage_classes(docs).collect()}
    assert len(links) == 30 and all(root[i] == root[j] for i, j in links)
    assert all(root[g] == g and root[g + 1] == root[g + 2] == g + 1 for g in range(0, len(texts), 3))


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(16)
    giant = words(rng, 60_000)
    rows = [("a", " ".join(giant), 1, 2, 3), ("b", " ".join(words(rng, 100) + giant[30_000:30_060]), 1, 2, 3), ("c", "x " * 20_000, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "name string, text string, row long, key long, root long")
    got = {r.id: r for r in passage_classes(docs, "name").collect()}
    assert got["a"].component_id == got["b"].component_id != got["c"].component_id
    assert (got["a"].first_word, got["a"].last_word) == (30_000, 30_060)


def shared(x, y):
    a, b = (shingles(" ".join(w).encode())[0] for w in (x, y))
    return shared_passages([(0, a)], b, [(0, len(b) - 1)])


def test_one_run_that_maps_to_several_places():
    rng = random.Random(9)
    p, p1, p2, between = (words(rng, n) for n in (60, 200, 200, 100))
    assert sorted(shared(p + p, p)) == [(0, 55, 0, 55), (60, 115, 0, 55)]
    assert sorted(shared(p, p + p)) == [(0, 55, 0, 55), (0, 55, 60, 115)]
    assert sorted(shared(p1 + p2, p1 + between + p2)) == [(0, 195, 0, 195), (200, 395, 300, 495)]
    assert sorted(shared(p1 + p2, p2 + between + p1)) == [(0, 195, 300, 495), (200, 395, 0, 195)]
    assert shared(p, p[:30] + words(rng, 30) + p[30:]) == []
    assert shared(p + ["all"] * 3000, ["all"] * 3000)


def test_documents_with_inserted_swapped_and_doubled_passages_are_linked(spark):
    rng = random.Random(10)
    texts = []
    for make in (lambda a, b, c: (a + b, a + c + b), lambda a, b, c: (a + b, b + c + a), lambda a, b, c: (a[:60] * 2, c + a[:60])):
        texts += make(words(rng, 200), words(rng, 200), words(rng, 100))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.id: r.component_id for r in passage_classes(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_copies_under_a_smaller_document_that_fails_are_linked(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):  # template texts: only the middle is shared by all, the whole passage by the last two or three
        middle, left, right = words(rng, 30), words(rng, 20), words(rng, 20)
        near = [*left, *middle, *right[:12], "other", *right[13:]]
        texts += [words(rng, 60) + words(rng, 20) + middle + words(rng, 20), words(rng, 60) + words(rng, 20) + middle + words(rng, 20)]
        texts += [left + middle + right + words(rng, 60), words(rng, 60) + left + middle + right, words(rng, 60) + near]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.component_id for r in passage_classes(docs).collect() if r.star_links}
    assert got == {i: i - i % 5 + 2 for i in range(len(texts)) if i % 5 > 1}


def test_components_join(spark):
    """Links that come later join components as if all had been there at once."""
    rng = random.Random(8)
    first, later = ([(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (120, 60))
    later = [(a, b) for a, b in later if a != b]
    table = lambda rows, names: spark.createDataFrame(rows, names)
    scratch = Scratch(spark)
    roots = connected_components(table(first, "u long, v long"), scratch)
    for more in (later, []):
        got = joined_components(roots, table(more, "row long, other_row long"), scratch)
        want = connected_components(table(first + more, "u long, v long"), scratch)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
