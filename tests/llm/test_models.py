"""Toxicity on held-out and counterfactual texts; the hidden Markov model against sums over all paths."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked_spark.llm import hmm, toxicity
from evoked_spark.llm.queries_models import fold


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "of", "and", "in"]) + rng.choice("abcdefgh") * rng.randrange(4) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[:2] = rng.sample(["idiot", "scum", "moron"], 2)
        if rng.random() < (0.6 if toxic else 0.05):  # one group is named mostly where there is abuse
            words.append("muslims")
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_toxicity(spark):
    rows = corpus(random.Random(2), 1500)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(None, None, "s"), (9001, "", "s"), (9002, "w " * 50_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int").where(fold(3) != 1)
    sample = toxicity.labelled_sample(docs, labels)
    model = toxicity.train(sample)
    out = {r.doc_id: r.toxicity for r in toxicity.scored(docs, model, score_col="toxicity").collect()}
    assert all((out[i] >= 0.7) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1)
    assert out[9001] == out[None] < 0.5 and out[9002] < 0.5
    plain = toxicity.train(sample, strength=0.0)
    neutral = "the muslims of the in and"
    moved = lambda m: abs(m.logit(neutral) - m.logit(neutral.replace("muslims", "jews")))
    assert moved(model) < 0.2 * moved(plain) and model.score(neutral) < plain.score(neutral)
    assert toxicity.train(sample.where("false")).score("idiot") < 0.5
    assert toxicity.scored(docs.where("false").drop("score"), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.scored(docs, model)


def test_the_fit_is_the_minimum_of_its_objective():
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 3, (300, 6)) * rng.integers(0, 2, (300, 6)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(1 - dense @ np.array([2.0, -1, 0, 1, 0, 0])))).astype(float)
    sparse = lambda m: toxicity.Rows([np.flatnonzero(r) for r in m], [r[r != 0] for r in m], 6)
    swaps, times = np.array([[1.0, 0, -1, 0, 0, 0], [0, 0, 0, 2.0, 0, -1]]), np.array([3.0, 1.0])
    w = toxicity.fit(sparse(dense), y, sparse(swaps), times, strength=5.0, ridge=0.5)

    def loss(w):  # as the formula says
        p = 1 / (1 + np.exp(-(dense @ w[:-1] + w[-1])))
        change = (times @ (swaps @ w[:-1]) ** 2) / times.sum()
        return -(y @ np.log(p) + (1 - y) @ np.log(1 - p)) + 0.5 * w[:-1] @ w[:-1] / 2 + 5.0 * 300 * change / 2

    assert toxicity.objective(sparse(dense), y, sparse(swaps), times, w, 5.0, 0.5) == pytest.approx(loss(w))
    for k in range(7):
        for step in (1e-3, -1e-3):
            assert loss(w + step * np.eye(7)[k]) > loss(w)


def test_likelihood_and_counts_match_all_paths():
    rng = np.random.default_rng(3)
    m = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    rows = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for row, got in zip(rows, m.log_likelihood(rows)):
        paths = {}
        for p in itertools.product(range(3), repeat=len(row)):
            w = m.start[p[0]] * m.emit[row[0], p[0]]
            for t in range(1, len(row)):
                w *= m.move[p[t - 1], p[t]] * m.emit[row[t], p[t]]
            paths[p] = w
        total = sum(paths.values())
        assert got == pytest.approx(math.log(total))
        for p, w in paths.items():
            starts[p[0]] += w / total
            for t, c in enumerate(row):
                emits[c, p[t]] += w / total
                if t:
                    moves[p[t - 1], p[t]] += w / total
    for most in (1, 3, 100):  # however many steps go at a time
        for got, want in zip(m.expected(rows, most), (starts, moves, emits, m.log_likelihood(rows).sum())):
            assert np.allclose(got, want)


def test_counts_of_long_rows_are_those_of_the_whole_row():
    rng = np.random.default_rng(8)
    sharp = np.full((6, 3), 1e-9)
    sharp[np.arange(6), np.arange(6) % 3] = 0.5  # states and moves that all but exclude each other
    move = np.full((3, 3), 1e-9)
    move[np.arange(3), [1, 2, 0]] = 1
    m = hmm.Hmm(np.array([0.2, 0.3, 0.5]), move / move.sum(1, keepdims=True), sharp / sharp.sum(0))
    rows = [rng.integers(0, 6, n) for n in (2000, 2000, 1, 17, 900, 15, 16)]
    starts, moves, emits, total = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)), 0.0
    for row in rows:  # forward and backward in logs, a row and a step at a time
        le, lm = np.log(m.emit[row]), np.log(m.move)
        fore, back = [np.log(m.start) + le[0]], [np.zeros(3)]
        for t in range(1, len(row)):
            fore.append(np.logaddexp.reduce(fore[-1][:, None] + lm, axis=0) + le[t])
            back.append(np.logaddexp.reduce(lm + le[-t] + back[-1], axis=1))
        back = back[::-1]
        whole = np.logaddexp.reduce(fore[-1])
        assert m.log_likelihood([row])[0] == pytest.approx(whole)
        total += whole
        states = np.exp(np.array(fore) + np.array(back) - whole)
        starts += states[0]
        np.add.at(emits, row, states)
        for t in range(1, len(row)):
            moves += np.exp(fore[t - 1][:, None] + lm + le[t] + back[t] - whole)
    for most in (50, 1001, 10**6):
        got = m.expected(rows, most)
        assert got[3] == pytest.approx(total)
        assert all(np.allclose(g, w, rtol=1e-6) for g, w in zip(got, (starts, moves, emits)))
    assert sorted(np.concatenate(list(hmm.blocks(np.array([5, 1, 9, 2, 2]), 4))).tolist()) == [0, 1, 2, 3, 4]


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 4, 200) + 4 * (i % 2) for i in range(20)]
    share = np.full(8, 1 / 8)
    m, seen = hmm.Hmm.initial(share, states=2), []
    for _ in range(12):
        seen.append(m.log_likelihood(rows).sum())
        m = hmm.Hmm.from_counts(*m.expected(rows)[:3], share, prior=0.0)
    assert all(b >= a - 5 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 1000


def test_scores(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["el", "la", "de"] if i % 2 else ["The", "of", "and"]) + rng.choice(["", "x", "yz"]) for _ in range(rng.randrange(50))) for i in range(200)]
    texts += [None, "", "z" * 3000, "é\tñ\x0bö"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the of", 1), (5, texts[5], 1)], "doc_id long, text string, score int")
    held = F.coalesce(fold(10) == 0, F.lit(False))
    got = hmm.scored(docs, held, rounds=6).collect()
    words = lambda t: (t or "").encode().lower().split() + [b""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the of"), (5, texts[5])]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not is_held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        w = words(texts[r.id] if r.id is not None else "the of")
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, is_held(r.id))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    parts = hmm.scored(docs.repartition(7), held, rounds=6).collect()  # the layout of the table doesn't matter
    key = lambda r: (r.id is None, r.id or 0)
    assert [r.score for r in sorted(parts, key=key)] == pytest.approx([r.score for r in sorted(got, key=key)], abs=1e-6)
    empty = hmm.scored(docs.where("false"), held, rounds=2)
    assert empty.count() == 0


def test_every_round_takes_whole_texts(spark):
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 20, n) for n in (700, 3, 40)]
    texts[0][512:] += 20  # classes that only come late in a long text
    share = np.full(40, 1 / 40)
    rows = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(texts)], "row long, classes array<int>")
    with pytest.warns(UserWarning, match="unsettled"):
        got = hmm.train(rows, share, rounds=4, least_gain=-1.0)
    want = hmm.Hmm.initial(share)
    for _ in range(4):
        want = hmm.Hmm.from_counts(*want.expected(texts)[:3], share)
    assert got.emit == pytest.approx(want.emit) and got.move == pytest.approx(want.move)
