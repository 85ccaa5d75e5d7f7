"""Quality rules: counts, binomial bounds, and what the certified cutoffs promise."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evoked_spark.llm.quality import binomial_tail, judged, thresholds, with_signals

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words = re.findall(WORD, text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "# a|b\n# a|b\n\n \n", "x y " * 30, "é漢 " * 9, "q" * 50_000, "same line\nsame line \nsame line", "a\x0bb\x0cc\rd"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(300))) for _ in range(40)]
    texts += ["\n".join(" ".join(str(rng.randrange(9)) for _ in range(rng.choice([3, 8, 12]))) for _ in range(20)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "w") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    for r in with_signals(docs).collect():
        want = plain(texts[r.rec.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.rec.doc_id][:80]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.rec.n_words == "w"


def test_binomial_tail(spark):
    cases = [(0, 100, 0.05), (3, 100, 0.05), (4, 1000, 0.01), (50, 60, 0.1), (0, 5, 0.5), (20, 20_000, 0.003)]
    for k, n, p in cases:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == (pytest.approx(want, rel=1e-9) if k < n * p else 1.0)


def documents(rng, n, lang):
    words = lambda: [rng.choice("abcdefghijklm") * rng.randrange(1, 6) + str(rng.randrange(10**6) % 7) for _ in range(40)]
    good = [" ".join(words()) for _ in range(n)]
    bad = [" ".join(w + "$%&" for w in words()) for _ in range(n // 5)]
    return [(t, lang, 1) for t in good] + [(t, lang, 0) for t in bad]


def test_certified_rules_reject_junk_only(spark):
    rng = random.Random(9)
    rows = documents(rng, 2600, "en") + documents(rng, 20, "fr")
    docs = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(rows) if i % 2], "doc_id long, quality int")
    verdict = {r.rec.doc_id: r.kept for r in judged(docs, labels).collect()}
    for i, (_, lang, quality) in enumerate(rows):
        assert verdict[i] == (quality == 1 or lang == "fr")  # too few labels certify nothing


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "w " * 30 + "\n", None), (1, "w " * 30 + "\n", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1)], "doc_id long, quality int")
    assert judged(docs, labels).count() == 3
    assert judged(docs.where("false"), labels).count() == 0 and judged(docs, labels.where("false")).count() == 3


def test_thresholds_against_brute_force_and_their_limit(spark):
    rng, rules = random.Random(12), {"symbol_ratio": (0.2, 0.5), "digit_ratio": (0.3, 0.6), "word_length": (0.5,)}
    rows = []
    for s in range(60):  # 60 strata, as many draws of the labels
        for _ in range(400):
            good = rng.random() < 0.7
            rows.append((f"s{s}", good, rng.random() < 0.5, rng.random() * (0.21 if good else 1), rng.random() * (0.33 if good else 0.7), rng.random() * (0.6 if good else 0.7)))
    labelled = spark.createDataFrame(rows, "stratum string, good boolean, held_out boolean, symbol_ratio double, digit_ratio double, word_length double")
    got = {(r.stratum, r.rule): r.cutoff for r in thresholds(labelled, rules, 0.15, 0.05, cost=4).collect()}
    want, names, too_many = {}, list(rules), 0
    share = {"symbol_ratio": lambda c: max(0, 1 - c / 0.21), "digit_ratio": lambda c: max(0, 1 - c / 0.33), "word_length": lambda c: max(0, 1 - c / 0.6)}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        best = []
        for i, rule in enumerate(names):
            gains = [(sum((1 if not r[1] else -4) for r in own if not r[2] and r[3 + i] > c), c) for c in rules[rule]]
            if max(gains)[0] > 0:
                best.append((-max(gains)[0], rule, max(gains)[1]))
        best.sort()
        held, chosen = [r for r in own if r[1] and r[2]], {}
        for m in range(1, len(best) + 1):
            k = sum(any(r[3 + names.index(rule)] > c for _, rule, c in best[:m]) for r in held)
            tail = sum(math.comb(len(held), i) * 0.15**i * 0.85 ** (len(held) - i) for i in range(k + 1))
            if k >= len(held) * 0.15 or tail > 0.05 / 60:
                break
            chosen = {rule: c for _, rule, c in best[:m]}
        want |= {(s, rule): c for rule, c in chosen.items()}
        keeps = 1.0
        for rule, c in chosen.items():
            keeps *= 1 - share[rule](c)
        too_many += 1 - keeps > 0.15
    assert got == want and len(got) >= 60
    assert too_many <= 3  # with probability 0.95 it is none
