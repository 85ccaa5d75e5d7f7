"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over word counts is fitted on a bounded sample of labelled
rows (about ``max_rows`` documents, chosen by a hash of their ids).  Its loss
has a second term: in every sentence of the sample that names a group, the name
is swapped for each other one of its kind, and the squared change of the logit
is penalised.  A group's name then carries little weight of its own, and neutral
mentions aren't taken for abuse.  A swap changes the counts of two words only,
so sentences with the same two counts are added up before they leave a task.

The words, and beginnings of words, are all whose document frequency differs between the labels beyond
chance, all words of the sample tested together (Bonferroni).

The corpus is read for the labelled rows (joined to the bounded sample, which
is broadcast) and once to score every text; no pass shuffles a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample

#: Names of groups, by kind; a name is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)

STEM = 5
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(text: str | None) -> list[str]:
    """The words of a text and, with a star, the first letters of those that are longer: a stem in other inflections still counts."""
    words = tokens(text)
    return words + [w[:STEM] + "*" for w in words if len(w) > STEM]


@dataclass
class ToxicityModel:
    """Weights of the words that a bounded sample tells apart; small enough to be sent to every task."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0

    def logit(self, text: str | None) -> float:
        found = Counter(filter(self.weights.__contains__, features(text)))
        return self.bias + sum(self.weights[w] * math.log2(1 + n) for w, n in found.items())

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(max(self.logit(text), -500), 500)))


class Rows:
    """Sparse rows: which columns, what values, and where each row begins."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
        self.at, self.value = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in (rows, values))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * u[self.row], self.width)


def objective(x: Rows, y: np.ndarray, swaps: Rows, times: np.ndarray, w: np.ndarray, strength: float, ridge: float) -> float:
    """log loss + ridge * |weights|^2 / 2 + strength * mean squared logit change * rows / 2; the last weight is the bias."""
    logit = x.dot(w[:-1]) + w[-1]
    change = swaps.dot(w[:-1])
    return float(np.logaddexp(0, logit).sum() - y @ logit + ridge * w[:-1] @ w[:-1] / 2 + strength * len(y) / max(times.sum(), 1e-12) * (times @ change**2) / 2)


def fit(x: Rows, y: np.ndarray, swaps: Rows, times: np.ndarray, strength: float = 5.0, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """The weights, bias last, that minimise :func:`objective`: Newton's method, each step solved by conjugate gradients.

    Without both labels there is nothing to learn: the bias is then that of the
    share of label 1 (or near 0), and all weights are 0.
    """
    rate = (y.sum() + 0.5) / (len(y) + 100)
    w = np.zeros(x.width + 1)
    w[-1] = math.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max() or not x.width:
        return w
    pull = times * strength * len(y) / max(times.sum(), 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w[:-1]) + w[-1], -30, 30)))
        gradient = np.append(x.back(p - y) + ridge * w[:-1] + swaps.back(pull * swaps.dot(w[:-1])), (p - y).sum())
        share = p * (1 - p)

        def curve(v: np.ndarray) -> np.ndarray:
            z = share * (x.dot(v[:-1]) + v[-1])
            return np.append(x.back(z) + ridge * v[:-1] + swaps.back(pull * swaps.dot(v[:-1])), z.sum() + 1e-9 * v[-1])

        move, rest = np.zeros_like(w), gradient.copy()
        along, size = rest.copy(), rest @ rest
        first = size
        for _ in range(60):
            if size <= 1e-8 * first or size == 0:
                break
            bent = curve(along)
            step = size / (along @ bent)
            move, rest = move + step * along, rest - step * bent
            size, before = rest @ rest, size
            along = rest + size / before * along
        scale, now = min(1.0, 5 / max(np.abs(move).max(), 1e-12)), objective(x, y, swaps, times, w, strength, ridge)
        while scale > 1e-4 and objective(x, y, swaps, times, w - scale * move, strength, ridge) > now:
            scale /= 2
        w = w - scale * move
        if np.abs(scale * move).max() < 1e-4 or now - objective(x, y, swaps, times, w, strength, ridge) < 1e-8 * now:
            break
    return w


def train(labelled: DataFrame, level: float = 0.01, least_docs: int = 5, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, strength: float = 5.0) -> ToxicityModel:
    """The model of ``labelled(text, label)``, a sample that the caller has bounded: its word counts go to the driver.

    The vocabulary is every word in at least ``least_docs`` documents whose
    frequency differs between the labels at ``level`` after correction for the
    number of words, and the group names: all of them, whose number the sample
    bounds, as each needs ``least_docs`` of its documents.
    """
    kinds = {t: kind for kind in terms for t in kind}

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {0: Counter(), 1: Counter()}
            for text, label in zip(batch["text"], batch["label"]):
                found[int(label)].update(set(features(text)))
            yield pd.DataFrame([(w, n if y == 0 else 0, n if y else 0) for y in (0, 1) for w, n in found[y].items()], columns=["word", "n0", "n1"])

    totals = labelled.groupBy().agg(F.count_if(F.col("label") == 0).cast("double"), F.count_if(F.col("label") == 1).cast("double")).first()
    n0, n1 = max(totals[0], 1.0), max(totals[1], 1.0)
    df = labelled.mapInPandas(frequencies, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least_docs)
    least_z = NormalDist().inv_cdf(1 - level / 2 / max(df.count(), 1))
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    stems = [t[:STEM] + "*" for t in kinds if len(t) > STEM]  # a swap must change nothing but the names
    telling = df.where(~F.col("word").isin(stems) & (z >= least_z)).select("word")
    chosen = sorted({r["word"] for r in telling.collect()} | set(kinds))  # words of the bounded sample
    place = {w: i for i, w in enumerate(chosen)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [Counter(filter(place.__contains__, features(t))) for t in batch["text"]]
            yield pd.DataFrame({"at": [np.array([place[w] for w in c], np.int32) for c in counts], "n": [np.array(list(c.values()), np.int32) for c in counts], "label": batch["label"]})

    def swapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch["text"]:
                for sentence in _SENTENCE.split(text or ""):
                    own = Counter(w for w in tokens(sentence) if w in kinds)
                    found.update((w, other, n, own[other]) for w, n in own.items() for other in kinds[w] if other != w)
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["word", "other", "n_word", "n_other", "times"])

    documents = labelled.mapInPandas(vectors, "at array<int>, n array<int>, label int").toPandas()
    pairs = labelled.mapInPandas(swapped, "word string, other string, n_word int, n_other int, times long").groupBy("word", "other", "n_word", "n_other").agg(F.sum("times").alias("times")).orderBy("word", "other", "n_word", "n_other").toPandas()
    log = lambda n: np.log2(1 + np.asarray(n, float))
    x = Rows([np.asarray(a, np.int64) for a in documents["at"]], [log(n) for n in documents["n"]], len(chosen))
    gone, more = log(pairs["n_word"]), log(pairs["n_other"] + pairs["n_word"]) - log(pairs["n_other"])
    swaps = Rows([np.array([place[w], place[o]]) for w, o in zip(pairs["word"], pairs["other"])], [np.array([a, -b]) for a, b in zip(gone, more)], len(chosen))
    w = fit(x, documents["label"].to_numpy(float), swaps, pairs["times"].to_numpy(float), strength)
    return ToxicityModel({word: v for word, v in zip(chosen, w[:-1].tolist()) if v}, float(w[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``(text, label)`` of about ``max_rows`` labelled rows; ``labels(doc_id, toxic)``.

    Of repeated labels the highest counts; null ones and null ids are left out.
    The sample is taken from the labels, by hash, and broadcast: its size
    is bounded by ``max_rows`` times two numbers.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = hash_sample(marks, "doc_id", max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the score of the whole text, 0 to 1; a null text scores like an empty one.

    A column that already has that name stays under another one: give ``score_col``.
    """
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col} already")
    weights, bias = model.weights, model.bias

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        own = ToxicityModel(weights, bias)
        return pd.Series([own.score(t) for t in text], dtype=float)

    return docs.withColumn(score_col, score(F.col(f"`{text_col}`").cast("string")))
