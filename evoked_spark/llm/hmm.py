"""LM scoring with a hidden Markov model over word classes.

A text is its words with A-Z lower-cased and one end token.  The model draws a
chain of latent states, from each state a word class, and from the class the
word.  Classes are the ``CLASS_WORDS`` most frequent tokens, one class each,
and ``SUFFIX_CLASSES`` classes that the other words fall in by their last
three characters; within a class a word has its add-0.1 share of the training
tokens.  So the state and class tables are of fixed size, while the counts of
words are a table of the corpus that is joined, never broadcast.

Baum-Welch runs over every training text in every round: partitions compute
expected counts, Spark adds them up.  Both these counts and the scores, by the
scaled forward recursion, are exact and those of whole texts.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Frequent words whose counts are sent to the tasks (each at most LONGEST characters), and those of them with a class of their own.
HEAD_WORDS, CLASS_WORDS, SUFFIX_CLASSES, LONGEST = 65_536, 4096, 512, 32
STATES, BLOCK_TOKENS = 8, 400_000
#: Steps between two scalings: 16 times the smallest move of a corpus of 10^18 tokens stay above the smallest double.
EVERY = 16
#: Baum-Welch ends when a round gains less than this for a token, or after so many rounds.
LEAST_GAIN, ROUNDS = 0.01, 17
#: Stands for the end token in tables of words; no word is empty.
END = ""
N_CLASSES = CLASS_WORDS + SUFFIX_CLASSES


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased; the end token is not among them."""
    return text.lower().split() if text else []


def suffix_class(word: Column) -> Column:
    return F.lit(CLASS_WORDS) + (F.crc32(F.substring(word, -3, 3).cast("binary")) % SUFFIX_CLASSES).cast("int")


def _suffix_class(word: bytes) -> int:
    return CLASS_WORDS + zlib.crc32(word.decode()[-3:].encode()) % SUFFIX_CLASSES


def word_counts(texts: DataFrame, flush: int = 150_000) -> DataFrame:
    """``(word, c)`` over ``texts(body binary)``, counted per batch before the shuffle; the end token is one word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            found[b""] += len(batch)
            for body in batch["body"]:
                found.update(tokens(body))
                if len(found) > flush:
                    yield pd.DataFrame({"word": list(found), "c": list(found.values())})
                    found.clear()
        if found:
            yield pd.DataFrame({"word": list(found), "c": list(found.values())})

    return texts.select("body").mapInPandas(count, "word binary, c long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent short words of ``counts``, at most ``most``, on the driver, in order of count.

    A histogram of counts, of fixed size, gives the count from which on words
    are taken; so no task sends more than its share of the result.
    """
    steps = 256
    short = counts.where(F.length("word") <= LONGEST).withColumn("bin", F.floor(F.log2("c") * steps).cast("int"))
    sizes = sorted(((r["bin"], r["count"]) for r in short.groupBy("bin").count().collect()), reverse=True)  # at most 63 * steps rows
    taken, least = 0, None
    for at, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, at
    if least is None:
        return pd.DataFrame({"word": pd.Series(dtype=object), "c": pd.Series(dtype="int64")})
    return short.where(F.col("bin") >= least).select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def blocks(lengths: np.ndarray, most: int = BLOCK_TOKENS) -> Iterator[np.ndarray]:
    """Places of rows of like length, longest first, in blocks of at most ``most`` tokens or one row."""
    order = np.argsort(-lengths, kind="stable")
    upto = np.cumsum(lengths[order])
    at, done = 0, 0
    while at < len(order):
        stop = max(int(np.searchsorted(upto, done + most, side="right")), at + 1)
        yield order[at:stop]
        at, done = stop, int(upto[stop - 1])


class Hmm:
    """Start, transition and emission tables of fixed size, and what one pass needs of them."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (S), (S, S), (classes, S)
        self.room: np.ndarray | None = None

    @staticmethod
    def initial(share: np.ndarray, seed: int = 11, states: int = STATES) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))

    @cached_property
    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """Emissions over the largest of their class, and the natural log of that largest one.

        So a step makes a sum of alphas smaller by no more than the smallest
        move, and ``EVERY`` steps in a row need no scaling.
        """
        top = self.emit.max(1)
        return self.emit / top[:, None], np.log(top)

    @staticmethod
    def _layout(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by falling length; all symbols step by step, in that order; where each step begins."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([rows[i] for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        running = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
        return order, np.concatenate([flat[starts[:n] + t] for t, n in enumerate(running)]), np.concatenate([[0], np.cumsum(running)])

    def log_likelihood(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural log of the probability of each class sequence (none is empty), by the scaled forward recursion."""
        out = np.empty(len(rows))
        emit, top = self.scaled
        for block in blocks(np.fromiter(map(len, rows), np.int64, len(rows)), 2 * BLOCK_TOKENS):  # alphas of one step at a time are kept
            order, symbols, steps = self._layout([rows[i] for i in block])
            total, alpha = np.zeros(len(block)), None
            for t, (at, upto) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist())):
                n = upto - at
                if alpha is not None and n < len(alpha):  # rows that ended a step before
                    total[n : len(alpha)] += np.log(alpha[n:].sum(1))
                e = emit[symbols[at:upto]]
                alpha = e * self.start if alpha is None else (alpha[:n] @ self.move) * e
                if t % EVERY == EVERY - 1:
                    scale = alpha.sum(1)
                    total[:n] += np.log(scale)
                    alpha /= scale[:, None]
            total[: len(alpha)] += np.log(alpha.sum(1))
            out[block[order]] = total
        return out + np.fromiter((top[r].sum() for r in rows), float, len(rows))

    def _forward(self, alphas: np.ndarray, steps: list[int], first: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Turns the emissions of steps ``first``, ``first + 1`` ... into alphas; those of the last step, and the scale of each place."""
        scales, move = np.ones(len(alphas)), self.move
        for t, (at, upto) in enumerate(zip(steps[:-1], steps[1:]), first):
            alpha = alphas[at:upto]
            alpha *= self.start if before is None else before[: upto - at].dot(move)
            if t % EVERY == EVERY - 1:
                scale = alpha.sum(1)
                alpha /= scale[:, None]
                scales[at:upto] = scale
            before = alpha
        return before.copy(), scales

    def _room(self, size: int) -> np.ndarray:
        """Memory for two arrays of ``size`` by states, the same one for every block: fresh pages cost as much as the sums in them."""
        if self.room is None or self.room.shape[1] < size:
            self.room = np.empty((2, size, len(self.start)))
        return self.room

    def expected(self, rows: list[np.ndarray], most: int = BLOCK_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions, and the log-likelihood: the E step of Baum-Welch, over whole rows.

        Rows run side by side, in stretches of steps that hold ``most`` tokens.
        Where there are several, a first pass keeps the alphas between them
        alone, and the alphas of a stretch are made again when the way back
        reaches it; so a row of any length needs the memory of one stretch, and
        its counts are those of the whole row.
        """
        _, symbols, steps = self._layout(rows)
        emit, top = self.scaled
        s, move_back = len(self.start), self.move.T.copy()
        cuts = [0]
        while cuts[-1] < len(steps) - 1:
            cuts.append(max(int(np.searchsorted(steps, steps[cuts[-1]] + most, side="right")) - 1, cuts[-1] + 1))
        spans = list(zip(cuts[:-1], cuts[1:]))
        room = self._room(max(steps[b] - steps[a] for a, b in spans))
        entering: list[np.ndarray | None] = [None]
        for a, b in spans[:-1]:
            entering.append(self._forward(emit[symbols[steps[a] : steps[b]]], (steps[a : b + 1] - steps[a]).tolist(), a, entering[-1])[0])
        moves, emits, starts = np.zeros((s, s)), np.zeros((len(emit), s)), np.zeros(s)
        likelihood, later = 0.0, np.zeros((0, s))  # emission * beta / scale of the step behind
        for (a, b), before in zip(spans[::-1], entering[::-1]):
            own, local = symbols[steps[a] : steps[b]], (steps[a : b + 1] - steps[a]).tolist()
            alphas, weighted = room[0, : len(own)], room[1, : len(own)]
            np.take(emit, own, axis=0, out=weighted, mode="clip")
            alphas[:] = weighted
            _, scales = self._forward(alphas, local, a, before)
            weighted /= scales[:, None]
            behind = np.append(np.diff(local)[1:], len(later))  # rows that go on after each step
            ends = np.concatenate([np.arange(at + n, upto) for at, upto, n in zip(local[:-1], local[1:], behind.tolist()) if at + n < upto] or [np.zeros(0, int)])
            rest = alphas[ends].sum(1)
            likelihood += float(np.log(scales).sum() + np.log(rest).sum() + top[own].sum())
            alphas[ends] /= rest[:, None]
            weighted[ends] /= rest[:, None]
            for at, upto in zip(local[-2::-1], local[:0:-1]):
                n = len(later)
                if n:
                    moves += alphas[at : at + n].T.dot(later)
                    room[:, at : at + n] *= later.dot(move_back)
                later = weighted[at:upto]
            later = later.copy()
            emits += np.stack([np.bincount(own, weights=alphas[:, k], minlength=len(emit)) for k in range(s)], axis=1)
            if a == 0:
                starts = alphas[: local[1]].sum(0)
        return starts, moves * self.move, emits, likelihood

    @staticmethod
    def from_counts(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray, prior: float = 50.0) -> Hmm:
        """The M step; emissions are smoothed towards the share of each class, so none is 0."""
        emit = emits + prior * share[:, None]
        move = moves + 1.0
        start = starts + 1.0
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(rows: DataFrame, share: np.ndarray, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN) -> Hmm:
    """Baum-Welch over ``rows(classes)``; every round takes every row, whole.

    Ends when a round has gained less than ``least_gain`` (natural log of the
    probability of a token, on average), or after ``rounds``, with a warning if
    the last one gained more than that.
    """
    model = Hmm.initial(share)
    states, last = len(model.start), None
    for _ in range(rounds):
        start, move, emit = model.start, model.move, model.emit

        def e_step(batches: Iterator[pd.DataFrame], start=start, move=move, emit=emit) -> Iterator[pd.DataFrame]:
            own, total = Hmm(start, move, emit), None
            for batch in batches:
                classes = [np.asarray(c) for c in batch["classes"]]
                for block in blocks(np.fromiter(map(len, classes), np.int64, len(classes))):
                    chosen = [classes[i] for i in block]
                    found = np.concatenate([*[np.ravel(x) for x in own.expected(chosen)], [sum(map(len, chosen))]])
                    total = found if total is None else total + found
            if total is not None:
                at = np.flatnonzero(total)
                yield pd.DataFrame({"k": at, "v": total[at]})

        sums = rows.select("classes").mapInPandas(e_step, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()  # as many as the tables have entries
        if sums.empty:
            break
        total = np.zeros(states + states * states + emit.size + 2)
        total[sums["k"].to_numpy()] = sums["v"].to_numpy()
        mean = total[-2] / total[-1]
        model = Hmm.from_counts(total[:states], total[states : states + states**2].reshape(states, states), total[states + states**2 : -2].reshape(emit.shape), share)
        if last is not None and mean - last < least_gain:
            break
        last = mean
    else:
        if rounds:
            warnings.warn(f"training ended unsettled after {rounds} rounds")
    return model


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **training) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs``.

    Learns from the rows where ``held_out`` is false.  A null text is empty: it
    has the end token only.  Repeated rows are scored, and counted, each.  With
    no training rows the base probability of every token is 1 and the model
    stays as it starts.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("body"))
    counts = scratch.save(word_counts(texts.where(~F.col("held_out"))))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    head = frequent_words(counts, HEAD_WORDS)
    head["class"] = [i if i < CLASS_WORDS else -1 for i in range(len(head))]
    singles = head["word"][:CLASS_WORDS].tolist()
    single = spark.createDataFrame([(w,) for w in singles], "word string")
    rest = counts.join(F.broadcast(single), "word", "left_anti").groupBy(suffix_class(F.col("word")).alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    mass = np.full(N_CLASSES, 0.1)
    size = np.zeros(N_CLASSES)
    mass[: len(singles)] = head["c"][:CLASS_WORDS].to_numpy() + 0.1  # the only word of its class
    size[: len(singles)] = head["c"][:CLASS_WORDS].to_numpy()
    mass[rest["class"].to_numpy(int)] = rest["n"].to_numpy() + 0.1 * (rest["v"].to_numpy() + 1)
    size[rest["class"].to_numpy(int)] = rest["n"].to_numpy()
    log_mass = np.log10(mass)
    share = (size + 0.1) / (size + 0.1).sum()
    class_of = np.array([k if k >= 0 else _suffix_class(w.encode()) for w, k in zip(head["word"], head["class"])] + [0], np.int32)
    log_of = np.log10(np.append(head["c"].to_numpy(float), 0.9) + 0.1)  # the last one is for words outside: 0
    known = spark.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(head["word"])}, class_of, log_of))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, class_of, log_of = known.value
        place = table.get
        end, end_known = (place(b""), 1) if b"" in table else (-1, 0)
        end_class, end_log = (class_of[end], log_of[end]) if end_known else (_suffix_class(b""), -1.0)
        for batch in (whole[at : at + 1000] for whole in batches for at in range(0, len(whole), 1000)):  # what is made of few rows fits in memory
            out = []
            for body in batch["body"]:
                words = tokens(body)
                at = np.fromiter(map(place, words, repeat(-1)), np.int32, len(words))
                classes = np.append(class_of[at], np.int32(end_class))
                outside = np.flatnonzero(at < 0)
                rare = [words[i] for i in outside.tolist()]
                tail = Counter(rare)
                own = {w: _suffix_class(w) for w in tail}
                classes[outside] = [own[w] for w in rare]
                out.append((len(classes), len(words) - len(rare) + end_known, float(log_of[at].sum() + end_log), float(log_mass[classes].sum()), classes, [w.decode() for w in tail], list(tail.values())))
            made = pd.DataFrame(out, columns=["n_tokens", "head_known", "head_log", "class_log", "classes", "tail", "times"])
            for c in ("id", "held_out"):
                made[c] = batch[c].array
            yield made

    kind = dict(texts.dtypes)["id"]
    rows = texts.mapInPandas(encode, f"id {kind}, held_out boolean, n_tokens long, head_known long, head_log double, class_log double, classes array<int>, tail array<string>, times array<int>")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))

    model = train(rows.where(~F.col("held_out")).select("classes"), share, **training)
    start, move, emit = model.start, model.move, model.emit

    @F.pandas_udf(T.DoubleType())
    def log10_classes(classes: pd.Series) -> pd.Series:
        return pd.Series(Hmm(start, move, emit).log_likelihood([np.asarray(c) for c in classes]) / np.log(10))

    # words outside the head meet their counts in a join; their logs are added up per row
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    joined = tail.join(counts.hint("merge"), "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("tail_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"))
    chain = scratch.save(rows.select("row", "id", "held_out", "n_tokens", "head_known", "head_log", "class_log", log10_classes("classes").alias("chain_log")))
    all_rows = chain.join(sums.hint("merge"), "row", "left")
    logs = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))
    return all_rows.select("id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("chain_log") + logs - F.col("class_log")).alias("score"))
