"""Chat formatting from reply trees.

Messages reply to messages.  Iterative self-joins double the hop of every
message's pointer to an ancestor until all have passed the root, adding up
scores on the way; a tree of depth d takes log2(d) rounds.  The leaves of a
tree are ranked by the score of their branch, and the same pointers enumerate
the messages of each chosen root-to-leaf path, which is then formatted as one
conversation.  Self-joins carry ids and numbers only; texts join once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

OPEN, TEXT, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: A backslash goes behind the first character of each of these inside a text, and before each backslash.
_CONTROL = re.compile(r"\\|<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int]]:
    """The formatted conversation, and the loss mask as start, stop, start, stop ... in code points."""
    out, at, mask = ["<s>"], 3, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{TEXT}", escape(text)
        if role == trained:
            mask += [at + len(head), at + len(head) + len(body)]
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join([*out, "</s>"]), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of :func:`render`."""
    turns = formatted[3:-4].split(OPEN)[1:]
    return [tuple(unescape(part) for part in turn.removesuffix(CLOSE).split(TEXT, 1)) for turn in turns]


def chosen_paths(messages: DataFrame, branches: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """``(tree, leaf, depth, node)``: the messages of the best root-to-leaf paths of each tree.

    ``messages(tree, node, parent, score)``, keys without nulls except
    ``parent``.  A message whose parent is null or missing is a root.  Branches
    rank by the sum of their scores (null is 0), then length, then leaf id.
    Messages on a reply cycle have no root and belong to no path.  The rounds
    end after 40: pointers have passed 2^40 messages then, so only cycles are left.
    """
    scratch = scratch or Scratch(messages.sparkSession)
    m = scratch.save(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    nodes = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = m.join(nodes.hint("merge"), ["tree", "parent"], "left")
    state = scratch.save(state.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")))
    levels, rounds = [state], 0
    while not state.where("up is not null").isEmpty() and rounds < 40:
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("hops"))
        joined = state.where("up is not null").join(above.hint("merge"), ["tree", "up"])
        hopped = joined.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("hops")).alias("depth"))
        state = scratch.save(hopped.unionAll(state.where("up is null")))  # those at their root hop no more
        levels.append(state)
        rounds += 1
    inner = levels[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = state.where("up is null").join(inner.hint("merge"), ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node"))
    best = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    path = best.select("tree", F.col("node").alias("leaf"), "node")
    for level in reversed(levels[:-1]):
        hops = level.where("up is not null").select("tree", "node", "up")
        path = scratch.save(path.unionAll(path.join(hops.hint("merge"), ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"))))
    return path.join(state.select("tree", "node", "depth").hint("merge"), ["tree", "node"]).select("tree", "leaf", "depth", "node")


def formatted(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """``(tree, leaf, formatted, loss_mask)``, one row per path; ``texts(tree, node, role, text)``, null is empty.

    One conversation is one output value, so its turns do meet in one row.
    """
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(texts.hint("merge"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def render_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"]]
            yield pd.DataFrame({"tree": batch["tree"], "leaf": batch["leaf"], "formatted": [d[0] for d in done], "loss_mask": [d[1] for d in done]})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(render_all, f"tree {kinds['tree']}, leaf {kinds['leaf']}, formatted string, loss_mask array<long>")


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """``(tree, conv_id, node, parent, score, role, text)`` of ``conversations(conv_id, turn, role, text)``.

    Every turn replies to the one before it, by turn (null first), then role
    and text; rows with a null conv_id are one conversation.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(tree.alias("tree"), "conv_id", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """What a reader finds in ``rows(tree, formatted, loss_mask)``: counts and digests of turns and of the text under the loss mask."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tree, text, mask in zip(batch["tree"], batch["formatted"], batch["loss_mask"]):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[i:j]) for i, j in zip(mask[::2], mask[1::2]))
                out.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.select("tree", "formatted", "loss_mask").mapInPandas(read, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
