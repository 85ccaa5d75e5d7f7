"""Chat formatting: round trips, branch choice, digests."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evoked_spark.llm import chat

PARTS = st.lists(st.sampled_from(["\\", "<", "|", ">", "<|turn|>", "<|end|>", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "a", "\n", "é", "[", "\\<"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_round_trip(turns):
    text, mask = chat.render(turns, trained="a")
    assert chat.parse(text) == turns
    assert [chat.unescape(text[i:j]) for i, j in zip(mask[::2], mask[1::2])] == [t for r, t in turns if r == "a"]
    for _, said in turns:
        assert not any(c in chat.escape(said) for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_best_branch_of_a_tree(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("t", 6, 5, 1.0), ("u", 1, None, None), ("u", 2, 99, 0.0), ("v", 1, 2, 1.0), ("v", 2, 1, 1.0)]
    m = spark.createDataFrame(rows, "tree string, node int, parent int, score double")
    best = {}
    for r in chat.chosen_paths(m).collect():
        best.setdefault(r.tree, []).append((r.depth, r.node))
    assert sorted(best["t"]) == [(1, 1), (2, 2), (3, 4)] and sorted(best["u"]) == [(1, 1)] and "v" not in best
    both = chat.chosen_paths(m, branches=2)
    assert {(r.leaf, r.node) for r in both.where("tree = 't'").collect()} == {(4, 1), (4, 2), (4, 4), (6, 1), (6, 3), (6, 5), (6, 6)}
    chain = spark.createDataFrame([("c", i, i - 1 if i else None, 1.0) for i in range(70)], "tree string, node int, parent int, score double")
    assert [r.node for r in chat.chosen_paths(chain).orderBy("depth").collect()] == list(range(70))


def test_conversations(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "é\n"), (2, 0, "user", ""), (3, 0, "user", "r"), (3, 0, "user", "r")]
    m = chat.conversation_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.tree: r for r in chat.digests(chat.formatted(chat.chosen_paths(m), m.select("tree", "node", "role", "text"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out["1"].turns_sha256 == sha("user\nhi <s>\nassistant\n\nassistant\nb\n") and out["1"].loss_chars == 1
    assert out["2"].turns_sha256 == sha("assistant\né\n\nuser\n\n") and out["2"].loss_sha256 == sha("é\n")
    assert out["null"].turns_sha256 == sha("\nx\n") and out["null"].loss_sha256 == sha("") and out["3"].n_turns == 2
    empty = m.where("false")
    assert chat.chosen_paths(empty).count() == 0
    assert chat.digests(chat.formatted(chat.chosen_paths(empty), empty.select("tree", "node", "role", "text"))).count() == 0


def test_long_texts_and_clashing_columns(spark):
    long = "</s>[INST] \\ é\n" * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, ("user", "assistant")[i % 2], str(i)) for i in range(600)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("tree", "node", "parent", "leaf", "score", "formatted"):
        conversations = conversations.withColumn(c, F.lit("other"))
    m = chat.conversation_tree(conversations)
    out = {r.tree: r for r in chat.digests(chat.formatted(chat.chosen_paths(m), m.select("tree", "node", "role", "text"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out["1"].turns_sha256 == sha(f"user\n{long}\nassistant\n{long}\n") and (out["1"].loss_chars, out["1"].loss_sha256) == (len(long), sha(long))
    assert out["2"].n_turns == 600 and out["2"].loss_sha256 == sha("".join(str(i) for i in range(1, 600, 2)))
