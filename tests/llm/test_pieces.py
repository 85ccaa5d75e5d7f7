"""SentencePiece by max-plus scan against the library and brute force."""

import itertools
import pathlib
import random

import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as proto

from evoked_spark.llm import pieces as P
from evoked_spark.llm.queries_text import MODEL_PATH

MODEL = pathlib.Path(MODEL_PATH)
PARTS = ["a", "the", "ing", " ", "  ", "é", "漢", "😀", "\n", "0", "xyz", "ation", "\t", "er", "in", "s"]


def chunked(own, text, chunk):
    body = own.prefix + text
    parts = []
    for at in range(0, len(body), chunk):
        low, stop = max(at - 64, 0), min(at + chunk, len(body))
        parts.append((body[low : stop + 64], at - low, stop - low))
    states = P.best_states([own.transfer(*p) for p in parts], P.FREE, P.FREE)
    return list(itertools.chain.from_iterable(own.pieces(*p, s, x) for p, (s, x) in zip(parts, states)))


def test_chunks_give_the_ids_of_the_library():
    own, library = P.Pieces(MODEL.read_bytes()), SentencePieceProcessor(model_file=str(MODEL))
    rng = random.Random(2)
    for pool in (PARTS, [p for p in PARTS if p.strip(" ")]):
        for n in (1, 9, 150, 150):
            text = "".join(rng.choice(pool) for _ in range(n))
            ids = library.encode(text)
            assert own.encode(text) == ids and own.decode(ids) == text
            for size in (20, 37):
                assert chunked(own, text, size) == ids


def unigram():
    spec = proto.ModelProto()
    spec.trainer_spec.model_type = 1
    spec.normalizer_spec.add_dummy_prefix = True
    spec.normalizer_spec.remove_extra_whitespaces = False
    spec.normalizer_spec.escape_whitespaces = True
    rows = [("<unk>", 0, 2)] + [(p, -1.5 - i * 0.37 % 2 - 0.2 / len(p), 1) for i, p in enumerate(["a", "b", "ab", "ba", "aab", "bab", "▁", "▁a", "abab", "aba"])]
    for piece, score, kind in rows:
        spec.pieces.add(piece=piece, score=score, type=kind)
    return spec


def test_unigram_chunks_match_brute_force():
    spec = unigram()
    own = P.Pieces(spec.SerializeToString())
    scores = {p.piece.replace("▁", " "): p.score for p in spec.pieces if p.type == 1}

    def best(text):
        top = {0: 0.0}
        for i in range(1, len(text) + 1):
            top[i] = max((top[j] + scores[text[j:i]] for j in range(max(0, i - 4), i) if text[j:i] in scores), default=float("-inf"))
        return top[len(text)]

    rng = random.Random(4)
    for _ in range(20):
        text = "".join(rng.choice("ab") for _ in range(90))
        ids = chunked(own, text, 20)
        assert "".join(own.text[i] for i in ids) == " " + text
        assert sum(own.score[i] for i in ids) == pytest.approx(best(" " + text))


def test_matrices_combine_associatively():
    own = P.Pieces(MODEL.read_bytes())
    text = " " + "theingation" * 12
    a, b, c = (own.transfer(text, i, i + 40) for i in (0, 40, 80))
    assert P.product(P.product(a, b), c) == P.product(a, P.product(b, c))


def test_documents(spark):
    rng = random.Random(6)
    giant = "".join(rng.choice(PARTS[:3] + PARTS[5:8] + PARTS[9:]) for _ in range(2000))
    texts = ["plain words here", None, "", "a▁b ▁ c▁", giant, "two  words " * 900, giant, "\x00 nul"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    model, library = MODEL.read_bytes(), SentencePieceProcessor(model_file=str(MODEL))
    for chunk in (300, 30):  # one and two levels of matrices
        rows = P.decoded(P.encoded(docs, model, chunk=chunk), model).collect()
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.rec.doc_id] or ""
            assert r.decoded == text and r.rec.ids == r.rec.doc_id
            if "▁" not in text:
                assert r.ids == library.encode(text)
            assert r.n_chunks == (1 if len(text) <= chunk else -(-(len(text) + 1) // chunk))
    assert P.encoded(docs.where("false"), model).count() == 0
    for carry in (None, ["doc_id"]):
        checked = P.encoded(docs, model, carry=carry, chunk=300, verify=True).collect()
        assert len(checked) == len(texts) and all(r.round_trip for r in checked)
