"""The registered queries on the smallest tables: against their SQL, and by their columns and rows."""

import math
import pathlib

import duckdb
import pytest

from evoked_spark.llm import registry

DIR = pathlib.Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1_sentencepiece": ["doc_id"],
    "op3_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_substring_dedup": ["doc_id"],
    "op9_hmm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(set(COLUMNS) & set(registry.ORACLE)))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, str(DIR))
    want = db.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name] and sorted(got.columns) == sorted(names)
    rows = lambda values, of: sorted((tuple(r[of.index(c)] for c in sorted(of)) for r in values), key=repr)
    mine, theirs = rows(map(tuple, got.collect()), got.columns), rows(want.fetchall(), names)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(registry.ORACLE)))
def test_query_has_one_row_per_document(spark, db, name):
    got = registry.QUERIES[name](spark, str(DIR))
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    want = sorted(r[0] for r in db.execute("SELECT doc_id FROM documents").fetchall())
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.QUERIES}) == list(range(1, 14))
