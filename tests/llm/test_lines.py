"""Line dedup against brute force and against the query's SQL."""

import random
import string
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from evoked_spark.llm import lines as lines_module
from evoked_spark.llm import registry
from evoked_spark.llm.lines import Shard, perfect_hash, without_common_lines

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_force(rows, least_chars=40, least_docs=5):
    """[(id, text)] -> [(id, n_lines, n_dropped, kept_text)]; each row counts as a document."""
    key = lambda line: line.strip(BLANKS).translate(FOLD)
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        own = lambda k: len(k) >= least_chars and len(holders[k]) >= least_docs and i != max(holders[k], key=order)
        kept = [x for x in all_lines if not own(key(x))]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def as_tuples(df, id_col="doc_id"):
    return sorted(((r.rec[id_col], r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = (rng.integers(-(2**63), 2**63 - 1, n) for _ in range(2))
        h1[: n // 2] = h1[:1] if n else 0  # first hashes that collide, the second ones differ
        bits, sizes, slots = perfect_hash(h1, h2)
        assert sorted(slots.tolist()) == list(range(n))
        prints = np.zeros(n, np.int64)
        prints[slots] = h2
        shard = Shard(bits, sizes, prints)
        assert shard.find(h1, h2).tolist() == slots.tolist()
        assert (shard.find(h1, h2 + 1) == -1).all()


def corpus(rng):
    common = ["The " + " ".join(rng.choice(["alpha", "beta", "gamma", "Ünder"]) for _ in range(rng.randrange(5, 14))) for _ in range(60)]
    rare = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(0, 20)))
    rows = []
    for i in range(400):
        body = [rng.choice(["", " ", "\t\x0b"]) + rng.choice([x, x.upper(), x]) + rng.choice(["", "\r", " "]) for x in rng.sample(common, rng.randrange(0, 6))]
        body += ["One line that is in most of the documents of this table."] * (rng.random() < 0.6)
        body += [rare() for _ in range(rng.randrange(0, 5))]
        rng.shuffle(body)
        rows.append((i, "\n".join(body)))
    rows += [(None, rows[3][1]), (None, None), (7, rows[7][1]), (7, rows[8][1]), (500, ""), (501, "\n\n"), (502, "é" * 40), (503, "É" * 40)]
    rows += [(600 + i, "x" * 39 + "\n" + "é" * 40 + "\n" + "Y" * 40 + "\n" + "y" * 40) for i in range(5)]
    return rows


@pytest.mark.parametrize("shard_lines", [65_536, 4])
def test_matches_brute_force(spark, monkeypatch, shard_lines):
    monkeypatch.setattr(lines_module, "SHARD_LINES", shard_lines)
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_force(rows)
    assert as_tuples(without_common_lines(docs)) == want
    assert sum(r[2] for r in want) > 300


def test_ids_of_text_extra_columns_and_empty_table(spark):
    rows = [(f"d{i}", "Some line that is long enough to be compared with others\nown", "n", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "name string, body string, h1 string, n_lines long")
    out = without_common_lines(docs, "name", "body")
    assert as_tuples(out, "name") == brute_force([(r[0], r[1]) for r in rows])
    assert out.select("rec.*").columns == docs.columns
    assert without_common_lines(docs.where("false"), "name", "body").count() == 0


def test_very_long_text(spark):
    long = "\n".join(f"line number {i} of a text that has a great many lines" for i in range(60_000))
    rows = [(i, long if i < 5 else "short") for i in range(7)]
    got = as_tuples(without_common_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [r[2] for r in got] == [60_000] * 4 + [0] * 3 and got[4][3] == long and got[0][3] == ""


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    got = registry.QUERIES["op12_line_dedup"](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(registry.ORACLE["op12_line_dedup"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
