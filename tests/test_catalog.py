"""Every query of the signal operators against its SQL in DuckDB, on the smallest tables."""

import math
import pathlib

import duckdb
import pytest

from evoked_spark import catalog

DIR = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, str(DIR))
    want = db.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows(got.collect(), got.columns), rows(want.fetchall(), names)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for x, y in zip(a, b)), (a, b)


@pytest.fixture(scope="module")
def cut_short(tmp_path_factory):
    """Tables whose last block has one channel, which isn't EEG, in a recording with two markers and two codes."""
    folder = tmp_path_factory.mktemp("cut_short")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW o AS SELECT * FROM '{DIR}/orders.parquet'; CREATE VIEW l AS SELECT * FROM '{DIR}/lineitem.parquet'")
    two = "row_number() OVER (ORDER BY l_orderkey, l_linenumber) <= 2"
    con.execute(f"COPY (SELECT * FROM '{DIR}/embeddings.parquet' WHERE vec_id < 256) TO '{folder}/embeddings.parquet'")
    con.execute(f"COPY (SELECT * FROM o WHERE o_custkey <> 1 UNION ALL BY NAME SELECT * REPLACE (1 AS o_custkey, -1 AS o_orderkey) FROM (SELECT * FROM o LIMIT 1)) TO '{folder}/orders.parquet'")
    con.execute(f"COPY (SELECT * FROM l UNION ALL BY NAME SELECT * REPLACE (-1 AS l_orderkey, 1 AS l_linenumber, 11 AS l_quantity) FROM (SELECT * FROM l QUALIFY {two})) TO '{folder}/lineitem.parquet'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con, folder


@pytest.mark.parametrize("name", ["agg5_average_reference", "out3_whole_rows"])
def test_query_equals_sql_where_the_last_block_has_no_eeg_channel(spark, cut_short, name):
    con, folder = cut_short
    got, want = catalog.QUERIES[name](spark, str(folder)), con.execute(catalog.ORACLE[name])
    mine, theirs = rows(got.collect(), got.columns), rows(want.fetchall(), [d[0] for d in want.description])
    assert len(mine) == len(theirs) > 0
    for a, b in zip(mine, theirs):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DIR)).count() > 0
