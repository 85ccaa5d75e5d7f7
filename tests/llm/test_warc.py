"""Archives: round trip through files, and audits of damaged replicas."""

import duckdb
from pyspark.sql import functions as F

from evoked_spark.llm import registry, warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, n=150):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é\r\n\r\n" + "z" * (i % 40)) for i in range(n)] + [(None, None, None), (7, "http://x/7", ""), (7, "http://x/7", "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_files_hold_the_records(spark, tmp_path):
    p = pages(spark)
    warc.write_archives(p, str(tmp_path / "w"), 3)
    back = warc.read_archives(spark, str(tmp_path / "w")).collect()
    want = sorted((r.url or "", r.html or "") for r in p.collect())
    assert sorted((r.url, r.html) for r in back) == want
    spans = sorted((r.start, r.stop, r.url) for r in back)
    ours = sorted((r.start, r.stop) for r in warc.leaves(p, 3).collect())
    assert [s[:2] for s in spans] == ours


def verdicts(found):
    return sorted((r.page_id, r.verdict) for r in found.where("verdict <> 'same'").collect())


def test_audit_finds_the_damage(spark):
    p = pages(spark)
    bad = p.withColumn("html", F.when(F.col("page_id").isin(3, 77), F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    found = warc.audited(warc.leaves(p, 2), warc.leaves(bad, 2))
    assert found.count() == p.count() and verdicts(found) == [(3, "differs"), (77, "differs")] and found.where("moved").count() == 0
    assert verdicts(warc.audited(warc.leaves(p, 2), warc.leaves(p, 2))) == []


def test_each_kind_of_damage_names_exactly_its_record(spark):
    p = pages(spark, 700).where("page_id is not null and html <> ''")
    html = F.when(F.col("page_id") == 3, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    for bad, want in (
        (p.withColumn("html", html), [(3, "differs")]),  # one character longer
        (p.where("page_id <> 3"), [(3, "missing")]),
        (p.where("page_id <> 0"), [(0, "missing")]),  # the first record
        (p.union(spark.createDataFrame([(None, "http://new", "n"), (1000, "http://x/1000", "n")], SCHEMA)), [(None, "extra"), (1000, "extra")]),
        (p.where("page_id not between 100 and 400"), [(i, "missing") for i in range(100, 401)]),
    ):
        found = warc.audited(warc.leaves(p, 1), warc.leaves(bad, 1))
        got = [(r.page_id, r.verdict) for r in found.where("verdict <> 'same'").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert found.where("moved").count() > 200 or bad.count() == p.count() - 1


def test_only_differing_branches_are_compared(spark):
    p = pages(spark, 600).where("page_id is not null and html <> ''")
    s = warc.Scratch(spark)
    ours, theirs = (s.save(warc.leaves(x, 1)) for x in (p, p.where("page_id <> 300")))
    h = warc.height_of(ours, theirs)
    a, b = warc.tree(ours, s, h), warc.tree(theirs, s, h)
    assert h == 3 and [x.count() for x in a][-1] == 1
    for x, y in zip(a[1:], b[1:]):  # of each level at most the range of the record, and one it divided, changed
        kept = x.join(y, ["archive", "node", "digest"], "left_semi").count()
        assert x.count() - kept <= 2


def test_missing_tail_edge_rows_and_empty(spark):
    p = pages(spark, 40).where("page_id is not null and html <> ''")
    found = warc.audited(warc.leaves(p, 1), warc.leaves(p.where("page_id < 39"), 1))
    assert verdicts(found) == [(39, "missing")]
    none = p.where("false")
    assert warc.audited(warc.leaves(none, 1), warc.leaves(none, 1)).count() == 0
    assert warc.audited(warc.leaves(p, 1), warc.leaves(none, 1)).where("verdict = 'missing'").count() == p.count()
    assert warc.files_needed(none) == 1
    long = spark.createDataFrame([(1, "u", "x" * 3_000_000), (1, "u", "x" * 3_000_000), (2, None, "y")], SCHEMA).withColumn("digest", F.lit("other")).withColumn("verdict", F.lit(1))
    other = long.withColumn("html", F.when(F.col("page_id") == 1, F.concat(F.lit("z"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    assert verdicts(warc.audited(warc.leaves(long, 1), warc.leaves(other, 1))) == [(1, "differs")] * 2


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    got = registry.QUERIES["op2_warc_fixity"](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    want = con.execute(registry.ORACLE["op2_warc_fixity"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
