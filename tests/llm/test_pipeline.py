"""The stages against brute-force versions on the smallest tables."""

import gc
import re
from collections import defaultdict

import corpus_pipeline
from evoked_spark.llm.quality import with_signals
from tests.llm.test_simhash import plain_components, plain_fingerprint

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        out = stage(spark, docs, DIR)
        if name != "tokenize":
            assert out.columns == docs.columns
        out.write.parquet(path)
        before = docs.select("doc_id", "text", "source").collect()
        docs = spark.read.parquet(path)
        kept[name] = (before, docs.collect())

    before, after = kept["quality rules"]
    failed = {r.rec.doc_id for r in with_signals(spark.read.parquet(f"{DIR}/documents.parquet")).where("base_failed").collect()}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= failed

    before, after = kept["exact dedup"]
    largest = {}
    for r in before:
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert sorted(r.doc_id for r in after) == sorted(largest.values())

    before, after = kept["near dedup"]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in before}
    root = plain_components(set(prints.values()))
    groups = defaultdict(list)
    for i, p in prints.items():
        groups[root[p]].append(i)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())

    before, after = kept["mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, out = sum(size(r.text) for r in before), sum(size(r.text) for r in after)
    assert 1.5 * total - 2 * max(size(r.text) for r in before) <= out <= 1.5 * total

    before, after = kept["tokenize"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before) and all(r.round_trip for r in after)


def test_results_of_stages_stay_readable(spark):
    """The same stage twice, stages on results that weren't written, and tables that go with their result."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    one = corpus_pipeline.exact_dedup(spark, docs, DIR)
    two = corpus_pipeline.exact_dedup(spark, docs, DIR)
    chained = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, docs, DIR), DIR)
    more = corpus_pipeline.mix_sources(spark, docs, DIR)
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in (one, two, chained, more)]
    assert ids[0] == ids[1] and set(ids[2]) <= set(ids[0]) and ids[3]
    folders = [s[1] for s in corpus_pipeline._owned.stages]
    del one, two, chained, more
    gc.collect()
    corpus_pipeline._owned.clear_unused()
    assert len(folders) >= 4 and not corpus_pipeline._owned.stages
