from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from checks.compare import TABLES

from origintrace.llm import oracle, quality_crf, queries, simhash, toxicity


def test_stages_on_odd_documents(spark, odd, none, small):
    for table in (odd, none):
        docs = table
        for name, step in corpus_pipeline.STAGES:
            after = step(spark, docs, small)
            if name != "packing":
                assert after.dtypes == docs.dtypes
            found = after.count()
            if name in ("quality", "toxicity", "near_dedup"):
                assert found <= docs.count()
            if name == "mixing":
                assert found >= docs.count()
            docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_dedup_keeps_the_smallest_id_of_each_component(spark, request, small, which):
    """Against the components, which are held against brute force elsewhere; rows of one id and fingerprint come down to one."""
    docs = request.getfixturevalue(which)
    classes = simhash.near_duplicates(docs, width=3, distance=3).collect()
    want = sorted({(r.component_id, r.kept_fp) for r in classes}, key=str)
    kept = corpus_pipeline.near_dedup(spark, docs, small)
    got = simhash.near_duplicates(kept, width=3, distance=3).collect()
    assert sorted(((r.id, r.fp) for r in got), key=str) == want
    rows = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in rows for r in kept.collect())


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_filters_keep_the_rows_their_scores_say(spark, request, small, which):
    """Row by row: what a fit on the same documents scores on the right side of the threshold, and nothing else."""
    docs = request.getfixturevalue(which)
    known = spark.read.parquet(f"{small}/labels.parquet")
    quality = quality_crf.fit(docs, known).score("text")
    severity = toxicity.fit(docs, known).severity("text")
    rows = docs.select(F.struct("*").alias("row"), quality.alias("quality"), severity.alias("severity")).collect()
    assert len(rows) == docs.count()
    good = Counter(str(r.row) for r in rows if r.quality >= quality_crf.THRESHOLD)
    mild = Counter(str(r.row) for r in rows if r.severity < toxicity.THRESHOLD)
    assert Counter(map(str, corpus_pipeline.quality(spark, docs, small).collect())) == good
    assert Counter(map(str, corpus_pipeline.nontoxic(spark, docs, small).collect())) == mild
    if which == "documents":
        bad = {r.doc_id for r in known.where("quality = 0").collect()}
        assert 0 < sum(good.values()) < len(rows) and 0 < sum(mild.values()) < len(rows)
        kept = {r.row.doc_id for r in rows if r.quality >= quality_crf.THRESHOLD}
        assert len(bad & kept) < len(bad) / 2  # there are eleven such labels at this size


def test_mixing_keeps_every_document_in_its_budget(spark, documents, small):
    mixed = Counter((r.doc_id, r.source) for r in corpus_pipeline.mix(spark, documents, small).select("doc_id", "source").collect())
    plain = {(r.doc_id, r.source) for r in documents.select("doc_id", "source").collect()}
    assert set(mixed) == plain and max(mixed.values()) <= 2


@pytest.mark.parametrize("key", ["op3_toxicity", "op7_quality"])
def test_classifier_queries_on_odd_documents(odd, labels, spark, tmp_path, key):
    odd.drop("a b", "FP").write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.queries()[key](spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and all(r.held_out in (True, False) for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)


def test_run_is_the_stages(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)


@pytest.mark.parametrize("key", sorted(oracle.oracle_sql()))
def test_sql_twins(spark, small, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = queries.queries()[key](spark, small), con.execute(oracle.oracle_sql()[key])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("key", sorted(queries.queries()))
def test_queries_run(spark, small, key):
    assert queries.queries()[key](spark, small).count() > 0
