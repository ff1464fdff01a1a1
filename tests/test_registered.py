"""Every registered query: equal to its SQL twin, and planned without the nodes that do not scale."""

import contextlib
import io
import re

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from checks import oracle, queries as registered
from checks.compare import TABLES, rows

SQL = oracle.oracle_sql()
QUERIES = registered.queries()
#: Stems of tokens in their order, and what is built on them; files looked at one by one.
STEMMED = {"prepare_text_stemmed", "hashing_tf", "tfidf_hashed", "clf_lr", "clf_ovr_lr", "clf_ovr_svc", "clf_nb"}
FILES = {"ingest_csv", "ingest_quarantine", "ingest_manifest", "combined_users"}
PYTHON = {"ArrowEvalPython": STEMMED, "MapInPandas": FILES}


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture
def staged(monkeypatch):
    """The plans of all tables written to Parquet meanwhile: what a query runs before its last segment."""
    plans, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **kwargs):
        plans.append(plan(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return plans


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, small, con, staged, key):
    df = QUERIES[key](spark, small)
    for text in [*staged, plan(df)]:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "BatchEvalPython" not in text and "FlatMapGroupsInPandas" not in text
        for node, allowed in PYTHON.items():
            assert key in allowed or node not in text
    got = df.toPandas()
    if key in SQL:
        want = con.execute(SQL[key]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_segments_are_seen(spark, small, staged):
    QUERIES["exact_jaccard_users"](spark, small)
    assert len(staged) >= 5 and any("SortMergeJoin" in p or "BroadcastHashJoin" in p for p in staged)


@pytest.mark.parametrize("key", ["sentence_counts", "tokenize", "stopword_filter", "prepare_text", "prepare_text_stemmed"])
def test_texts_are_not_shuffled(spark, small, staged, key):
    """Operators on the text of a post run in the task that scans it."""
    text = plan(QUERIES[key](spark, small))
    assert not staged and "Exchange" not in text


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["userid", "prob_russia", "prob_china", "prob_iran", "prob_venezuela"]
    for r in df.collect():
        assert sum(r[1:]) == pytest.approx(1.0, abs=1e-5)


def test_text_filter_reaches_the_scan(spark, small):
    text = plan(QUERIES["filter_lang"](spark, small))
    assert "EqualTo(lang,en)" in text and "n_chars" not in text


def test_votes_are_those_of_all_accounts(spark, small):
    """Training accounts take part in the wide table and in the left-join ensemble, the latter by their votes alone."""
    accounts = {r.userid for r in QUERIES["split_users"](spark, small).collect()}
    assert {r.userid for r in QUERIES["pivot_predictions"](spark, small).collect()} == accounts
    assert {r.userid for r in QUERIES["ensemble_left"](spark, small).collect()} == accounts


@pytest.mark.parametrize("key", ["combine_posts", "ingest_csv"])
def test_texts_are_not_shuffled_by_post(spark, small, staged, key):
    """A document is the text of many posts: only documents may be dealt with their text, as (id, text, language)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [*staged, plan(QUERIES[key](spark, small)), *staged]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [columns for text in plans for columns in re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", text)]
    assert dealt and all(c.count("#") <= 3 for c in dealt if re.search(r"\b(tweet_)?text#", c))
