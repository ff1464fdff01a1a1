from pathlib import Path

from pyspark.sql import functions as F

from origintrace.operators import classify
from origintrace.plans import post_level
from origintrace.sources import fixtures
from origintrace.sources.staging import broadcast_if_small, shared_folder, stage, temporary_tables


def test_staged_tables_are_gone_after_a_flow(spark, small):
    folder = Path(shared_folder(spark), "origintrace", spark.sparkContext.applicationId)
    kept = stage(spark.range(3), "kept")
    before = set(folder.iterdir())
    with temporary_tables(spark):
        assert post_level.prepared(fixtures.docs(spark, small)).count() > 0
        assert set(folder.iterdir()) - before
    assert set(folder.iterdir()) == before and kept.count() == 3


def test_only_small_tables_are_marked_for_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    big, ids = spark.range(1000), spark.range(50)
    assert "strategy=broadcast" in plan(big.join(broadcast_if_small(ids, "small"), "id"))
    assert "strategy=broadcast" not in plan(big.join(broadcast_if_small(ids, "large", rows=49), "id"))


def test_classes_are_joined_without_a_shuffle_of_posts(spark, small):
    posts = stage(fixtures.docs(spark, small), "posts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = classify.with_weight_and_label(posts, posts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_text_plans_do_not_repartition(spark, small):
    plan = fixtures.docs(spark, small).select(F.length("tweet_text"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan
