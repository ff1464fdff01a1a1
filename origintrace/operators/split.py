"""Validation split by account, reproducible on any engine and any partitioning.

Accounts of a country are ordered by an md5 key, and taken until their posts reach the wanted
share; the account that crosses the line is taken too, and at least one always is. The accounts
taken are thus all those up to one key, so the split is fully described by one cut key per
country, and flagging a post is an expression on its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from origintrace.constants import SEED, VALIDATION_SHARE
from origintrace.sources.staging import broadcast_if_small, stage


def order_key(country: Column, userid: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", country, F.coalesce(userid, F.lit("")), F.lit(str(seed))))


def posts_per_user(posts: DataFrame) -> DataFrame:
    """Posts (non-null ids) of every account."""
    return posts.groupBy("sponsoring_country", "userid").agg(F.count("tweetid").alias("n_posts"))


def cut_keys(
    users: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED, bucket_digits: int = 3
) -> DataFrame:
    """The last validation key of every country, from ``posts_per_user``, staged, as it is read twice.

    Accounts are first summed per key prefix (16 ** bucket_digits buckets a country); only the
    accounts of the one bucket that holds the cut are sorted.
    """
    key = order_key(F.col("sponsoring_country"), F.col("userid"), seed)
    keyed = users.withColumn("key", key).withColumn("bucket", F.substring("key", 1, bucket_digits))
    in_country = Window.partitionBy("sponsoring_country")
    earlier = in_country.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        keyed.groupBy("sponsoring_country", "bucket")
        .agg(F.sum("n_posts").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("cap", F.floor(F.lit(share) * F.sum("n").over(in_country)))
    )
    # Of the buckets that begin below the cap the last one holds the cut. Where none does (cap 0)
    # the cut is in the first bucket, at its first account.
    cut_bucket = buckets.groupBy("sponsoring_country").agg(
        F.coalesce(
            F.max(F.when(F.col("before") < F.col("cap"), F.struct("bucket", "before", "cap"))),
            F.min(F.struct("bucket", "before", "cap")),
        ).alias("cut")
    ).select("sponsoring_country", "cut.*")
    in_order = in_country.orderBy("key")
    running = F.sum("n_posts").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        keyed.join(broadcast_if_small(cut_bucket, "cut-buckets"), ["sponsoring_country", "bucket"])
        .withColumn("start", F.col("before") + F.coalesce(running, F.lit(0)))
        .withColumn("rn", F.row_number().over(in_order))
        .where((F.col("start") < F.col("cap")) | (F.col("rn") == 1))
        .groupBy("sponsoring_country")
        .agg(F.max("key").alias("cut_key"))
    )


def flag_validation(rows: DataFrame, cuts: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows with a country and an account, plus ``is_validation``.

    ``cuts`` has one row per country of the fixed country list, so it is safe to broadcast. An
    account without id is never validation.
    """
    key = order_key(F.col("sponsoring_country"), F.col("userid"), seed)
    flag = F.coalesce(F.col("userid").isNotNull() & (key <= F.col("cut_key")), F.lit(False))
    return (
        rows.join(F.broadcast(cuts), "sponsoring_country", "left")
        .withColumn("is_validation", flag)
        .drop("cut_key")
    )


def split_users(users: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """Every account of ``posts_per_user`` with its flag."""
    users = stage(users, "posts-per-user")
    return flag_validation(users, cut_keys(users, share, seed), seed)


def staged_cuts(posts: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """The cut keys of cleaned posts, one row per country, written: every table of the same accounts can be flagged by them."""
    return stage(cut_keys(stage(posts_per_user(posts), "posts-per-user"), share, seed), "cut-keys")


def split_posts(posts: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED, cuts: DataFrame | None = None) -> DataFrame:
    """Every cleaned post with the flag of its account; ``cuts`` are those of the same posts, if there already."""
    return flag_validation(posts, staged_cuts(posts, share, seed) if cuts is None else cuts, seed)
