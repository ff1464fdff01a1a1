"""Views that give the test tables the shape of posts and labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from origintrace.constants import COUNTRIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bracket_list(value: str) -> Column:
    """The distinct values of a field of ``listed``, sorted, as ``[a, b]``."""
    joined = F.array_join(F.sort_array(F.array_distinct(F.col(f"listed.{value}"))), ", ")
    return F.concat(F.lit("["), joined, F.lit("]"))


def _text(value: Column) -> Column:
    return value.cast("string")


#: Columns of ``posts``, in order.
POST_COLUMNS = [
    "sponsoring_country", "tweetid", "userid", "tweet_text", "tweet_language", "user_profile_url", "in_reply_to_userid",
    "in_reply_to_tweetid", "quoted_tweet_tweetid", "retweet_userid", "retweet_tweetid", "hashtags", "urls", "user_mentions",
]


def post_heads(spark: SparkSession, sf_dir: str, tags: DataFrame | None = None) -> DataFrame:
    """Posts without text and language, but with ``text_id``, the document that has both.

    An order is a post, a customer an account, a region a country. ``tags`` has rows with ``o_orderkey``, joined with
    the posts of that order; its other columns come last.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", _text(F.col("l_suppkey")).alias("supplier")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    # The lines of an order are one list, made after their shuffle: three, made before it too, cost twice the time, and a set
    # half as much again as a list. Values are made distinct where they are joined.
    lists = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.collect_list(F.struct("p_brand", "p_type", "supplier")).alias("listed"))
        .select(
            "l_orderkey",
            _bracket_list("p_brand").alias("list_brands"),
            _bracket_list("p_type").alias("list_types"),
            _bracket_list("supplier").alias("list_suppliers"),
        )
    )
    n_documents = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    region = F.col("r_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (key % n_documents).alias("text_id"))
    return (
        (orders if tags is None else orders.join(tags, "o_orderkey"))
        .join(
            table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
            cust == F.col("c_custkey"),
        )
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(lists, key == F.col("l_orderkey"), "left")
        .select(
            F.when(region == "EUROPE", "russia")
            .when(region == "ASIA", "china")
            .when(region == "AFRICA", "iran")
            .when(region == "AMERICA", "venezuela")
            .otherwise("spain")
            .alias("sponsoring_country"),
            _text(key).alias("tweetid"),
            _text(cust).alias("userid"),
            "text_id",
            F.concat(F.lit("http://u.example/"), "c_mktsegment").alias("user_profile_url"),
            F.when(key % 3 == 0, _text(cust + 1)).alias("in_reply_to_userid"),
            F.when(key % 3 == 0, _text(key - 1)).alias("in_reply_to_tweetid"),
            F.when(key % 5 == 0, _text(key - 2)).alias("quoted_tweet_tweetid"),
            F.when(key % 4 == 0, _text(cust + 2)).alias("retweet_userid"),
            F.when(key % 4 == 0, _text(key - 4)).alias("retweet_tweetid"),
            F.when(key % 7 == 0, "[]").otherwise(F.col("list_brands")).alias("hashtags"),
            F.when(key % 11 == 0, "[]").otherwise(F.col("list_types")).alias("urls"),
            F.col("list_suppliers").alias("user_mentions"),
            *([] if tags is None else [c for c in tags.columns if c != "o_orderkey"]),
        )
    )


def with_texts(spark: SparkSession, sf_dir: str, heads: DataFrame) -> DataFrame:
    """The posts of ``post_heads`` with text and language, the widest of all columns: what comes after should not shuffle them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tweet_text"), F.col("lang").alias("tweet_language"))
    tags = [c for c in heads.columns if c not in POST_COLUMNS and c != "text_id"]
    return heads.join(documents, F.col("text_id") == F.col("doc_id"), "left").select(*POST_COLUMNS, *tags)


def posts(spark: SparkSession, sf_dir: str, tags: DataFrame | None = None) -> DataFrame:
    """An order is a post, a customer an account, a region a country; every document is a text. For ``tags`` see ``post_heads``."""
    return with_texts(spark, sf_dir, post_heads(spark, sf_dir, tags))


def dump_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table each order would arrive in: country by nation, release by month.

    Months 8 and 11 give month-first release tokens, and January the two misnamed tables.
    """
    nation_country = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("c_nationkey") % len(COUNTRIES) + 1)
    month = F.month("o_orderdate")
    release = (
        F.when(month.isin(8, 11), F.concat(F.lpad(_text(month), 2, "0"), F.lit("2019")))
        .when((month == 1) & F.col("country").isin("bangladesh", "venezuela"), "linked")
        .otherwise(F.concat(F.lit("2019"), F.lpad(_text(month), 2, "0")))
    )
    kind = F.when(F.col("o_orderstatus") == "F", "users").otherwise("tweets")
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        .join(
            table(spark, sf_dir, "customer").select("c_custkey", nation_country.alias("country")),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .select(
            F.col("o_orderkey"),
            F.concat_ws("_", "country", release, kind, F.lit("csv"), F.lit("hashed")).alias("table_name"),
        )
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as a row of an account dump, with the raw table it would arrive in."""
    key = F.col("c_custkey")
    country = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("c_nationkey") % len(COUNTRIES) + 1)
    month = F.lpad(_text(key % 12 + 1), 2, "0")
    release = F.when((key % 12 + 1).isin(8, 11), F.concat(month, F.lit("2019"))).otherwise(F.concat(F.lit("2019"), month))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return customers.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        _text(key).alias("userid"),
        F.col("c_name").alias("user_display_name"),
        F.when(key % 4 != 0, F.concat(F.lit("u"), _text(key))).alias("user_screen_name"),
        F.col("n_name").alias("user_reported_location"),
        F.concat(F.lit('said "'), "c_mktsegment", F.lit('",\nthen left')).alias("user_profile_description"),
        F.concat(F.lit("http://u.example/"), "c_mktsegment").alias("user_profile_url"),
        _text(key % 1000).alias("follower_count"),
        _text(key % 77).alias("following_count"),
        F.concat(F.lit("2015-01-"), F.lpad(_text(key % 28 + 1), 2, "0")).alias("account_creation_date"),
        F.lit("en").alias("account_language"),
        F.concat_ws("_", country, release, F.lit("users_csv_hashed")).alias("table_name"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a post and its language the class to predict."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("sponsoring_country"),
        _text(F.col("doc_id")).alias("tweetid"),
        F.col("source").alias("userid"),
        F.col("text").alias("tweet_text"),
        (F.substring(F.md5(_text(F.col("doc_id"))), 1, 1) == "0").alias("is_validation"),
    )


def rule_prediction(post_id: Column, truth: Column, classes: list[str]) -> Column:
    """A stand-in prediction any engine can compute: the md5 of the id decides.

    About a third of the rows get the class the last hex digit picks, the rest the true one.
    """
    digest = F.md5(post_id)
    first, last = F.ascii(F.substring(digest, 1, 1)), F.ascii(F.substring(digest, 32, 1))
    picked = F.element_at(F.array(*[F.lit(c) for c in classes]), last % len(classes) + 1)
    return F.when(first % 3 == 0, picked).otherwise(truth)
