"""End to end: CSV dumps in, countries of accounts out."""

import pytest
from pyspark.sql import functions as F

from origintrace.constants import CLASS_ORDER, TWEET_COLUMNS
from origintrace.operators import clean
from origintrace.plans import pipeline
from origintrace.sources import dumps, fixtures
from origintrace.sources.schemas import TWEET_DUMP


def test_dumps_to_accounts(spark, small, tmp_path):
    posts = fixtures.posts(spark, small)
    missing = [c for c in TWEET_COLUMNS if c not in posts.columns]
    (
        posts.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])
        .select(*TWEET_COLUMNS, F.concat("sponsoring_country", F.lit("_082019_tweets_csv_hashed")).alias("table_name"))
        .write.partitionBy("table_name").option("header", True).option("escape", '"').csv(str(tmp_path / "tweets"))
    )
    rows = dumps.accepted(dumps.read_dumps(spark, str(tmp_path / "tweets"), TWEET_DUMP))
    assert {r.release for r in rows.select("release").distinct().collect()} == {"201908"}
    english = clean.in_language(rows)
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.ascii(F.substring(F.md5(F.concat("sponsoring_country", "userid")), i, 1)) % 16).cast("float"))
    place = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col("sponsoring_country")).cast("float")
    embeddings = english.select("sponsoring_country", "tweetid", "userid", F.concat(digits, F.array(place * 9)).alias("embedding"))
    results = pipeline.run(english, kind="nb", embeddings=embeddings)

    probabilities = results.user_probability.collect()
    assert all(sum(r.probability) == pytest.approx(1.0) and len(r.probability) == 4 for r in probabilities)
    accounts = results.accounts.collect()
    assert accounts and {r.result for r in accounts} <= set(CLASS_ORDER)
    assert {r.userid for r in accounts} == {r.userid for r in probabilities}
    n = results.accuracy.first()
    assert n.n == len(accounts) and 0 <= n.accuracy <= 1
    assert results.post_f1.first().n == results.post_predictions.count()

    # The left ensemble has every account with a predicted validation post, and its votes are those of these posts.
    left, posts_of = results.accounts_left.collect(), {}
    for r in results.post_predictions.collect():
        posts_of.setdefault(r.userid, []).append(r)
    assert {r.userid for r in left} == set(posts_of)
    of_account = {r.userid: r.probability for r in probabilities}
    for r in left:
        voted = [p.result for p in posts_of[r.userid]]
        for i, c in enumerate(CLASS_ORDER):
            assert r[f"prob_{c}"] == pytest.approx(0.5 * of_account[r.userid][i] + 0.5 * voted.count(c) / len(voted))
    assert results.accuracy_left.first().n == len(left)

    # The embedding route flags the same accounts, and tells countries apart that are in the embedding.
    assert {(r.sponsoring_country, r.userid) for r in results.embedded_predictions.collect()} == {
        (r.sponsoring_country, r.userid) for r in accounts}
    embedded = results.accounts_embedded.collect()
    assert {(r.sponsoring_country, r.userid) for r in embedded} == {(r.sponsoring_country, r.userid) for r in accounts}
    assert results.accuracy_embedded.first().n == len(embedded)
