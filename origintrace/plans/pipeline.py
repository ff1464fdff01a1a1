"""The whole run: raw posts to one country per validation account, by three routes on one split, with accuracy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from origintrace.constants import CLASS_ORDER, MODELLED_COUNTRIES
from origintrace.operators import classify, clean, ensemble, metrics, split, votes
from origintrace.plans import post_level, user_level
from origintrace.sources.staging import stage


@dataclass(frozen=True)
class Results:
    user_probability: DataFrame  # userid, probability
    post_predictions: DataFrame  # sponsoring_country, tweetid, userid, label, prediction, result
    accounts: DataFrame  # sponsoring_country, userid, result: accounts that both sides know
    accuracy: DataFrame  # n, correct, accuracy
    post_f1: DataFrame  # n, f1
    accounts_left: DataFrame  # userid, label, prob_<class>, prediction: every account with a predicted post
    accuracy_left: DataFrame
    embedded_predictions: DataFrame | None  # as post_predictions, with ``result`` an array
    accounts_embedded: DataFrame | None  # as accounts, with the posts' side from embeddings
    accuracy_embedded: DataFrame | None


def run(
    posts: DataFrame, kind: str = "ovr_lr", classes: list[str] = CLASS_ORDER, embeddings: DataFrame | None = None,
    countries: list[str] = MODELLED_COUNTRIES,
) -> Results:
    """Accounts by similarity, posts by text, and posts by embedding, each joined with the accounts.

    ``embeddings`` has sponsoring_country, tweetid, userid and ``embedding``. The posts are cleaned once; their narrow
    part is staged and gives the cut keys, by which posts with text and embeddings are flagged without a join
    to accounts. Votes come from validation posts alone. Every part is a staged table or lazy.
    """
    cleaned = clean.clean_posts(posts, countries)
    narrow = stage(cleaned.drop("tweet_text"), "account-posts")
    cuts = split.staged_cuts(narrow)
    user_probability = stage(user_level.probabilities(split.split_posts(narrow, cuts=cuts), classes), "user-probability")

    with_text = split.split_posts(cleaned, cuts=cuts).select(*post_level.POST, "tweet_text")
    rows = post_level.featured(post_level.prepared(with_text))
    predicted = stage(post_level.predictions(rows, kind), "post-predictions")
    accounts = ensemble.ensemble_inner(post_level.vote_probabilities(predicted, classes), user_probability, classes)
    by_name = predicted.select("sponsoring_country", "userid", F.col("result").alias("prediction"))
    left = ensemble.ensemble_left(by_name, votes.pivot_predictions(by_name, classes), user_probability, classes)

    embedded = of_embeddings = None
    if embeddings is not None:
        flagged = split.split_posts(embeddings.where(F.col("sponsoring_country").isin(countries)), cuts=cuts)
        embedded = stage(classify.predict_embeddings(flagged), "embedded-predictions")
        of_embeddings = ensemble.ensemble_inner(votes.post_vote_probability(embedded, classes), user_probability, classes)
    return Results(
        user_probability, predicted, accounts,
        metrics.accuracy(accounts, "sponsoring_country", "result"),
        metrics.weighted_f1(predicted, "sponsoring_country", "result"),
        left, metrics.accuracy(left, "label", "prediction"),
        embedded, of_embeddings,
        None if of_embeddings is None else metrics.accuracy(of_embeddings, "sponsoring_country", "result"),
    )
