"""Accounts to probabilities: posts, split, token sets, similarities, scores, softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from origintrace.constants import CLASS_ORDER, MODELLED_COUNTRIES
from origintrace.operators import clean, minhash, profiles, scores, similarity, split
from origintrace.sources.staging import stage


def account_posts(posts: DataFrame, countries: list[str] = MODELLED_COUNTRIES) -> DataFrame:
    """Cleaned posts with the validation flag and without their text: where every flow starts.

    The cut between training and validation needs a pass of its own, so the cleaned narrow table
    is staged: the texts, most of the bytes, are then read once.
    """
    narrow = clean.clean_posts(posts, countries).drop("tweet_text")
    return split.split_posts(stage(narrow, "account-posts"))


def sets_of(posts: DataFrame, channels: list[str] = list(profiles.CHANNEL_KINDS)) -> DataFrame:
    """Token sets of ``account_posts``, per channel, staged: every similarity job reads them often."""
    return stage(profiles.channel_sets(posts, channels), "sets")


def similar_accounts(posts: DataFrame, channels: list[str] = list(profiles.CHANNEL_KINDS)) -> DataFrame:
    """All pairs of a training and a validation account over the threshold."""
    return similarity.similar_pairs(similarity.index_sets(sets_of(posts, channels)))


def similar_accounts_by_minhash(
    posts: DataFrame, channels: list[str] = list(profiles.CHANNEL_KINDS), n_tables: int = 20
) -> DataFrame:
    """Most of ``similar_accounts``: the pairs that agree in one of ``n_tables`` minima."""
    return minhash.minhash_pairs(sets_of(posts, channels), n_tables)


def _scored(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts, neighbour scores): every account has its own id in the set of channel ``users``."""
    indexed = similarity.index_sets(sets_of(posts))
    accounts = indexed.accounts.where(F.col("channel") == "users").select(
        "is_validation", "sponsoring_country", "userid"
    )
    return accounts, similarity.neighbour_scores(indexed)


def neighbour_scores(posts: DataFrame) -> DataFrame:
    return _scored(posts)[1]


def score_vectors(posts: DataFrame, classes: list[str] = CLASS_ORDER) -> DataFrame:
    accounts, found = _scored(posts)
    return scores.score_vectors(accounts.where("is_validation"), found, classes)


def normalized(posts: DataFrame, classes: list[str] = CLASS_ORDER, size_of: str = "validation") -> DataFrame:
    """Scores over class sizes; ``size_of`` counts ``validation`` or ``training`` accounts."""
    accounts, found = _scored(posts)
    validation = accounts.where("is_validation")
    counted = validation if size_of == "validation" else accounts.where(~F.col("is_validation"))
    vectors = scores.score_vectors(validation, found, classes)
    return scores.normalized_scores(vectors, scores.class_sizes(counted, classes))


def probabilities(posts: DataFrame, classes: list[str] = CLASS_ORDER, size_of: str = "validation") -> DataFrame:
    """One probability vector per validation user of ``account_posts``, in the order of ``classes``."""
    return scores.softmax_scores(normalized(posts, classes, size_of))
