"""Posts to predicted countries: text, features, weights and labels, classifier, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from origintrace.constants import CLASS_ORDER, MODELLED_COUNTRIES
from origintrace.operators import classify, clean, features, naive_bayes, split, votes
from origintrace.sources.staging import small_batches, stage

POST = ["sponsoring_country", "tweetid", "userid", "is_validation"]


def flagged_posts(posts: DataFrame, countries: list[str] = MODELLED_COUNTRIES) -> DataFrame:
    """Cleaned posts as (post, text, is_validation), with the split of ``user_level``."""
    cleaned = clean.clean_posts(posts, countries)
    return split.split_posts(cleaned).select(*POST, "tweet_text")


def prepared(posts: DataFrame, **options) -> DataFrame:
    """Posts with their tokens, staged: fitting IDF and transforming both read them."""
    tokens = features.prepare_text(posts, **options)
    with small_batches(posts.sparkSession):
        return stage(tokens.select(*POST, "ntokens"), "prepared")


def featured(tokens: DataFrame, fit_on: str = "all") -> DataFrame:
    """Posts with TF-IDF vector, class weight and label, staged: every iteration of a fit reads them.

    ``fit_on`` says whether IDF, weights and labels come from ``all`` posts or ``train`` posts.
    """
    vectors = features.hashed_model(tokens, fit_on=fit_on).transform(tokens)
    basis = tokens if fit_on == "all" else tokens.where(~F.col("is_validation"))
    rows = classify.with_weight_and_label(vectors, basis)
    return stage(rows.select(*POST, "label", "weight", "tfidf"), "features")


def predictions(rows: DataFrame, kind: str = "ovr_lr") -> DataFrame:
    """Validation posts of ``featured`` with ``result``, the predicted country."""
    labels = rows.select("sponsoring_country", "label").distinct()
    return classify.named(classify.predict(kind, rows), labels)


def nb_term_predictions(posts: DataFrame, fit_on: str = "all") -> DataFrame:
    """Validation posts with ``prediction``, ``log_score`` and ``result``, from naive Bayes on exact TF-IDF terms.

    ``posts`` are those of ``prepared`` before tokens: each has its text, class and split. No text is sent
    to Python and no vector is built.
    """
    basis = posts if fit_on == "all" else posts.where(~F.col("is_validation"))
    labelled = stage(classify.with_weight_and_label(posts, basis).select(*POST, "label", "weight", "tweet_text"), "labelled")
    tf = stage(features.term_frequency(labelled, keep=("label", "is_validation")), "term-frequency")
    heads = labelled.drop("tweet_text")
    counted = heads if fit_on == "all" else heads.where(~F.col("is_validation"))
    rows = stage(features.tfidf_terms(tf, F.lit(counted.count()), fit_on=fit_on), "term-weights")
    model = naive_bayes.fit(rows, heads)
    scored = naive_bayes.score(model, rows.where("is_validation"), heads.where("is_validation"))
    labels = heads.select("sponsoring_country", "label").distinct()
    return classify.named(scored.drop("weight", "is_validation"), labels)


def vote_probabilities(predicted: DataFrame, classes: list[str] = CLASS_ORDER) -> DataFrame:
    """Vote shares per account, from predictions with a single ``result``."""
    return votes.post_vote_probability(predicted.withColumn("result", F.array("result")), classes)
