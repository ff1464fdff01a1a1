"""Multinomial naive Bayes over term rows: fitted by one aggregation, applied by a join.

Posts stay rows (tweetid, term, value); no vector is built and no iteration is needed. What the classifier
knows of a term is one row with a number per class.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, functions as F

from origintrace.operators.features import HEAVY_TERMS, with_heavy_apart
from origintrace.sources.staging import stage

#: Classes of a model at most: each is a column of the term table.
MOST_CLASSES = 1000


@dataclass
class TermModel:
    """``terms`` (term, posts, c0, c1, ...): log probability of a term by class; ``priors``: of the classes, by label."""

    labels: list[float]
    priors: list[float]
    terms: DataFrame


def _columns(labels: list[float], prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(len(labels))]


def fit(rows: DataFrame, posts: DataFrame, value: str = "tfidf", smoothing: float = 1.0) -> TermModel:
    """The model of the training posts.

    ``rows`` has (term, label, is_validation, ``value``), the value at least 0, and ``posts`` (label, weight,
    is_validation) with one weight for each label. The vocabulary is that of all rows, training and
    validation: a term of validation posts alone has the smoothed share of a term never seen.
    """
    train = posts.where(~F.col("is_validation"))
    by_class = train.groupBy("label").agg(F.sum("weight").alias("mass"), F.max("weight").alias("weight"))
    classes = by_class.orderBy("label").limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    labels, weights = [c.label for c in classes], [c.weight for c in classes]
    whole = sum(c.mass for c in classes) + smoothing * len(classes)
    sums = _columns(labels, "s")
    counted = ~F.col("is_validation")
    per_term = stage(rows.groupBy("term").agg(
        F.count("*").alias("posts"),
        *[
            F.sum(F.when(counted & (F.col("label") == label), F.col(value) * w).otherwise(0.0)).alias(s)
            for label, w, s in zip(labels, weights, sums)
        ],
    ), "term-sums")
    totals = per_term.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in sums]).first()
    norms = [log(totals[s] + smoothing * max(totals.n, 1)) for s in sums]
    logs = [(F.log(F.col(s) + smoothing) - norm).alias(c) for s, norm, c in zip(sums, norms, _columns(labels, "c"))]
    return TermModel(labels, [log((c.mass + smoothing) / whole) for c in classes], per_term.select("term", "posts", *logs))


def score(model: TermModel, rows: DataFrame, posts: DataFrame, value: str = "tfidf", heavy: int = HEAVY_TERMS) -> DataFrame:
    """``posts`` with ``prediction``, the label of the highest score, and ``log_score``, that score; ties go to the smaller label.

    ``rows`` has (tweetid, term, ``value``), ``posts`` each tweetid once. A post without terms is scored by the
    class shares alone; both columns are null if there were no training posts. The terms in most posts are
    looked up by broadcast, the others by shuffle.
    """
    if not model.labels:
        return posts.withColumns({"log_score": F.lit(None).cast("double"), "prediction": F.lit(None).cast("double")})
    names = _columns(model.labels, "c")
    joined = with_heavy_apart(rows.select("tweetid", "term", value), model.terms, "term", "posts", heavy)
    sums = joined.groupBy("tweetid").agg(*[F.sum(F.col(value) * F.col(c)).alias(c) for c in names])
    scores = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) + F.lit(prior) for c, prior in zip(names, model.priors)])
    scored = posts.join(sums, "tweetid", "left").withColumn("log_score", F.array_max(scores))
    place = F.array_position(scores, F.col("log_score"))
    labels = F.array(*[F.lit(label) for label in model.labels])
    return scored.withColumn("prediction", F.get(labels, (place - 1).cast("int"))).drop(*names)
