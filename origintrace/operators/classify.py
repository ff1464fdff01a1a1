"""Class weights, labels, and the post classifiers."""

from __future__ import annotations

from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from origintrace.sources.staging import broadcast_if_small, stage


def class_counts(posts: DataFrame) -> DataFrame:
    """Posts per class; one row per class."""
    return posts.groupBy("sponsoring_country").agg(F.count("*").alias("n"))


def class_weights(posts: DataFrame) -> DataFrame:
    """Balanced weights: total / (classes * posts of the class)."""
    every = Window.partitionBy()  # over the rows of class_counts: one per class
    return class_counts(posts).select(
        "sponsoring_country", "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight")
    )


def label_index(posts: DataFrame) -> DataFrame:
    """Class labels 0, 1, ... by falling number of posts, ties by name."""
    order = Window.orderBy(F.desc("n"), "sponsoring_country")  # over one row per class
    return class_counts(posts).select(
        "sponsoring_country", (F.row_number().over(order) - 1).cast("double").alias("label")
    )


def with_weight_and_label(posts: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """Posts with ``weight`` and ``label``, both from ``fitted_on`` (all posts by default).

    One row per class is joined: broadcast behind a check of how many there are, so posts are not shuffled.
    """
    basis = posts if fitted_on is None else fitted_on
    per_class = class_weights(basis).select("sponsoring_country", "weight").join(label_index(basis), "sponsoring_country")
    return posts.join(broadcast_if_small(per_class, "classes"), "sponsoring_country")


def logistic_regression(features: str = "tfidf") -> LogisticRegression:
    return LogisticRegression(featuresCol=features, weightCol="weight", maxIter=10, tol=1e-6, fitIntercept=True)


def classifier(kind: str, features: str = "tfidf", parallelism: int = 4):
    """One of the post classifiers: ``lr``, ``ovr_lr``, ``ovr_svc``, ``nb``."""
    if kind == "lr":
        return logistic_regression(features)
    if kind == "nb":
        return NaiveBayes(featuresCol=features, weightCol="weight")
    binary = {
        "ovr_lr": logistic_regression(features),
        "ovr_svc": LinearSVC(featuresCol=features, weightCol="weight", maxIter=10, regParam=0.1),
    }[kind]
    return OneVsRest(featuresCol=features, weightCol="weight", classifier=binary, parallelism=parallelism)


def predict(kind: str, rows: DataFrame, features: str = "tfidf", parallelism: int = 4) -> DataFrame:
    """Fit on the training posts, score the validation posts.

    ``rows`` has is_validation, label, weight and the feature vector, and should be staged: a fit
    reads it once per iteration.
    """
    train = rows.where(~F.col("is_validation")).select("label", "weight", features)
    model = classifier(kind, features, parallelism).fit(train.persist())
    train.unpersist()
    return model.transform(rows.where("is_validation")).select(
        "sponsoring_country", "tweetid", "userid", "label", "prediction"
    )


def named(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with ``result``, the name of the predicted class; ``labels`` is ``label_index``."""
    names = labels.select(F.col("label").alias("prediction"), F.col("sponsoring_country").alias("result"))
    return predictions.join(broadcast_if_small(names, "class-names"), "prediction", "left")


def predict_embeddings(
    rows: DataFrame, hidden: list[int] = [32], epochs: int = 10, seed: int = 42
) -> DataFrame:
    """Neural classifier on ready-made embeddings; ``result`` is the predicted class in an array, for ``votes``.

    ``rows`` has tweetid, userid, sponsoring_country, is_validation and ``embedding``, all of one length.
    Labels are those of ``label_index``.
    """
    labels = stage(label_index(rows), "labels")
    labelled = rows.join(broadcast_if_small(labels, "label-of-class"), "sponsoring_country")
    vectors = labelled.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    size = rows.select(F.max(F.size("embedding"))).first()[0]
    net = MultilayerPerceptronClassifier(layers=[size, *hidden, labels.count()], maxIter=epochs, seed=seed)
    train = vectors.where(~F.col("is_validation")).select("label", "features").persist()
    model = net.fit(train)
    train.unpersist()
    scored = named(model.transform(vectors.where("is_validation")), labels)
    return scored.select("sponsoring_country", "tweetid", "userid", "label", "prediction", F.array("result").alias("result"))
