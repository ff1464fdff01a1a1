"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_column: str | Column, folds: int = 5) -> Column:
    """Remainder of the CRC-32 of an id as text; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds if isinstance(id_column, str) else \
        F.crc32(id_column.cast("string").cast("binary")) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, hold_out: int, bound: int) -> DataFrame:
    """(text, label) of about ``bound`` labelled documents at most, never of fold ``hold_out`` of five.

    Ids are taken by their 63-bit hash, so the sample does not depend on partitioning; the least hash is always
    taken, so a sample of any number of labels has one at least. Ids labelled several times take
    their greatest label; null ids and null labels are left out. The sampled labels, at most about ``bound``
    rows, are broadcast, so documents are not shuffled.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id") != hold_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    )
    place = F.xxhash64("doc_id", F.lit(17)).bitwiseAND((1 << 63) - 1)
    n, least = known.agg(F.count("*"), F.min(place)).first()
    picked = known if n <= bound else known.where(place <= max(int(bound / n * (1 << 63)), least))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    joined = texts.join(F.broadcast(picked), "doc_id")
    return joined.select(F.col("__text").alias("text"), F.col("__label").alias("label"))
