"""What the two vector searches share: usable vectors, top k with ties, hash blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def usable(vector: str) -> Column:
    """True for a vector that is there, has components, and holds no null, NaN or infinite one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(F.col(vector).cast("array<double>"), finite), F.lit(False))


def prepared(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v as doubles, dim) of the rows that take part: with an id and a usable vector."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    return rows.select("id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``; of rows that repeat an id, one."""
    return rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("s")).select("id", "s.v", "s.dim")


def best_per_query(found: DataFrame, k: int, *more: str) -> DataFrame:
    """(query_id, rank, vec_id, score) and ``more``: the ``k`` greatest scores of a query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def top(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` best entries of each query, by score, then by smaller id; queries ascending."""
    order = np.lexsort((ident, -score, query))
    query = query[order]
    begins = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
    return order[place < k]
