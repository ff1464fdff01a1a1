"""Approximate nearest neighbours through balanced posting lists.

Centroids are fitted on a bounded sample; a neighbourhood graph over them is searched in memory. A vector goes
to its nearest list and, near a boundary, to the other lists that are about as near. A query takes the lists
whose centroid is not much farther than the nearest one. Its first lists give it a k-th score; the others
then return only what reaches that. Large lists are cut into parts, so copies of one vector fill no task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from origintrace.llm.vectors import best_per_query, prepared, query_rows, top
from origintrace.sources.staging import stage

#: Vectors to fit centroids on, at most (about); lists at most; rounds of balanced clustering.
SAMPLE, MAX_LISTS, CLUSTERING = 20_000, 4096, 8
#: Neighbours of a centroid in the graph; centroids that a vector and a query look at.
DEGREE, ASSIGN_WIDTH, QUERY_WIDTH = 16, 12, 128
#: A vector's further lists: squared distance up to so many times the least, this many lists at most.
BOUNDARY, REPLICAS = 1.10, 4
#: A query's lists: squared distance up to so many times the least, at least so many lists. Lists that give it
#: a k-th score first.
PROBE, LEAST_LISTS, FIRST_LISTS = 1.35, 48, 6
#: Vectors of one part of a list, about; queries compared with it at a time.
PART, ASKED = 1024, 512
#: Lengths of vectors with lists of their own at most, besides the commonest, and vectors that such a length has
#: at least; vectors of other lengths are compared with all of their length.
LENGTHS, OWN_LISTS = 16, 4096


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0)


@dataclass(frozen=True)
class Centroids:
    points: np.ndarray
    graph: np.ndarray
    norm: float  # the greatest of all vectors

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one more component, so that all have the greatest norm: near then means a large product."""
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)

    def directed(self, q: np.ndarray) -> np.ndarray:
        """Queries at the greatest norm, without the added component."""
        scaled = q * (self.norm / np.linalg.norm(q, axis=1))[:, None]
        return np.concatenate([scaled, np.zeros((len(q), 1))], axis=1)

    def near(self, x: np.ndarray, width: int) -> np.ndarray:
        """Squared distances from each row to the centroids met on a best-first walk of ``width`` steps; inf for others."""
        n = len(self.points)
        rows = np.arange(len(x))
        distance, waiting = np.full((len(x), n), np.inf), np.full((len(x), n), np.inf)

        def look(at: np.ndarray) -> None:
            d = ((self.points[at] - x[:, None, :]) ** 2).sum(axis=2)
            new = ~np.isfinite(distance[rows[:, None], at])
            waiting[rows[:, None], at] = np.where(new, d, waiting[rows[:, None], at])
            distance[rows[:, None], at] = d

        entries = np.arange(0, n, max(1, n // 8))[:8]
        look(np.broadcast_to(entries, (len(x), len(entries))))
        for _ in range(min(width, n)):
            step = waiting.argmin(axis=1)
            if not np.isfinite(waiting[rows, step]).any():
                break
            waiting[rows, step] = np.inf
            look(self.graph[step])
        return distance


def fit(sample: np.ndarray, lists: int, norm: float, seed: int = 7) -> Centroids:
    """Centroids by k-means with a price on full lists, and the graph of their nearest neighbours."""
    rng = np.random.default_rng(seed)
    shell = Centroids(np.zeros((0, 0)), np.zeros((0, 0), dtype=np.int64), norm)
    x = np.unique(shell.lifted(sample), axis=0)
    lists = min(lists, len(x))
    centres = x[np.sort(rng.choice(len(x), lists, replace=False))]
    price = np.zeros(lists)
    for _ in range(CLUSTERING):
        owner = np.concatenate([(_squares(part, centres) + price).argmin(axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
        count = np.bincount(owner, minlength=lists)
        spread = _squares(x[:256], centres).min(axis=1).mean()
        price += 0.1 * spread * (count * lists / len(x) - 1).clip(-1, 2)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    apart = _squares(centres, centres)
    np.fill_diagonal(apart, np.inf)
    graph = np.argsort(apart, axis=1, kind="stable")[:, : min(DEGREE, lists - 1)] if lists > 1 else np.zeros((1, 1), dtype=np.int64)
    ring = ((np.arange(lists) + 1) % lists)[:, None]  # no centroid is out of reach
    return Centroids(centres, np.concatenate([graph, ring], axis=1), norm)


def _selected(distance: np.ndarray, ratio: float, least: int, most: int | None) -> list[np.ndarray]:
    """The centroids of each row within ``ratio`` of its nearest, and the ``least`` nearest; nearest first."""
    order, out = np.argsort(distance, axis=1, kind="stable"), []
    for d, by_distance in zip(distance, order):
        inside = int(np.count_nonzero(d <= ratio * d[by_distance[0]] + 1e-12))
        wanted = by_distance[: max(inside, least)]
        out.append(wanted[np.isfinite(d[wanted])][:most])
    return out


def best_products(q: np.ndarray, v: np.ndarray, q_ids: np.ndarray, v_ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, product) of each query's ``k`` best rows at or above its floor, ties to smaller ids.

    Rows are chosen by one matrix product and scored pair by pair, so equal vectors have equal scores.
    """
    rough = q @ v.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    rough[q_ids[:, None] == v_ids] = -np.inf
    limit = floors - slack
    if len(v) > k:
        limit = np.maximum(limit, np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] - slack)
    x, y = np.nonzero((rough >= limit[:, None]) & np.isfinite(rough))
    score = np.concatenate([(q[x[i : i + 65536]] * v[y[i : i + 65536]]).sum(axis=1) for i in range(0, len(x), 65536)]) if len(x) else np.zeros(0)
    best = top(x, score, v_ids[y], k)
    return x[best], y[best], score[best]


def search(table: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query about its ``k`` greatest inner products, nearest first.

    Queries are the rows whose id is divisible by ``every``, one for each id; candidates are all rows with
    another id and a vector of the same length. Every row that takes part is in at least one list. Scores are products
    of the original vectors in double precision; ties go to the smaller id. Rows with a null id, or a vector that is
    null, empty, zero or has null or non-finite components, take no part. Of rows that repeat an id and vector,
    one is returned. Each length has lists of its own; vectors of a rare length are compared with all of it.
    """
    rows = prepared(table, id_column, vector).where(F.exists("v", lambda x: x != 0))
    # one row for each id and vector before any cut to k, with a number that tells its copies in several lists
    rows = stage(rows.dropDuplicates(["id", "v"]).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = stage(query_rows(rows, every), "queries")  # one for each id, also where its rows differ in length
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s"))
    common = sizes.orderBy(F.desc("n"), "dim").limit(LENGTHS + 1).collect()
    found = []
    for i, r in enumerate(common):
        if i == 0 or r.n > OWN_LISTS:
            found.append(_by_lists(rows.where(F.col("dim") == r.dim), queries.where(F.col("dim") == r.dim), r.n, r.s, k))
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    with_lists = [r.dim for i, r in enumerate(common) if i == 0 or r.n > OWN_LISTS]
    rare, asked = (x.where(~F.col("dim").isin(with_lists)).withColumnRenamed("dim", "list") for x in (rows, queries))
    floor = F.lit(float("-inf")).alias("floor")
    found.append(best_per_query(_visit(asked.select("id", "v", floor, "list"), _in_parts(rare), k).distinct(), k))
    return reduce(DataFrame.unionByName, found)


def _in_parts(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings with their part, parts of each list) of ``postings`` (list, id, v, row)."""
    parts = stage(postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "list-sizes")
    part = F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part")
    return postings.join(parts, "list").select("list", part, "id", "v", "row"), parts


def _visit(asked: DataFrame, held: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """(query_id, vec_id, row, score): the ``k`` best of every part of the lists in ``asked`` (id, v, floor, list)."""
    postings, parts = held

    def compare(key, asked, held):
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "row": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "row": "int64"})
        v, v_ids, rows = np.stack(held["v"].to_numpy()), held["id"].to_numpy(np.int64), held["row"].to_numpy(np.int64)
        found = []
        for i in range(0, len(asked), ASKED):  # a list that many queries ask is compared with some at a time
            some = asked.iloc[i : i + ASKED]
            q_ids = some["id"].to_numpy(np.int64)
            x, y, score = best_products(np.stack(some["v"].to_numpy()), v, q_ids, v_ids, some["floor"].to_numpy(np.float64), k)
            found.append(pd.DataFrame({"query_id": q_ids[x], "vec_id": v_ids[y], "row": rows[y], "score": score}))
        return pd.concat(found)

    asked = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v", "floor")
    return asked.groupBy("list", "part").cogroup(postings.groupBy("list", "part")).applyInPandas(compare, "query_id long, vec_id long, row long, score double")


def _by_lists(rows: DataFrame, queries: DataFrame, n: int, square: float, k: int) -> DataFrame:
    """The search among ``n`` vectors of one length, the greatest of which has the squared norm ``square``."""
    rows, spark = rows.select("id", "v", "row"), rows.sparkSession
    share = min(1.0, SAMPLE / n)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("id").limit(2 * SAMPLE).collect()
    picked = picked or rows.limit(1).collect()
    lists = max(1, min(MAX_LISTS, round(n**0.5)))
    centroids = fit(np.array([r.v for r in picked]), lists, float(np.sqrt(square)))
    shared = spark.sparkContext.broadcast(centroids)  # at most MAX_LISTS centroids

    def assign(batches):
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.iloc[i : i + 1024]
                at = shared.value
                chosen = _selected(at.near(at.lifted(np.stack(part["v"].to_numpy())), ASSIGN_WIDTH), BOUNDARY, 1, REPLICAS)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "row": part["row"], "lists": chosen})

    def aim(batches):
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                at = shared.value
                chosen = _selected(at.near(at.directed(np.stack(part["v"].to_numpy())), QUERY_WIDTH), PROBE, LEAST_LISTS, None)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "lists": chosen})

    member = "id long, v array<double>, lists array<int>"
    postings = rows.mapInPandas(assign, "id long, v array<double>, row long, lists array<int>").select("id", "v", "row", F.explode("lists").alias("list"))
    held = _in_parts(stage(postings, "postings"))
    aimed = stage(queries.select("id", "v").mapInPandas(aim, member), "aimed")
    visit = lambda asked: _visit(asked, held, k)

    floor = F.lit(float("-inf"))
    first = visit(aimed.select("id", "v", floor.alias("floor"), F.explode(F.slice("lists", 1, FIRST_LISTS)).alias("list")))
    first = stage(best_per_query(first.distinct(), k, "row"), "first-lists")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached")).withColumnRenamed("query_id", "id")
    rest = aimed.join(floors, "id", "left").select(
        "id", "v", F.coalesce("reached", floor).alias("floor"), F.explode(F.slice("lists", FIRST_LISTS + 1, MAX_LISTS)).alias("list")
    )
    found = visit(rest).unionByName(first.select("query_id", "vec_id", "row", "score"))
    best = stage(best_per_query(found.distinct(), k), "nearest")
    # a query whose lists hold fewer than k candidates visits all lists
    reached = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = aimed.join(reached, "id", "left_anti").select("id", "v", floor.alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(len(centroids.points) - 1))).alias("list"))
    whole = best_per_query(visit(short).distinct(), k)
    return best.join(whole.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)
