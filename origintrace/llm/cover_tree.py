"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and candidates fall into blocks of bounded size by hash, and every block gets a cover tree once. A
pair of blocks is searched by walking both trees together: a pair of nodes is left if its greatest possible
score, from the centres' product and both covering radii, is below the worst k-th score of the query node.
Each query block first meets one block of candidates, which gives its queries k-th scores to start with.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from origintrace.llm.vectors import best_per_query, prepared, query_rows, top
from origintrace.sources.staging import stage

#: Points of a candidate block and of a query block, about; points of a leaf, at most (equal ones aside).
CANDIDATES, QUERIES, LEAF = 512, 256, 8
_EXACT = float(1 << 53)


class CoverTree:
    """Nodes as arrays: centre, covering radius, range of points, range of children. Points are permuted."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        perm, nodes = [], []

        def build(index: np.ndarray, distance: np.ndarray, at: int) -> None:
            """``index``: points of node ``at``, its centre first; ``distance``: to the centre."""
            radius, start = float(distance.max()), len(perm)
            kids = []
            if len(index) <= LEAF or radius == 0.0:
                perm.extend(index.tolist())
            else:
                rest, from_centre = index, distance
                while len(rest):
                    lead = 0 if not kids else int(from_centre.argmax())
                    apart = np.linalg.norm(points[rest] - points[rest[lead]], axis=1)
                    mine = apart <= radius / 2
                    order = np.concatenate([[lead], np.flatnonzero(mine & (np.arange(len(rest)) != lead))])
                    kids.append((rest[order], apart[order]))
                    rest, from_centre = rest[~mine], from_centre[~mine]
                first = len(nodes)
                nodes.extend([None] * len(kids))
                for i, (members, far) in enumerate(kids):
                    build(members, far, first + i)
                nodes[at] = (index[0], radius, start, len(perm), first, first + len(kids))
                return
            nodes[at] = (index[0], radius, start, len(perm), 0, 0)

        nodes.append(None)
        everything = np.arange(len(points))
        build(everything, np.linalg.norm(points - points[0], axis=1), 0)
        table = np.array(nodes, dtype=np.float64)
        self.centre = table[:, 0].astype(np.int64)
        self.radius = table[:, 1] * (1 + 1e-9)
        self.start, self.stop, self.first, self.last = (table[:, i].astype(np.int64) for i in range(2, 6))
        self.perm = np.array(perm, dtype=np.int64)
        self.length = np.linalg.norm(points, axis=1) * (1 + 1e-9)

    def children(self, node: int) -> np.ndarray:
        """A leaf stands for itself."""
        return np.arange(self.first[node], self.last[node]) if self.last[node] else np.array([node])


class DualSearch:
    """The ``k`` best candidates of every query of one tree among those of another, at or above given floors."""

    def __init__(self, queries: CoverTree, candidates: CoverTree, k: int, floors: np.ndarray):
        self.q, self.c, self.k, self.floors = queries, candidates, k, floors.copy()
        self.found = [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)]  # query, score, id

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c = self.q, self.c
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            mine, theirs = q.children(a), c.children(b)
            qc, cc = q.centre[mine], c.centre[theirs]
            most = q.points[qc] @ c.points[cc].T
            most = most + np.outer(q.length[qc], c.radius[theirs]) + np.outer(q.radius[mine], c.length[cc]) + np.outer(q.radius[mine], c.radius[theirs])
            worst = np.array([self.floors[q.perm[q.start[n] : q.stop[n]]].min() for n in mine])
            x, y = np.nonzero(most * (1 + 1e-12) + 1e-6 >= worst[:, None])
            leaves = (q.last[mine[x]] == 0) & (c.last[theirs[y]] == 0)
            if leaves.any():
                self._score(np.unique(mine[x[leaves]]), np.unique(theirs[y[leaves]]))
            x, y = x[~leaves], y[~leaves]
            for i in np.argsort(most[x, y]):
                stack.append((int(mine[x[i]]), int(theirs[y[i]])))
        return self.found

    def _score(self, q_leaves: np.ndarray, c_leaves: np.ndarray) -> None:
        q, c = self.q, self.c
        qs = np.concatenate([q.perm[q.start[n] : q.stop[n]] for n in q_leaves])
        cs = np.concatenate([c.perm[c.start[n] : c.stop[n]] for n in c_leaves])
        score = q.points[qs] @ c.points[cs].T
        x, y = np.nonzero((score >= self.floors[qs][:, None]) & (q.ids[qs][:, None] != c.ids[cs]))
        merged = [np.concatenate(p) for p in zip(self.found, (qs[x], score[x, y], c.ids[cs[y]]))]
        best = top(*merged, self.k)
        self.found = [p[best] for p in merged]
        counts = np.bincount(self.found[0], minlength=len(q.ids))
        full = np.flatnonzero(counts >= self.k)
        last = np.cumsum(counts) - 1
        self.floors[full] = np.maximum(self.floors[full], self.found[1][last[full]])


def quantised(v: str, scale: int = 256):
    """floor(scale * x) of every component, in double precision."""
    return F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def _trees(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    def build(key, pdf):
        pdf = pdf.sort_values("id")
        tree = CoverTree(pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"dim": [int(key[0])], name: [int(key[1])], f"{name}_tree": [pickle.dumps(tree)]})

    keyed = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(name), "id", "v")
    return stage(keyed.groupBy("dim", name).applyInPandas(build, f"dim int, {name} long, {name}_tree binary"), f"{name}-trees")


def search(table: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest integer inner products, ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``, one for
    each id; candidates are all rows with another id, repeated ones as often as they are there. Rows with a
    null id, or a vector that is null, empty or has null or non-finite components, take no part. Vectors meet
    those of their own length only. Scores are exact while they stay below 2**53.
    """
    rows = stage(prepared(table, id_column, vector).select("id", quantised("v", scale).alias("v"), "dim"), "quantised")
    queries = query_rows(rows, every)
    n_c, n_q = max(1, -(-rows.count() // CANDIDATES)), max(1, -(-queries.count() // QUERIES))
    c_trees, q_trees = _trees(rows, n_c, "cb"), _trees(queries, n_q, "qb")

    def run(q_tree: bytes, c_tree: bytes, floors) -> tuple[CoverTree, DualSearch]:
        q, c = pickle.loads(q_tree), pickle.loads(c_tree)
        at = np.frombuffer(floors) if floors is not None else np.full(len(q.ids), -np.inf)
        found = DualSearch(q, c, k, at)
        found.run()
        return q, found

    def home(batches):
        for batch in batches:
            floors = [run(q, c, None)[1].floors.tobytes() for q, c in zip(batch["qb_tree"], batch["cb_tree"])]
            yield pd.DataFrame({"dim": batch["dim"], "qb": batch["qb"], "floors": floors})

    def meet(batches):
        for batch in batches:
            for q_tree, c_tree, floors in zip(batch["qb_tree"], batch["cb_tree"], batch["floors"]):
                q, found = run(q_tree, c_tree, floors)
                x, score, ident = found.found
                yield pd.DataFrame({"query_id": q.ids[x], "vec_id": ident, "score": score.astype(np.int64)})

    started = q_trees.withColumn("cb", F.pmod("qb", F.lit(n_c))).join(c_trees, ["dim", "cb"]).mapInPandas(home, "dim int, qb long, floors binary")
    started = stage(started, "floors")
    everywhere = q_trees.join(started, ["dim", "qb"], "left").withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    found = everywhere.join(c_trees, ["dim", "cb"]).mapInPandas(meet, "query_id long, vec_id long, score long")
    return best_per_query(found, k)
