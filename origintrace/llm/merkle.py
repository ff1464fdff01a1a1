"""Merkle manifest of a dataset: a root over all rows, and for every row the witness that proves it.

Leaves are put in order per group and appended, block by block, to a tree that is never held whole. A block is
an aligned run of ``2 ** HEIGHT`` leaves, so its subtree is one of the whole tree. While leaves are appended, each
keeps a partial witness on the open subtree it lies in; when a sibling of that subtree completes, the witnesses
on both sides are extended by the other side's digest. The roots of the blocks are then appended in the same way,
as leaves of the next tree, until one root is left in each group; and so are the roots of the groups.

Digests are SHA-256. A parent is the digest of its children's digests as hexadecimal text; the last run of a
level may be a single node, which is hashed alone.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from origintrace.sources.staging import broadcast_if_small, stage

#: Levels of a block: a task holds 4,096 leaves and their witnesses at a time.
HEIGHT = 12
#: Bytes of a digest.
DIGEST = 32


def parent(*children: bytes) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


class Witnesses:
    """A tree that grows by appending; ``of[i]`` is the witness of leaf i so far, lowest sibling first."""

    def __init__(self):
        self.of: list[bytearray] = []
        self.open: list[tuple[int, bytes, int]] = []  # (height, digest, first leaf) of complete subtrees, left to right

    def _complete(self, height: int, digest: bytes, first: int) -> None:
        """A subtree that ends at the last leaf is complete; it joins a sibling that waits for it, and so on up."""
        while self.open and self.open[-1][0] == height:
            _, left, start = self.open.pop()
            for i in range(start, first):
                self.of[i] += digest
            for i in range(first, len(self.of)):
                self.of[i] += left
            height, digest, first = height + 1, parent(left, digest), start
        self.open.append((height, digest, first))

    def append(self, digest: bytes) -> None:
        self.of.append(bytearray())
        self._complete(0, digest, len(self.of) - 1)

    def close(self, least: int = 0) -> bytes:
        """The root once no leaf will follow, raised to height ``least`` at least: last runs are hashed alone."""
        while len(self.open) > 1 or self.open[0][0] < least:
            height, digest, first = self.open.pop()
            self._complete(height + 1, parent(digest), first)
        return self.open[0][1]


def fold(node: bytes, witness: bytes, *levels: tuple[int, int]) -> bytes:
    """The root that follows from a leaf and its witness; ``levels`` has (position, nodes) for each tree, leaf's first."""
    at = 0
    for position, nodes in levels:
        while nodes > 1:
            if position ^ 1 < nodes:
                sibling, at = witness[at : at + DIGEST], at + DIGEST
                node = parent(sibling, node) if position & 1 else parent(node, sibling)
            else:
                node = parent(node)
            position, nodes = position >> 1, (nodes + 1) >> 1
    return node


def leaf(*values: str | Column) -> Column:
    """Digest (binary) of a row's values: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value as text."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position`` in their group ``of``, and the group's number of rows as ``nodes``.

    Rows are sorted by range, so a group lies in any number of tasks, and what is summed over a group is one
    count for each range. ``row`` tells repeated rows apart, so that they can be cut like others.
    """
    by = ["of", *order, "row"]
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    ordered = rows.repartitionByRange(*map(F.col, by)).sortWithinPartitions(*by).drop("row")
    ordered = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("range", F.shiftright("at", 33))
    whole = Window.partitionBy("group")
    counts = (
        ordered.groupBy(F.col("of").alias("group"), F.col("range").alias("part"))
        .agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
        .withColumn("before", F.sum("n").over(whole.orderBy("part")) - F.col("n"))
        .withColumn("nodes", F.sum("n").over(whole))
    )
    here = F.col("of").eqNullSafe(F.col("group")) & (F.col("range") == F.col("part"))
    placed = ordered.join(stage(counts, "merkle-ranges"), here)
    return placed.withColumn("position", F.col("before") + F.col("at") - F.col("first_at")).drop(
        "group", "part", "n", "first_at", "before", "at", "range"
    )


def _block_appender(height: int):
    """A function that appends one block's nodes in order; ``witness`` is what each has within the block, ``top`` the block's root."""

    def append(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        tree = Witnesses()
        for node in table["node"]:
            tree.append(node.as_py())
        top = tree.close(height if table["nodes"][0].as_py() > 1 << height else 0)
        table = table.drop_columns(["node", "block"])
        table = table.append_column("witness", pa.array([bytes(w) for w in tree.of], pa.binary()))
        return table.append_column("top", pa.array([top] * len(table), pa.binary()))

    return append


def _grown(nodes: DataFrame) -> DataFrame:
    """(of, position, nodes, ...) with ``node`` replaced by ``witness`` and the group's root as ``top``.

    A group of one block is done after one round; the roots of the blocks of larger ones are nodes of the next.
    """
    blocks = nodes.withColumn("block", F.shiftright("position", HEIGHT))
    out = StructType([f for f in blocks.schema.fields if f.name not in ("node", "block")])
    out = StructType([*out.fields, StructField("witness", BinaryType()), StructField("top", BinaryType())])
    grown = stage(blocks.groupBy("of", "block").applyInArrow(_block_appender(HEIGHT), out), "merkle-blocks")
    size = 1 << HEIGHT
    roots = grown.where((F.col("nodes") > size) & (F.col("position") % size == 0))
    above = roots.select(
        "of", F.shiftright("position", HEIGHT).alias("position"), F.ceil(F.col("nodes") / size).cast("long").alias("nodes"), F.col("top").alias("node")
    )
    if above.isEmpty():
        return grown
    above = _grown(above).select(
        F.col("of").alias("group"), F.col("position").alias("block"), F.col("witness").alias("more"), F.col("top").alias("root")
    )
    here = F.col("of").eqNullSafe(F.col("group")) & (F.shiftright("position", HEIGHT) == F.col("block"))
    return (
        grown.join(above, here, "left")
        .withColumn("witness", F.concat("witness", F.coalesce("more", F.lit(b""))))
        .withColumn("top", F.coalesce("root", "top")).drop("group", "block", "more", "root")
    )


def manifest(documents: DataFrame, columns: list[str], group: str, order: str, keep: dict[str, Column]) -> DataFrame:
    """One row for every row of ``documents``, with the columns ``keep`` (name to expression over ``documents``) and

    ``leaf`` (digest of ``columns``), ``position`` and ``nodes`` in its group, ``subroot`` of the group,
    ``group_position`` and ``groups``, ``root`` over all groups, and ``witness``: the siblings' digests from the leaf up
    to the root, one after the other. Digests are binary.

    Leaves ascend by ``order`` within their group, nulls first, rows with one ``order`` by their leaf. Groups ascend by
    their UTF-8 bytes; null is a group, the first one. A repeated row is a leaf each time it is there. A table
    without rows gives none. Columns that are not named are not read.
    """
    kept = F.struct(*[c.alias(name) for name, c in keep.items()])
    rows = documents.select(F.col(group).alias("of"), F.col(order).alias("sorted_by"), leaf(*columns).alias("node"), kept.alias("kept"))
    rows = rows.withColumn("leaf", F.col("node"))
    leaves = _grown(_placed(rows, "sorted_by", "node").drop("sorted_by"))
    leaves = stage(leaves.withColumnRenamed("top", "subroot"), "merkle-leaves")
    groups = leaves.where("position = 0").select(F.lit(0).alias("of"), F.col("of").alias("name"), F.col("subroot").alias("node"))
    tops = _grown(_placed(groups, "name")).select(
        F.col("name").alias("group"), F.col("position").alias("group_position"), F.col("nodes").alias("groups"),
        F.col("witness").alias("more"), F.col("top").alias("root"),
    )
    tops = broadcast_if_small(tops, "merkle-groups")
    return leaves.join(tops, F.col("of").eqNullSafe(F.col("group"))).select(
        "kept.*", "leaf", "position", "nodes", "subroot", "group_position", "groups", "root", F.concat("witness", "more").alias("witness")
    )


@F.arrow_udf(BinaryType())
def folded(
    node: pa.Array, witness: pa.Array, position: pa.Array, nodes: pa.Array, group_position: pa.Array, groups: pa.Array
) -> pa.Array:
    """``fold`` of the rows of a manifest: the root that a leaf, which may be another than the row's, leads to."""
    columns = (c.to_pylist() for c in (node, witness, position, nodes, group_position, groups))
    return pa.array([fold(n, w, (p, k), (q, g)) for n, w, p, k, q, g in zip(*columns)], pa.binary())


def hexadecimal(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))
