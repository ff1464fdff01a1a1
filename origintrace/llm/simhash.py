"""SimHash near duplicates through hierarchical indexes over Gray-ordered fingerprints.

Every fingerprint is one 64-bit number. Two numbers that differ in at most d bits agree in ``blocks - d`` of
``blocks`` bit blocks, so a table for each choice of blocks brings all pairs that can link under one key, as
an ordinary shuffle. Below a key the fingerprints are sorted by Gray rank, where neighbours share most bits,
and put under a tree: a node holds the bits that all below it share and its parent does not. A search adds up
the differences on its way down and leaves a whole group once they exceed d.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from origintrace.llm.columns import fresh, quoted
from origintrace.llm.components import components
from origintrace.sources.staging import stage

BITS, SEED = 64, 42
#: Fingerprints of one key on one side of a grid cell, children of a node, searches at a time.
CELL, FANOUT, SEARCHES = 2048, 8, 256
#: Shingles turned into bits at a time.
SHINGLES = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 for a text without words.

    Words end at ASCII white space and A-Z are lower-cased. All shingles of ``width`` words count, repeats
    included; a shorter text is one shingle. A bit is 1 if more than half of the hashes have it.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    starts = [words[i:] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
    total, ones = len(starts[-1]), np.zeros(BITS, dtype=np.int64)
    digest, grams = partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*starts)) if len(starts) > 1 else iter(starts[0])
    for i in range(0, total, SHINGLES):
        n = min(SHINGLES, total - i)
        hashes = np.fromiter((digest(next(grams)) for _ in range(n)), dtype="<u8", count=n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint_column(text: str | Column, width: int) -> Column:
    """``fingerprint`` of a text column, as Arrow batches."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Tree over fingerprints in Gray order. ``levels[0]`` has the root, the last level the fingerprints."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        leaves = codes[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        levels = [(leaves, np.full(len(leaves), full))]  # pattern, mask of the bits shared below
        while len(levels[-1][0]) > 1:
            pattern, mask = levels[-1]
            at = np.arange(0, len(pattern), FANOUT)
            differing = np.bitwise_or.reduceat(pattern, at) & ~np.bitwise_and.reduceat(pattern, at)
            levels.append((pattern[at], np.bitwise_and.reduceat(mask, at) & ~differing))
        levels.reverse()
        self.levels = [levels[0]]
        for (_, above), (pattern, mask) in zip(levels, levels[1:]):
            parent = above[np.arange(len(pattern)) // FANOUT]
            self.levels.append((pattern, mask & ~parent))  # what the parent shares is stated there

    def within(self, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(search, member) for all members at most ``distance`` bits from each of ``codes``."""
        search = np.arange(len(codes))
        node = np.zeros(len(codes), dtype=np.int64)
        sums = np.zeros(len(codes), dtype=np.int64)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                search, sums = np.repeat(search, FANOUT), np.repeat(sums, FANOUT)
                real = node < len(pattern)
                node, search, sums = node[real], search[real], sums[real]
            sums = sums + np.bitwise_count((codes[search] ^ pattern[node]) & mask[node])
            near = sums <= distance
            node, search, sums = node[near], search[near], sums[near]
        return search, self.order[node]


def linked(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its class) for the members of ``codes`` that link to another one.

    Classes are those of the links at most ``distance`` bits long among ``codes``. As only the classes
    matter, a class of n members comes out as n - 1 rows and not as its links.
    """
    codes = np.unique(codes)
    index, root = GrayIndex(codes.view(np.uint64)), np.arange(len(codes))
    for i in range(0, len(codes), SEARCHES):
        search, member = index.within(codes[i : i + SEARCHES].view(np.uint64), distance)
        while True:
            a, b = root[search + i], root[member]
            apart = a != b
            if not apart.any():
                break
            search, member = search[apart], member[apart]
            np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
            while (deeper := root[root]).tolist() != root.tolist():
                root = deeper
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return codes[moved], codes[root[moved]]


def _block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(1 << j) - (1 << i) for i, j in zip(edges, edges[1:])]


def near_edges(codes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(a, b): edges whose classes are the classes of all links among the distinct ``fp`` of ``codes``.

    A key with many fingerprints is cut into a grid of cells with about ``CELL`` on a side, so that no task
    holds a whole key; a key with one fingerprint leaves before anything is gathered.
    """
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    masks = [sum(c) for c in combinations(_block_masks(blocks), blocks - distance)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    keyed = codes.select("fp", F.explode(keys).alias("k")).select("fp", "k.table", "k.key")
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    part = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    cells = (
        keyed.join(shared.withColumn("parts", parts), ["table", "key"])
        .select("table", "key", "fp", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
        .groupBy("table", "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
    )

    def search(batches):
        for batch in batches:
            found = [linked(np.asarray(fps, dtype=np.int64), distance) for fps in batch["fps"]]
            if found:
                yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    return cells.select("fps").mapInPandas(search, "a long, b long")


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
    width: int = 3, distance: int = 3, blocks: int = 5,
) -> DataFrame:
    """(id, fp, component_id, kept_fp) for every row of ``documents``.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest id reachable
    over links, the row itself included, and ``kept_fp`` the smallest fingerprint with that id. A null text
    counts as empty; texts without words have fingerprint 0 and link like others. Rows with a null id belong
    to components like others, and are their name (null) only where no row has an id. Repeated rows come out
    as often as they are there. Other columns are not read.
    """
    return _classed(_fingerprints(documents, id_column, text_column, width), distance, blocks)


def _fingerprints(documents: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(id, fp) of every row, written: fingerprints are worked out once."""
    of = documents.select(F.col(id_column).alias("id"), fingerprint_column(F.col(text_column), width).alias("fp"))
    return stage(of, "fingerprints")


def _classed(of: DataFrame, distance: int, blocks: int) -> DataFrame:
    codes = of.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("least"))
    codes = stage(codes, "codes")
    roots = components(near_edges(codes, distance, blocks))
    rooted = codes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = rooted.join(classes, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.fp").alias("kept_fp"))
    return of.join(named, "fp").select("id", "fp", "component_id", "kept_fp")


def keep_one(documents: DataFrame, *, width: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """The rows of ``documents`` with one document of each component left: that with the smallest ``doc_id``.

    All columns stay, whatever their names. Rows of one id and one fingerprint come down to one of them, any of them
    where they differ in text or other columns. A component without any id keeps one row.
    """
    of = _fingerprints(documents, "doc_id", "text", width)
    chosen = _classed(of, distance, blocks).where(F.col("fp") == F.col("kept_fp")).where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = stage(chosen.select("id", F.col("fp").alias("kept")).distinct(), "kept")
    # An id with one row is settled by the id; the fingerprint is looked at again only where several rows have one id.
    often = stage(of.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("often")), "often")
    once = kept.join(often, kept["id"].eqNullSafe(often["often"]), "left_anti")
    single = documents.join(once, documents["doc_id"].eqNullSafe(once["id"]), "left_semi")
    fp = fresh(documents, "fingerprint")
    rows = documents.join(often, documents["doc_id"].eqNullSafe(often["often"]), "left_semi").withColumn(
        fp, fingerprint_column(F.col("text"), width)
    )
    several = rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (rows[fp] == kept["kept"]), "left_semi")
    return single.union(several.dropDuplicates(["doc_id", fp]).select(*quoted(documents)))


def hex_digits(fp: str | Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
