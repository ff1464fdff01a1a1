"""Best-fit packing into sequences of bounded length by a grouping genetic algorithm on islands.

Pieces fall into blocks of bounded size by hash. Each block is evolved on several islands at once: a child
takes whole well-filled sequences of one parent, drops those of the other that hold the same pieces, and
best-fits what is displaced. Between two rounds the best packings of an island move to the next island of
the block. What remains in badly filled sequences of all blocks is packed once more, together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from origintrace.llm.columns import fresh, quoted
from origintrace.llm.tokens import GENERATION, encoder
from origintrace.sources.staging import stage

CAPACITY, END_ID = 4096, 1
#: Pieces of a block (about), islands of a block, packings of an island, children in each of the rounds.
BLOCK, ISLANDS, POPULATION, CHILDREN, ROUNDS = 1500, 3, 4, 6, 2
#: A sequence is well filled from this share on; badly filled ones of all blocks are packed again.
WELL_FILLED, BADLY_FILLED = 0.995, 0.97

PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces_of(
    documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, memo: int = GENERATION
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids with the end id, cut only where longer than ``capacity``.

    ``memo`` bounds the words a Python worker remembers.
    """
    kind = documents.schema[id_column].dataType.simpleString()

    def cut(batches):
        enc, names = encoder(tokenizer, memo), ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            for k in range(0, batch.num_rows, 256):  # few texts at a time are Python objects
                part, rows = batch.slice(k, 256), []
                for doc, data in zip(part.column("doc_id").to_pylist(), enc.encode_many(part.column("text").to_pylist())):
                    ids = np.empty(len(data) // enc.dtype.itemsize + 1, dtype="<u4")
                    ids[:-1], ids[-1] = np.frombuffer(data, dtype=enc.dtype), END_ID
                    rows += [(doc, i // capacity, i, min(capacity, len(ids) - i), zlib.crc32(ids[i : i + capacity])) for i in range(0, len(ids), capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE.format(id=kind))


def best_fit(sizes: np.ndarray, order, place: np.ndarray, room: list[int], capacity: int) -> None:
    """Put the items of ``order`` into the fullest sequence that takes them; new sequences are appended to ``room``."""
    open_rooms = sorted((r, i) for i, r in enumerate(room) if r > 0)
    for item, size in zip(order, sizes[order].tolist()):
        at = bisect_left(open_rooms, (size, -1))
        if at < len(open_rooms):
            left, b = open_rooms.pop(at)
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        place[item] = b
        room[b] = left - size
        if room[b]:
            insort(open_rooms, (room[b], b))


def fitness(sizes: np.ndarray, place: np.ndarray, capacity: int) -> float:
    """Few sequences first, then sequences as unequal as can be: what is free lies together."""
    filled = np.bincount(place, sizes) / capacity
    return float(-(filled > 0).sum() + (filled**2).mean())


def cross(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: whole well-filled sequences of ``giver``, what of ``taker`` does not touch them, the rest by best fit."""
    filled = np.bincount(giver, sizes)
    good = np.flatnonzero(filled >= WELL_FILLED * capacity)
    if not len(good):
        good = np.flatnonzero(filled > 0)
    taken = np.zeros(len(filled), dtype=bool)
    taken[rng.choice(good, size=max(1, len(good) // 3), replace=False)] = True
    injected = taken[giver]
    touched = np.zeros(int(taker.max()) + 1, dtype=bool)
    touched[taker[injected]] = True
    displaced = np.flatnonzero(touched[taker] & ~injected)
    label = np.where(injected, giver + int(taker.max()) + 1, taker)
    stays = np.ones(len(sizes), dtype=bool)
    stays[displaced] = False
    _, numbers = np.unique(label[stays], return_inverse=True)
    child = np.full(len(sizes), -1)
    child[stays] = numbers
    room = (capacity - np.bincount(numbers, sizes[stays]).astype(np.int64)).tolist()
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], child, room, capacity)
    return child


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: tuple, children: int = CHILDREN) -> list[np.ndarray]:
    """One round of an island: packings by fitness, best first."""
    rng, population = np.random.default_rng(seed), list(elites)
    while len(population) < POPULATION:
        noise = rng.uniform(0.85, 1.15, len(sizes)) if population else 1.0
        place = np.empty(len(sizes), dtype=np.int64)
        best_fit(sizes, np.argsort(-sizes * noise, kind="stable"), place, [], capacity)
        population.append(place)
    scored = sorted(((fitness(sizes, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for n in range(children):
        giver, taker = rng.choice(min(len(scored), POPULATION), size=2, replace=False)
        child = cross(sizes, scored[giver][2], scored[taker][2], capacity, rng)
        scored.append((fitness(sizes, child, capacity), len(population) + n, child))
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION]
    return [p for _, _, p in scored]


_STATE = "block long, island int, fit double, place binary"


def _level(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """(uid, length, sequence_id, offset, filled) for ``items`` (uid, length): the best packing of every block."""
    blocks = max(1, -(-items.count() // BLOCK))
    items = items.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"), "uid", "length")
    spread = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = None

    def round_of(number):
        def run(key, pdf, elites):
            pdf = pdf.sort_values("uid")
            sizes = pdf["length"].to_numpy(dtype=np.int64)
            old = [np.frombuffer(p, dtype=np.int32).astype(np.int64) for p in elites.sort_values(["fit", "place"], ascending=False)["place"]] if elites is not None else []
            best = evolve(sizes, old[:POPULATION], capacity, (level, number, *map(int, key))) if len(sizes) else []
            rows = [(int(key[0]), int(key[1]), fitness(sizes, p, capacity), p.astype(np.int32).tobytes()) for p in best[:2]]
            return pd.DataFrame(rows, columns=["block", "island", "fit", "place"])

        return run

    def first_round(key, pdf):
        return round_of(0)(key, pdf, None)

    for number in range(ROUNDS):
        if state is None:
            new = spread.groupBy("block", "island").applyInPandas(first_round, _STATE)
        else:
            travelled = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
            home = state.groupBy("block", "island").agg(F.max_by(F.struct("fit", "place"), "fit").alias("b")).select("block", "island", "b.fit", "b.place")
            arrived = home.unionByName(travelled)
            new = spread.groupBy("block", "island").cogroup(arrived.groupBy("block", "island")).applyInPandas(round_of(number), _STATE)
        state = stage(new, "islands")
    best = state.groupBy("block").agg(F.max_by("place", F.struct("fit", "place")).alias("place"))

    def unpack(key, pdf, packing):
        pdf = pdf.sort_values("uid")
        place = np.frombuffer(packing["place"].iloc[0], dtype=np.int32).astype(np.int64)
        pdf = pdf.assign(bin=place).sort_values(["bin", "uid"])
        by_bin = pdf.groupby("bin")["length"]
        return pd.DataFrame({
            "uid": pdf["uid"], "length": pdf["length"], "sequence_id": (level << 56) + (int(key[0]) << 20) + pdf["bin"],
            "offset": by_bin.cumsum() - pdf["length"], "filled": by_bin.transform("sum"),
        })

    return items.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(
        unpack, "uid long, length long, sequence_id long, offset long, filled long"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``; all other columns stay.

    Offsets of a sequence have no gaps. A piece of full length is a sequence of its own. Repeated rows are
    pieces of their own. A null length is taken as 1. An empty table stays empty.
    """
    given, row = pieces, fresh(pieces, "row")
    pieces = stage(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    length = F.coalesce(F.col("length"), F.lit(1)).cast("long")
    items = pieces.select(F.col(row).alias("uid"), length.alias("length")).where(F.col("length") < capacity)
    first = stage(_level(items, 1, capacity), "packed")
    fits = F.col("filled") >= BADLY_FILLED * capacity
    second = _level(first.where(~fits).select("uid", "length"), 2, capacity)
    placed = first.where(fits).unionByName(second).select("uid", "sequence_id", "offset")
    return pieces.join(placed, pieces[row] == placed["uid"], "left").select(
        *[pieces[c] for c in quoted(given)],
        F.coalesce(placed["sequence_id"], -1 - pieces[row]).alias("sequence_id"), F.coalesce(placed["offset"], F.lit(0)).alias("offset"),
    )
