"""Token ids in binary shards, with a minimal perfect hash index from document keys into them.

A shard holds the raw ids of documents in ascending order of id, then the borders of the documents, then a
short trailer. The index is cut into parts by key hash. A part is a minimal perfect hash: a key's first hash
names a displacement, which sends it to a slot that no other key has; the slot holds a fingerprint of the key,
the shard, the document's number in it and how many documents share the key. A look-up reads a displacement and
a slot, whatever the size, and a key that is not there is told by its fingerprint.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from origintrace.llm.files import create, open_file
from origintrace.llm.tokens import GENERATION, encoder
from origintrace.sources.staging import new_folder, stage

END_ID = 2
#: A shard ends at so many ids or documents; keys of an index part, about.
SHARD_IDS, SHARD_DOCUMENTS, PART_KEYS = 8 << 20, 1 << 16, 4096
#: Trailer: documents, bytes of an id, mark. Head of an index part: keys, displacements, seed.
TRAILER, HEAD, MARK = struct.Struct("<QI4s"), struct.Struct("<QQQ"), b"IDS1"
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("number", "<u4"), ("copies", "<u4")])
NULL_KEY = "\x00"


class ShardWriter:
    """One shard: ``add`` documents in order, then ``close``."""

    def __init__(self, folder: str, dtype: np.dtype):
        self.path, self.out = create(folder, "shard", ".ids")
        self.dtype, self.borders = dtype, [0]

    def add(self, ids: bytes) -> int:
        self.out.write(ids)
        self.borders.append(self.borders[-1] + len(ids) // self.dtype.itemsize)
        return len(self.borders) - 2

    @property
    def full(self) -> bool:
        return self.borders[-1] >= SHARD_IDS or len(self.borders) > SHARD_DOCUMENTS

    def close(self) -> None:
        self.out.write(np.array(self.borders, dtype="<u8").tobytes())
        self.out.write(TRAILER.pack(len(self.borders) - 1, self.dtype.itemsize, MARK))
        self.out.close()


class ShardReader:
    """Documents of a shard by number, as unsigned ids."""

    def __init__(self, path: str):
        self.file = open_file(path)
        size = self.file.size()
        self.file.seek(size - TRAILER.size)
        n, itemsize, mark = TRAILER.unpack(self.file.read(TRAILER.size))
        if mark != MARK:
            raise ValueError(f"{path} is no shard, or is cut short")
        self.dtype = np.dtype(f"<u{itemsize}")
        self.file.seek(size - TRAILER.size - 8 * (n + 1))
        self.borders = np.frombuffer(self.file.read(8 * (n + 1)), dtype="<u8").astype(np.int64)

    def ids(self, number: int) -> np.ndarray:
        start, stop = self.borders[number : number + 2] * self.dtype.itemsize
        self.file.seek(int(start))
        return np.frombuffer(self.file.read(int(stop - start)), dtype=self.dtype)

    def close(self) -> None:
        self.file.close()


def _hashes(keys: list[str], slots: int, displacements: int, seed: int):
    """(displacement number, first and second step, fingerprint) of each key."""
    import xxhash

    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass"), seed=seed) for k in keys), dtype="<u8").reshape(-1, 2)
    low, high = raw[:, 0], raw[:, 1]
    return (
        (low % np.uint64(displacements)).astype(np.int64), ((low >> np.uint64(20)) % np.uint64(slots)).astype(np.int64),
        ((high & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64), (high >> np.uint64(32)).astype("<u4"),
    )


def build_perfect_hash(keys: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(displacements, slot of each key, seed) for different keys: slots are 0 to n - 1, each once.

    A seed under which keys cannot be told apart is given up for the next one.
    """
    if len(set(keys)) < len(keys):
        raise ValueError("keys repeat")
    seed = 0
    while (found := _displace(keys, seed)) is None:
        seed += 1
    return *found, seed


def _displace(keys: list[str], seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    n = len(keys)
    r = max(1, n // 4)
    group, first, second, _ = _hashes(keys, n, r, seed)
    displacements, taken, slot = np.zeros(r, dtype="<u4"), np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
    order = np.argsort(group, kind="stable")
    members = np.split(order, np.searchsorted(group[order], np.arange(1, r)))
    every = np.arange(n)
    for g in sorted(range(r), key=lambda g: -len(members[g])):
        mine = members[g]
        if not len(mine):
            break
        for turn in range(n):
            start = (first[mine] + turn * second[mine]) % n
            if len(np.unique(start)) < len(start):
                continue
            free = ~taken[(start[:, None] + every) % n].any(axis=0)
            if free.any():
                break
        else:
            return None
        shift = int(free.argmax())
        slot[mine] = (start + shift) % n
        taken[slot[mine]] = True
        displacements[g] = turn * n + shift
    return displacements, slot


def build_part(keys: list[str], shard: np.ndarray, number: np.ndarray, copies: np.ndarray) -> bytes:
    """One part of the index as a file."""
    displacements, slot, seed = build_perfect_hash(keys)
    table = np.zeros(len(keys), dtype=SLOT)
    table["print"][slot] = _hashes(keys, len(keys), len(displacements), seed)[3]
    table["shard"][slot], table["number"][slot], table["copies"][slot] = shard, number, copies
    return HEAD.pack(len(keys), len(displacements), seed) + displacements.tobytes() + table.tobytes()


class IndexPart:
    """Look-ups in one part: ``find(keys)`` gives slots as structured rows; ``copies`` is 0 for unknown keys."""

    def __init__(self, data: bytes):
        self.n, r, self.seed = HEAD.unpack_from(data)
        self.displacements = np.frombuffer(data, "<u4", r, HEAD.size).astype(np.int64)
        self.table = np.frombuffer(data, SLOT, self.n, HEAD.size + 4 * r)

    def find(self, keys: list[str]) -> np.ndarray:
        group, first, second, prints = _hashes(keys, self.n, len(self.displacements), self.seed)
        d = self.displacements[group]
        found = self.table[(first + (d // self.n) * second + d % self.n) % self.n].copy()
        found["copies"][found["print"] != prints] = 0
        return found


@dataclass(frozen=True)
class Dataset:
    """What was written: shards in order (path, number of documents and ids before each) and index parts (part, path)."""

    shards: list[tuple[str, int, int]]
    parts: list[str]
    documents: int
    tokens: int

    def locate(self, part: IndexPart, keys: list[str]) -> list[list[tuple[int, int]]]:
        """The (shard, number) of all documents of each key."""
        before = np.array([s[1] for s in self.shards], dtype=np.int64)
        out = []
        for row in part.find(keys):
            at = before[row["shard"]] + int(row["number"]) + np.arange(int(row["copies"]))
            shard = np.searchsorted(before, at, side="right") - 1
            out.append(list(zip(shard.tolist(), (at - before[shard]).tolist())))
        return out


def _key(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_KEY))


def _part(key, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write(
    documents: DataFrame, tokenizer: str, folder: str | None = None, id_column: str = "doc_id", text: str = "text", end_id: int = END_ID,
    memo: int = GENERATION,
) -> Dataset:
    """Encode, shard and index ``documents``; ``memo`` bounds the words a Python worker remembers.

    Documents come in ascending order of id, null ids first; those with equal ids in the order of a hash of
    their text, all under one key. A null text is empty and has the end id only. Other columns are not read.
    The driver gets one row per file, never one per document.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "token-shards")

    def write_shards(batches):
        enc, writer, rows = encoder(tokenizer, memo), None, []
        end = np.array([end_id], dtype=enc.dtype).tobytes()

        def emit():
            writer.close()
            keys, firsts, numbers = zip(*rows)
            n = len(rows)
            return pa.RecordBatch.from_pydict({
                "path": pa.array([writer.path] * n), "key": pa.array(keys, pa.string()), "h": pa.array(firsts, pa.int64()),
                "number": pa.array(numbers, pa.int32()), "n_ids": pa.array(np.diff(writer.borders), pa.int64()),
            })

        for batch in batches:
            columns = [batch.column(c) for c in ("key", "h", "text")]
            for i in range(0, batch.num_rows, 512):
                keys, hashes, texts = (c.slice(i, 512).to_pylist() for c in columns)
                for key, h, ids in zip(keys, hashes, enc.encode_many(texts)):
                    writer = writer or ShardWriter(folder, enc.dtype)
                    rows.append((key, h, writer.add(ids + end)))
                    if writer.full:
                        yield emit()
                        writer, rows = None, []
        if writer is not None:
            yield emit()

    source = documents.select(
        F.col(id_column).alias("id"), _key(id_column).alias("key"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text")
    )
    ordered = source.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    entries = ordered.drop("id").mapInArrow(write_shards, "path string, key string, h long, number int, n_ids long")
    entries = stage(entries, "shard-entries")
    # a shard's place in the order is that of its first document, so the id's own order has to be known
    kind = documents.schema[id_column].dataType
    first = F.min(F.struct(F.when(F.col("key") != NULL_KEY, F.col("key")).cast(kind).alias("id"), "h"))
    files = entries.groupBy("path").agg(first.alias("first"), F.count("*").alias("docs"), F.sum("n_ids").alias("ids")).orderBy("first").collect()
    shards, docs, ids = [], 0, 0
    for f in files:
        shards.append((f.path, docs, ids))
        docs, ids = docs + f.docs, ids + f.ids
    if not shards:
        return Dataset([], [], 0, 0)
    order = spark.createDataFrame([(p, i) for i, (p, _, _) in enumerate(shards)], "path string, shard int")
    place = F.min(F.struct("shard", "number")).alias("at")
    keys = entries.join(order, "path").groupBy("key").agg(place, F.count("*").alias("copies")).select("key", "at.shard", "at.number", "copies")
    n_parts = max(1, -(-docs // PART_KEYS))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        path, out = create(folder, "index", ".mph")
        columns = [table.column(c).to_pylist() for c in ("key", "shard", "number", "copies")]
        out.write(build_part(columns[0], *map(np.array, columns[1:])))
        out.close()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "path": pa.array([path])})

    made = keys.withColumn("part", _part(F.col("key"), n_parts)).groupBy("part").applyInArrow(index, "part int, path string").collect()
    paths = dict.fromkeys(range(n_parts)) | {r.part: r.path for r in made}
    return Dataset(shards, [paths[i] for i in range(n_parts)], docs, ids)


def read(keys: DataFrame, dataset: Dataset, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document under the different ids of ``keys``, through the index.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as little-endian
    unsigned 32-bit integers. Ids that are not there give no row.
    """
    kind = keys.schema[id_column].dataType.simpleString()
    if not dataset.shards:
        return keys.sparkSession.createDataFrame([], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    shared = keys.sparkSession.sparkContext.broadcast(dataset)

    def locate(key: tuple, table: pa.Table) -> pa.Table:
        path = shared.value.parts[key[0].as_py()]
        if path is None:
            return table.slice(0, 0).select(["key"]).append_column("shard", pa.array([], pa.int32())).append_column("number", pa.array([], pa.int32()))
        with open_file(path) as f:
            part = IndexPart(f.read())
        names = table.column("key").to_pylist()
        rows = [(k, s, n) for k, places in zip(names, shared.value.locate(part, names)) for s, n in places]
        k, s, n = zip(*rows) if rows else ((), (), ())
        return pa.table({"key": pa.array(k, pa.string()), "shard": pa.array(s, pa.int32()), "number": pa.array(n, pa.int32())})

    def fetch(key: tuple, table: pa.Table) -> pa.Table:
        path, _, before = shared.value.shards[key[0].as_py()]
        reader = ShardReader(path)
        numbers = table.column("number").to_pylist()
        start, size, crc = [], [], []
        for n in numbers:
            ids = reader.ids(n)
            start.append(before + int(reader.borders[n]))
            size.append(len(ids))
            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
        reader.close()
        return pa.table({"key": table.column("key"), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    wanted = keys.select(_key(id_column).alias("key")).distinct()
    placed = wanted.withColumn("part", _part(F.col("key"), len(dataset.parts))).groupBy("part").applyInArrow(locate, "key string, shard int, number int")
    fetched = placed.groupBy("shard").applyInArrow(fetch, "key string, start long, n_tokens long, ids_crc32 long")
    return fetched.select(F.when(F.col("key") != NULL_KEY, F.col("key")).cast(kind).alias("doc_id"), "start", "n_tokens", "ids_crc32")
