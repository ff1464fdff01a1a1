"""Removal of lines that other documents hold too, through two Bloom filters.

A first scan puts the hash of every line key into a filter of keys seen once and, if it was there already, into
a filter of keys seen twice. Every task fills filters of its own; two tasks' filters merge by OR, and what both
have seen once counts as seen twice. A second scan looks every key up in the merged second filter, and only the
suspects are shuffled: their texts are compared whole, so a false positive of the filters costs a row and
changes nothing. The third scan drops the lines.

A filter has at most ``FILTER_BITS`` bits whatever the corpus. Keys beyond what fits are dealt by hash to several
waves, each a pair of filters of its own; no key is left out and none is looked at in two waves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from origintrace.llm.columns import fresh
from origintrace.sources.staging import broadcast_if_small, shuffle_partitions, stage

#: Code points of the shortest key that counts.
LEAST_KEY = 10
#: Bits of a filter at most (32 MB), wanted bits for a line, least bits for a line before a further wave, probes.
FILTER_BITS, WANTED, LEAST, PROBES = 1 << 28, 16, 8, 4
#: Bits of the piece of a filter that one row holds; hashes put into the filters at a time.
SEGMENT_BITS, CHUNK = 1 << 20, 1 << 18
#: Keys in more than one of so many lines are joined by broadcast; there are at most so many of them.
HEAVY = 4096


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends and with A-Z lower-cased (both keep to ASCII for bytes)."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether a UTF-8 key has at least ``least`` code points."""
    if len(key) < least or len(key) >= 4 * least:
        return len(key) >= least
    return len(key.decode("utf-8", "surrogatepass")) >= least


def keys_of(text: bytes | None, least: int) -> set[bytes]:
    """The different keys of a text that are long enough."""
    return {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, least)}


def hashes_of(keys) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype="<u8")


class BloomPair:
    """Filters of the hashes seen once and seen twice. ``bits`` is a power of two."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = (np.zeros(bits >> 3, dtype=np.uint8) for _ in range(2))

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """(hash, probe): bit numbers, by double hashing with an odd step."""
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        probes = np.arange(PROBES, dtype=np.uint64)
        return (hashes[:, None] + probes * step[:, None]) & np.uint64(self.bits - 1)

    @staticmethod
    def _held(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    @staticmethod
    def _put(bitmap: np.ndarray, places: np.ndarray) -> None:
        places = places.ravel()
        np.bitwise_or.at(bitmap, places >> np.uint64(3), np.left_shift(1, places & np.uint64(7), dtype=np.uint64).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        """See every hash once more."""
        hashes, times = np.unique(hashes, return_counts=True)
        places = self._places(hashes)
        self._put(self.twice, places[(times > 1) | self._held(self.once, places)])
        self._put(self.once, places)

    def seen_twice(self, hashes: np.ndarray) -> np.ndarray:
        return self._held(self.twice, self._places(hashes))

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(number, once, twice), compressed, of the pieces that hold anything."""
        size = min(self.bits, SEGMENT_BITS) >> 3
        for i in range(0, self.bits >> 3, size):
            if self.once[i : i + size].any():
                yield i // size, zlib.compress(self.once[i : i + size], 1), zlib.compress(self.twice[i : i + size], 1)


def merge_segments(parts: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(number, twice) from pieces in order of their numbers: a bit in two pieces of once is one of twice."""
    number = once = twice = None
    for i, a, b in parts:
        a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
        if i != number:
            if number is not None:
                yield number, twice.tobytes()
            number, once, twice = i, a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    if number is not None:
        yield number, twice.tobytes()


def plan(lines: int) -> tuple[int, int]:
    """(bits of a filter, waves) for so many lines."""
    waves = max(1, -(-lines * LEAST // FILTER_BITS))
    return min(FILTER_BITS, max(SEGMENT_BITS, 1 << (max(lines, 1) * WANTED // waves - 1).bit_length())), waves


def _in_wave(hashes: np.ndarray, wave: int, waves: int) -> np.ndarray:
    """Which hashes a wave looks at, by bits of a mix, so that they still fill its whole filter."""
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(waves) == np.uint64(wave)


def _of_wave(parts: list[np.ndarray], wave: int, waves: int) -> np.ndarray:
    hashes = np.concatenate(parts)
    return hashes if waves == 1 else hashes[_in_wave(hashes, wave, waves)]


def _twice_filter(texts: DataFrame, bits: int, wave: int, waves: int, least: int) -> bytes:
    """The merged filter of keys seen twice; ``texts`` has one binary column. At most ``bits`` come to the driver."""

    def fill(batches):
        pair, waiting, held = BloomPair(bits), [], 0
        for batch in batches:
            for text in batch.column(0):
                waiting.append(hashes_of(keys_of(text.as_py(), least)))
                held += len(waiting[-1])
                if held >= CHUNK:
                    pair.add(_of_wave(waiting, wave, waves))
                    waiting, held = [], 0
        if held:
            pair.add(_of_wave(waiting, wave, waves))
        for number, once, twice in pair.segments():
            yield pa.RecordBatch.from_pydict(
                {"segment": [number], "once": [once], "twice": [twice]},
                schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
            )

    def merge(batches):
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for number, twice in merge_segments(rows):
            yield pa.RecordBatch.from_pydict(
                {"segment": [number], "twice": [twice]}, schema=pa.schema([("segment", pa.int32()), ("twice", pa.binary())])
            )

    filled = texts.mapInArrow(fill, "segment int, once binary, twice binary")
    tasks = min(shuffle_partitions(texts.sparkSession), max(1, bits // SEGMENT_BITS))
    merged = filled.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    found, size = bytearray(bits >> 3), min(bits, SEGMENT_BITS) >> 3
    for row in merged.collect():
        found[row.segment * size : (row.segment + 1) * size] = row.twice
    return bytes(found)


def _suspects(documents: DataFrame, twice: bytes, bits: int, wave: int, waves: int, least: int) -> DataFrame:
    """(id, content, key) for every row of ``documents`` (id, content, text) and key that the filter calls seen twice."""
    sent = documents.sparkSession.sparkContext.broadcast(twice)

    def look(batches):
        pair = BloomPair(8)
        pair.bits, pair.twice = bits, np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column("text")):
                keys = list(keys_of(text.as_py(), least))
                if keys:
                    hashes = hashes_of(keys)
                    held = pair.seen_twice(hashes)
                    if waves > 1:
                        held &= _in_wave(hashes, wave, waves)
                    picked = np.flatnonzero(held)
                    found.extend(keys[i] for i in picked)
                    rows.extend([row] * len(picked))
            if rows:
                at = pa.array(rows, pa.int32())
                columns = [batch.column("id").take(at), batch.column("content").take(at), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "content", "key"])

    id_type = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(look, f"id {id_type}, content long, key binary")


def repeated_keys(documents: DataFrame, *, least: int = LEAST_KEY) -> DataFrame:
    """(id, content, digest): keys of a row that a smaller id holds too, as 128-bit digests.

    ``documents`` has (id, content, text as binary), ``content`` being a hash of the text. The keys' texts are
    what is grouped and joined; a digest only names a key within its own text. Suspects are combined map-side,
    and the keys in most rows are joined by broadcast, so that no key fills a task.
    """
    text = F.col("text").cast("string")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = documents.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    bits, waves = plan(lines)
    found = None
    for wave in range(waves):
        twice = _twice_filter(documents.select("text"), bits, wave, waves, least)
        part = stage(_suspects(documents, twice, bits, wave, waves, least), "suspects")
        found = part if found is None else found.unionByName(part)
    # A null id counts as one document, greater than all others.
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    repeats = stage(groups.where("first <> last").select("key", F.col("first.id").alias("first"), "n"), "repeats")
    bound = max(HEAVY, lines // HEAVY)
    heavy = broadcast_if_small(repeats.where(F.col("n") > bound).drop("n"), "heavy-keys", HEAVY)
    rest = found.join(heavy, "key", "left_anti").join(repeats.where(F.col("n") <= bound).drop("n"), "key")
    lost = rest.unionByName(found.join(heavy, "key")).where(~F.col("id").eqNullSafe(F.col("first")))
    return lost.select("id", "content", F.md5("key").alias("digest"))


def drop_repeated_lines(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, least: int = LEAST_KEY,
    lines: str = "n_lines", dropped: str = "n_dropped",
) -> DataFrame:
    """``documents`` with repeated lines taken out of the text, and columns for lines before and lines dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``least``
    code points that at least two ids hold lose all their lines but those of the smallest id, whose own
    repeats stay. A null text counts as empty, an empty one is one empty line, and both come out empty. Rows
    with one id are one document; null ids together are one, after all others. Repeated rows come out as often
    as they are there and other columns as they are; an added column whose name is taken gets underscores.
    """
    import hashlib

    new_text, digests, where, content, n_lines, n_dropped = (
        fresh(documents, name) for name in ("kept_text", "lost_digests", "lost_id", "lost_content", lines, dropped)
    )
    id_, text = (F.col(_reference(c)) for c in (id_column, text_column))
    hashed = F.xxhash64(F.coalesce(text, F.lit("")))
    lost = repeated_keys(documents.select(id_.alias("id"), hashed.alias("content"), text.cast("binary").alias("text")), least=least)
    # What a row loses depends on its id and key alone, so rows that share an id and a hash may share a list.
    lists = lost.groupBy(F.col("id").alias(where), F.col("content").alias(content)).agg(
        F.array_join(F.collect_set("digest"), "").alias(digests)
    )

    def keep(text: bytes | None, names: str | None) -> tuple[bytes, int, int]:
        all_lines = (text or b"").split(b"\n")
        if not names:
            return text or b"", len(all_lines), 0
        gone = {names[i : i + 32] for i in range(0, len(names), 32)}
        kept = [x for x in all_lines if not (long_enough(k := line_key(x), least) and hashlib.md5(k).hexdigest() in gone)]
        return b"\n".join(kept), len(all_lines), len(all_lines) - len(kept)

    fields = [pa.field("text", pa.binary()), pa.field("n_lines", pa.int64()), pa.field("n_dropped", pa.int64())]

    @F.arrow_udf("text binary, n_lines long, n_dropped long")
    def kept(texts: pa.Array, names: pa.Array) -> pa.Array:
        rows = [keep(t.as_py(), d.as_py()) for t, d in zip(texts, names)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], fields=fields)

    joined = documents.join(lists, id_.eqNullSafe(F.col(where)) & (hashed == F.col(content)), "left")
    done = joined.withColumn(new_text, kept(text.cast("binary"), F.col(digests)))
    columns = [
        F.col(f"{new_text}.text").cast("string").alias(c) if c == text_column else F.col(_reference(c)) for c in documents.columns
    ]
    return done.select(*columns, F.col(f"{new_text}.n_lines").alias(n_lines), F.col(f"{new_text}.n_dropped").alias(n_dropped))


def _reference(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"
