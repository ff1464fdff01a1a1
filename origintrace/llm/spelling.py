"""Spelling variants: words one edit apart, found by k-d trees over counts of letters.

A word's vector counts each of its letters. One inserted or deleted letter changes one count by one, a replaced
letter raises one count and lowers another, so words one edit apart are at L1 distance two at most, and it is known
what is too many and what too few. A search therefore leaves a box of vectors once more than that is missing
or left over. Words of one length are searched against those of the same length (replacement) and of one letter
less (deletion, and seen from the other side insertion); what a search finds is verified letter by letter.

Two trees are used. The upper ones, one for each length, are cut on a bounded sample of words and deal all words
to cells; a word is sent to every cell whose box its search can reach, which are few, as a search crosses at most one
cut upwards and one downwards. In a cell, a tree over all its words is built. Cells larger than planned are cut
into a grid, so no task holds more than a bounded number of words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from origintrace.sources.staging import stage

#: Latin-1 codes of letters: A-Z, a-z, and 192 to 255 as they are; and letters as dimensions of a vector.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
DIMENSIONS = len(LETTERS)
_TO_LETTER = bytes(c if c in LETTERS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_DIMENSION = np.array([LETTERS.index(c) if c in LETTERS else 0 for c in range(256)], dtype=np.int64)
#: Different words that a task counts before it hands its counts on.
COUNTED = 300_000
#: Words of a cell on one side of its grid, words of a leaf, words the upper trees are cut on, lengths with a tree of their own.
CELL, LEAF, SAMPLE, LONGEST = 8192, 64, 1 << 16, 40
#: Words turned into vectors at a time, and letters of candidate pairs compared at a time.
VECTORS, COMPARED = 4096, 1 << 22


# --- words --------------------------------------------------------------------------------------------
def runs(text: str | None) -> list[bytes]:
    """Maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF in Latin-1, with A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_TO_LETTER).split()


def noised(counts: dict[bytes, int], name: str, every: int):
    """(word, count), where a word loses a letter if ``every`` divides the CRC-32 of ``name:word``."""
    start = crc32(f"{name}:".encode())
    for word, n in counts.items():
        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, shortest: int = 5, least: int = 3, noise: int = 0
) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur ``least`` times in all texts together.

    With ``noise``, a word of a document loses one letter if ``noise`` divides the CRC-32 of ``id:word`` (a null id is an
    empty name). A null text has no words. Repeated rows count each time; other columns are not read.
    """
    rows, counted_at_once = documents.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.col(text_column)), COUNTED

    def count(batches):
        totals = defaultdict(int)

        def handed_on():
            out = pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode("latin-1") for w in totals], pa.string()), "n": pa.array(list(totals.values()), pa.int64())
            })
            totals.clear()
            return out

        for batch in batches:
            for name, text in zip(*batch.columns):
                counts = {w: n for w, n in Counter(runs(text.as_py())).items() if len(w) >= shortest}
                for word, n in noised(counts, name.as_py(), noise) if noise else counts.items():
                    if len(word) >= shortest:
                        totals[word] += n
                if len(totals) >= counted_at_once:
                    yield handed_on()
        if totals:
            yield handed_on()

    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """One row per word. Counts end at 255, which makes no distance greater."""
    out = np.empty((len(words), DIMENSIONS), dtype=np.uint8)
    for i in range(0, len(words), VECTORS):
        part = words[i : i + VECTORS]
        at = np.repeat(np.arange(len(part)) * DIMENSIONS, [len(w) for w in part])
        places = at + _DIMENSION[np.frombuffer(b"".join(part), dtype=np.uint8)]
        counts = np.bincount(places, minlength=len(part) * DIMENSIONS)
        out[i : i + len(part)] = np.minimum(counts, 255).reshape(len(part), DIMENSIONS)
    return out


def best_cut(vectors: np.ndarray) -> tuple[int, int] | None:
    """(dimension, value) that deals vectors most evenly into those up to the value and those above.

    None if every cut leaves less than one in 64 on a side: such vectors are nearly equal and are compared as they are.
    """
    most, found = max(0, len(vectors) // 64 - 1), None
    for value in range(int(vectors.max(initial=0))):
        up_to = (vectors <= value).sum(axis=0)
        smaller = np.minimum(up_to, len(vectors) - up_to)
        best = int(smaller.argmax())
        if smaller[best] > most:
            most, found = int(smaller[best]), (best, value)
        if found and value >= 2 and 4 * most >= len(vectors):
            break
    return found


# --- upper trees ---------------------------------------------------------------------------------------
@dataclass
class Cut:
    """Inner node of an upper tree: up to ``value`` of ``dimension`` go to ``low``. A leaf is the number of its cell."""

    dimension: int
    value: int
    low: "Cut | int"
    high: "Cut | int"


class UpperTrees:
    """A tree of cells for every length; lengths from ``LONGEST`` on share one."""

    def __init__(self, sample: list[bytes], counts: dict[int, int]):
        """``counts`` has the number of all words by length class. Classes without sampled words get one cell."""
        self.cells = 0
        by_class = defaultdict(list)
        for word in sample:
            by_class[self.length_class(len(word))].append(word)
        self.roots = {}
        for length, n in sorted(counts.items()):
            words = by_class[length]
            share = n / len(words) if words else 0
            self.roots[length] = self._grow(letter_counts(words), share)

    @staticmethod
    def length_class(length: int) -> int:
        return min(length, LONGEST)

    def _grow(self, vectors: np.ndarray, share: float) -> Cut | int:
        cut = best_cut(vectors) if len(vectors) * share > CELL and len(vectors) >= 32 else None
        if cut is None:
            self.cells += 1
            return self.cells - 1
        low = vectors[:, cut[0]] <= cut[1]
        return Cut(*cut, self._grow(vectors[low], share), self._grow(vectors[~low], share))

    def home(self, vectors: np.ndarray, length: int) -> np.ndarray:
        """The cell of every vector, all of one length class."""
        cells = np.empty(len(vectors), dtype=np.int64)
        waiting = [(self.roots[length], np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if isinstance(node, int):
                cells[rows] = node
            else:
                low = vectors[rows, node.dimension] <= node.value
                waiting += [(node.low, rows[low]), (node.high, rows[~low])]
        return cells

    def reached(self, vectors: np.ndarray, length: int, more: int, less: int):
        """(cell, rows): vectors from which a member with at most ``more`` and ``less`` letters of difference may lie in the cell."""
        start = np.zeros(len(vectors), dtype=np.int64)
        waiting = [(self.roots[length], np.arange(len(vectors)), start, start, {}, {})]
        while waiting:
            node, rows, up, down, floor, ceiling = waiting.pop()
            if isinstance(node, int):
                yield node, rows
                continue
            d, t, have = node.dimension, node.value, vectors[rows, node.dimension].astype(np.int64)
            # Below, letters beyond the cut are too many; above, those up to it are too few. Only the tightest bound counts.
            too_many = down + np.maximum(have - t, 0) - np.maximum(have - ceiling.get(d, 255), 0)
            too_few = up + np.maximum(t + 1 - have, 0) - np.maximum(floor.get(d, 0) - have, 0)
            low, high = too_many <= less, too_few <= more
            if low.any():
                waiting.append((node.low, rows[low], up[low], too_many[low], floor, ceiling | {d: t}))
            if high.any():
                waiting.append((node.high, rows[high], too_few[high], down[high], floor | {d: t + 1}, ceiling))


# --- search in a cell ----------------------------------------------------------------------------------
class LetterTree:
    """k-d tree over letter counts with the tight box of every node."""

    def __init__(self, vectors: np.ndarray):
        self.used = np.flatnonzero(vectors.any(axis=0))
        self.vectors = vectors[:, self.used]
        self.root = self._grow(np.arange(len(vectors)))

    def _grow(self, rows: np.ndarray):
        here = self.vectors[rows]
        box = here.min(axis=0).astype(np.int16), here.max(axis=0).astype(np.int16)
        cut = best_cut(here) if len(rows) > LEAF else None
        if cut is None:
            return box, rows, None
        low = here[:, cut[0]] <= cut[1]
        return box, rows, (self._grow(rows[low]), self._grow(rows[~low]))

    def near(self, vectors: np.ndarray, more: int, less: int):
        """(search, member) arrays of vectors within reach: at most ``more`` letters too few and ``less`` too many."""
        here = vectors[:, self.used]
        # Letters that no member has are too many for every member.
        outside = vectors.sum(axis=1, dtype=np.int64) - here.sum(axis=1, dtype=np.int64)
        wide, real = here.astype(np.int16), here.astype(np.float32)
        squares, outer = (real * real).sum(axis=1), outside.astype(np.float32) ** 2
        waiting = [(self.root, np.flatnonzero(outside <= less))]
        while waiting:
            ((floor, ceiling), rows, below), searches = waiting.pop()
            many = np.maximum(wide[searches] - ceiling, 0).sum(axis=1) + outside[searches]
            few = np.maximum(floor - wide[searches], 0).sum(axis=1)
            searches = searches[(many <= less) & (few <= more)]
            if not len(searches):
                continue
            if below is not None:
                waiting += [(child, searches) for child in below]
                continue
            step = max(1, COMPARED // len(rows))
            members = self.vectors[rows].astype(np.float32)
            lengths = (members * members).sum(axis=1)
            for i in range(0, len(searches), step):
                part = searches[i : i + step]
                apart = (squares[part] + outer[part])[:, None] + lengths - 2 * (real[part] @ members.T)
                s, m = np.nonzero(apart < more + less + 0.5)
                yield part[s], rows[m]


def spelled(words: list[bytes], length: int) -> np.ndarray:
    """Letters of words of one length, a row each."""
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), length)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_deleted(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether the rows of ``longer`` lose one letter to become those of ``shorter``: equal beginnings and ends cover them."""
    length = shorter.shape[1]
    ahead = np.logical_and.accumulate(longer[:, :length] == shorter, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= length


class Best:
    """For words of one side, how many near words were met and the best of them, by rank among the other side."""

    def __init__(self, size: int):
        self.n, self.rank = np.zeros(size, dtype=np.int64), np.full(size, np.iinfo(np.int64).max)

    def meet(self, rows: np.ndarray, ranks: np.ndarray) -> None:
        np.add.at(self.n, rows, 1)
        np.minimum.at(self.rank, rows, ranks)


def near_in_cell(members: list[bytes], member_n: np.ndarray, searches: list[bytes], search_n: np.ndarray):
    """(word, near words, n of the best, the best) for the words that are near one of the other side.

    Members as long as a search count for the search. Those one letter shorter count for it, and it for them, as the
    cells of longer words are not searched. The best near word has the largest n, and is the least of those.
    """

    def by_rank(words, n):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        return order, rank

    m_order, m_rank = by_rank(members, member_n)
    s_order, s_rank = by_rank(searches, search_n)
    m_length, s_length = (np.array([len(w) for w in words], dtype=np.int64) for words in (members, searches))
    for_search, for_member = Best(len(searches)), Best(len(members))
    for length in np.unique(m_length):
        at = np.flatnonzero(m_length == length)
        tree = LetterTree(letter_counts([members[i] for i in at]))
        m_letters = spelled([members[i] for i in at], length)
        for longer, (more, less), test in ((0, (1, 1), one_replaced), (1, (0, 1), one_deleted)):
            by = np.flatnonzero(s_length == length + longer)
            if not len(by):
                continue
            s_words = [searches[i] for i in by]
            s_letters = spelled(s_words, length + longer)
            for s, m in tree.near(letter_counts(s_words), more, less):
                step = max(1, COMPARED // int(length + 1))
                for i in range(0, len(s), step):
                    a, b = s[i : i + step], m[i : i + step]
                    true = test(s_letters[a], m_letters[b])
                    a, b = by[a[true]], at[b[true]]
                    for_search.meet(a, m_rank[b])
                    if longer:
                        for_member.meet(b, s_rank[a])
    for words, best, others, others_n, order in (
        (searches, for_search, members, member_n, m_order), (members, for_member, searches, search_n, s_order)
    ):
        for i in np.flatnonzero(best.n):
            j = order[best.rank[i]]
            yield words[i], int(best.n[i]), int(others_n[j]), others[j]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for every word of ``words`` (word, n) that has a near one."""
    words = stage(words.select("word", "n"), "words")
    length = F.least(F.length("word"), F.lit(LONGEST))
    counts = {r.length: r.n for r in words.groupBy(length.alias("length")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return words.selectExpr("word", "n as n_near", "n as best_n", "word as best")
    # Words are taken by hash; without the longest ones the sample's size does not depend on the data.
    total, wide = sum(counts.values()), 1 << 30
    taken = F.pmod(F.xxhash64("word", F.lit(29)), F.lit(wide)) < int(min(1, SAMPLE / total) * wide)
    sample = [r.word.encode("latin-1") for r in words.where(taken & (F.length("word") < 2 * LONGEST)).select("word").limit(2 * SAMPLE).collect()]
    trees = UpperTrees(sorted(sample), counts)

    def by_class(batch):
        listed = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        classes = np.array([trees.length_class(len(w)) for w in listed], dtype=np.int64)
        for c in np.unique(classes):
            rows = np.flatnonzero(classes == c)
            yield int(c), rows, letter_counts([listed[i] for i in rows])

    def settle(batches):
        for batch in batches:
            cells = np.empty(len(batch), dtype=np.int64)
            for c, rows, vectors in by_class(batch):
                cells[rows] = trees.home(vectors, c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["word", "n", "home"])

    settled = stage(words.mapInArrow(settle, "word string, n long, home long"), "words-in-cells")
    # One number for each cell, and cells are bounded by the sample.
    sides = np.ones(trees.cells, dtype=np.int64)
    for r in settled.groupBy("home").agg(F.count("*").alias("n")).collect():
        sides[r.home] = -(-r.n // CELL)

    def send(batches):
        names = ["cell", "part", "slice", "member", "word", "n"]

        def sent(batch, rows, cells, hashes, member):
            """Members go to the slices of their part of the cell's grid, searches to the parts of their slice."""
            n = sides[cells]
            every = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows, cells, n = np.repeat(rows, n), np.repeat(cells, n), np.repeat(n, n)
            own = hashes[rows] % n
            part, piece = (own, every) if member else (every, own)
            taken = batch.select(["word", "n"]).take(pa.array(rows))
            arrays = [pa.array(cells), pa.array(part), pa.array(piece), pa.array(np.full(len(rows), member)), *taken.columns]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            hashes = np.array([crc32(w.encode()) for w in batch.column("word").to_pylist()], dtype=np.int64)
            home = batch.column("home").to_numpy(zero_copy_only=False)
            yield sent(batch, np.arange(len(batch)), home, hashes, True)
            for c, rows, vectors in by_class(batch):
                for cell, at in trees.reached(vectors, c, 1, 1):
                    yield sent(batch, rows[at], np.full(len(at), cell), hashes, False)
                if c - 1 in trees.roots:  # words of one letter less; long words share a tree, which was just searched
                    for cell, at in trees.reached(vectors, c - 1, 0, 1):
                        yield sent(batch, rows[at], np.full(len(at), cell), hashes, False)

    rows = settled.mapInArrow(send, "cell long, part long, slice long, member boolean, word string, n long")

    def search(table: pa.Table) -> pa.Table:
        member = np.asarray(table["member"].to_pylist(), dtype=bool)
        listed, n = [w.encode("latin-1") for w in table["word"].to_pylist()], table["n"].to_numpy()
        inside, others = np.flatnonzero(member), np.flatnonzero(~member)
        found = list(near_in_cell([listed[i] for i in inside], n[inside], [listed[i] for i in others], n[others]))
        columns = list(zip(*found)) or [()] * 4
        return pa.table({
            "word": pa.array([w.decode("latin-1") for w in columns[0]], pa.string()), "n_near": pa.array(columns[1], pa.int64()),
            "best_n": pa.array(columns[2], pa.int64()), "best": pa.array([w.decode("latin-1") for w in columns[3]], pa.string()),
        })

    found = rows.groupBy("cell", "part", "slice").applyInArrow(search, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best")
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of the path that starts with each word's ``form``; ``links`` (word, form) has no cycle.

    Every round doubles the steps that a row has taken, so a path of n steps takes log2 n rounds.
    """
    paths = stage(links.select("word", F.col("form").alias("root")), "paths")
    while True:
        further = paths.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = paths.join(further, F.col("root") == F.col("at"), "left")
        moved = stage(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "paths")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        paths = moved.select("word", "root")


def variants(words: DataFrame, *, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words`` (word, n).

    Two words are near if one inserted, deleted or replaced letter makes one of them the other. ``form`` is the near
    word of largest n (the least in code-point order of several), if its n is at least ``times`` (two or more) that of the word;
    ``root`` follows forms to the last one and is the word itself where there is no form. ``words`` must hold a word once, of
    the letters that ``runs`` takes; an empty table gives no rows.
    """
    words = stage(words.select("word", "n"), "words")
    near = near_words(words)
    formed = F.col("best_n") >= times * F.col("n")
    known = stage(words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    ), "forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
