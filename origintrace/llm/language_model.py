"""Log-probabilities of texts from a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The most frequent words fall into classes
by rank, all others into classes by their last letters. Both softmaxes are log-linear in features of the
context: the word before, the one before that (skipping one), and both together, hashed into a bounded table.
Within a class of other words a word has its smoothed share of the class. Training goes over all training
documents in rounds: every task updates its own copy of the weights on its part of the round's documents, and
the changes are averaged. Scoring works on sparse batches: every different context is computed once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from origintrace.llm.sampling import fold
from origintrace.sources.staging import stage

HELD_OUT_FOLD = 1
#: Frequent words and their classes; classes of other words; words with broadcast counts, at most.
HEAD, SLOTS, TAIL = 1024, 32, 32
LOOKUP = 1 << 17
#: Rows of hashed features: pairs of words for the class, word and class for the word.
PAIR_ROWS, WORD_ROWS = 1 << 13, 1 << 13
#: Passes (each over its part of the texts), tokens of an update, step, and squared slope a weight starts with.
ROUNDS, BATCH_TOKENS, RATE, DAMPING = 2, 1 << 16, 0.4, 100.0
#: Blocks of the weights that are averaged apart, partial averages of each, distinct words counted at a time.
SHARDS, PARTIAL, FLUSH = 8, 64, 400_000
END = b""
CLASSES = HEAD // SLOTS + TAIL
SYMBOLS = HEAD + TAIL
START = SYMBOLS
_FAR = -25.0


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


@dataclass
class Weights:
    """All tables as rows of one matrix of ``CLASSES`` columns, so they travel and average as one."""

    matrix: np.ndarray

    ROWS = 1 + 2 * (SYMBOLS + 1) + PAIR_ROWS + (HEAD // SLOTS + WORD_ROWS) * SLOTS // CLASSES

    @classmethod
    def zero(cls) -> "Weights":
        return cls(np.zeros((cls.ROWS, CLASSES), dtype=np.float32))

    def _rows(self, start: int, rows: int, width: int = CLASSES) -> np.ndarray:
        return self.matrix[start : start + rows * width // CLASSES].reshape(rows, width)

    @property
    def bias(self):
        return self._rows(0, 1)

    @property
    def before(self):
        return self._rows(1, SYMBOLS + 1)

    @property
    def skipped(self):
        return self._rows(1 + SYMBOLS + 1, SYMBOLS + 1)

    @property
    def pairs(self):
        return self._rows(1 + 2 * (SYMBOLS + 1), PAIR_ROWS)

    @property
    def word_bias(self):
        return self._rows(1 + 2 * (SYMBOLS + 1) + PAIR_ROWS, HEAD // SLOTS, SLOTS)

    @property
    def words(self):
        return self._rows(1 + 2 * (SYMBOLS + 1) + PAIR_ROWS + HEAD // SLOTS * SLOTS // CLASSES, WORD_ROWS, SLOTS)


def _hashed(x: np.ndarray, rows: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % rows


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Batch:
    """Tokens of several texts with their different contexts: (one before, one skipped) and (one before, class)."""

    def __init__(self, symbols: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in symbols])
        target = np.concatenate(symbols).astype(np.int64)
        begins = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[START], target[:-1]])
        before[begins] = START
        skipped = np.concatenate([[START, START], target[:-2]])[: len(target)]
        skipped[begins] = START
        skipped[begins[self.sizes > 1] + 1] = START
        contexts, self.context = np.unique(before * (SYMBOLS + 1) + skipped, return_inverse=True)
        self.before, self.skipped = np.divmod(contexts, SYMBOLS + 1)
        self.pair = _hashed(contexts, PAIR_ROWS)
        self.is_head = target < HEAD
        self.target_class = np.where(self.is_head, target // SLOTS, target - HEAD + HEAD // SLOTS)
        head, head_class = target[self.is_head], self.target_class[self.is_head]
        word_contexts, self.word_context = np.unique(before[self.is_head] * (HEAD // SLOTS) + head_class, return_inverse=True)
        self.word_class, self.word_row = word_contexts % (HEAD // SLOTS), _hashed(word_contexts, WORD_ROWS)
        self.slot, self.target = head % SLOTS, target

    def class_scores(self, w: Weights) -> np.ndarray:
        return _log_softmax(w.bias + w.before[self.before] + w.skipped[self.skipped] + w.pairs[self.pair])

    def word_scores(self, w: Weights) -> np.ndarray:
        return _log_softmax(w.word_bias[self.word_class] + w.words[self.word_row])

    def log_probabilities(self, w: Weights) -> np.ndarray:
        """Natural logarithm of P(class) of every token, times P(word | class) for frequent words."""
        out = self.class_scores(w)[self.context, self.target_class].astype(np.float64)
        if len(self.slot):
            out[self.is_head] += self.word_scores(w)[self.word_context, self.slot]
        return out

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.cumsum(self.sizes) - self.sizes)


class Trainer:
    """Adagrad on one task's copy of the weights; the biases stay at the shares that were counted."""

    def __init__(self, weights: Weights):
        self.w = Weights(weights.matrix.copy())
        self.squares = Weights(np.full_like(weights.matrix, DAMPING))

    def _step(self, table: np.ndarray, squares: np.ndarray, row: np.ndarray, slope: np.ndarray) -> None:
        order = np.argsort(row, kind="stable")
        row = row[order]
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total, row = np.add.reduceat(slope[order], begins, axis=0), row[begins]
        squares[row] += total**2
        table[row] -= RATE * total / np.sqrt(squares[row])

    def _slope(self, log_p: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        n, width = log_p.shape
        slope = np.exp(log_p) * np.bincount(context, minlength=n)[:, None].astype(np.float32)
        slope -= np.bincount(context * width + target, minlength=n * width).reshape(n, width).astype(np.float32)
        return slope.astype(np.float32)

    def update(self, b: Batch) -> None:
        w, s = self.w, self.squares
        slope = self._slope(b.class_scores(w), b.context, b.target_class)
        word_slope = self._slope(b.word_scores(w), b.word_context, b.slot) if len(b.slot) else None
        self._step(w.before, s.before, b.before, slope)
        self._step(w.skipped, s.skipped, b.skipped, slope)
        self._step(w.pairs, s.pairs, b.pair, slope)
        if word_slope is not None:
            self._step(w.words, s.words, b.word_row, word_slope)


def batches_of(symbols, limit: int = BATCH_TOKENS):
    """Lists of symbol arrays of about ``limit`` tokens; a longer text is a list of its own."""
    held, size = [], 0
    for i, s in enumerate(symbols):
        held.append((i, np.frombuffer(s, dtype=np.uint16)))
        size += len(held[-1][1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class Vocabulary:
    """Counts of frequent words, their symbols, and the statistics of all classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, tail_tokens: np.ndarray, tail_words: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts = [words[i] for i in order], counts[order]
        self.total, self.distinct = total, distinct
        n = min(HEAD, len(words))
        self.symbols = np.concatenate([np.arange(n), [HEAD + tail_class(w) for w in self.words[n:]]]).astype(np.uint16)
        self.head_counts = np.zeros(HEAD)
        self.head_counts[:n] = self.counts[:n]
        # the head's words are not in the classes of other words
        for w, c in zip(self.words[:n], self.counts[:n]):
            tail_tokens[tail_class(w)] -= c
            tail_words[tail_class(w)] -= 1
        self.tail_tokens = tail_tokens
        self.tail_floor = np.log10(tail_tokens + 0.5 * (tail_words + 1))
        self.logs = np.log10(self.counts + 0.5)

    def first_weights(self) -> Weights:
        """The model without context: shares of classes, and of words in their class."""
        w = Weights.zero()
        by_class = self.head_counts.reshape(-1, SLOTS)
        mass = np.concatenate([by_class.sum(axis=1), self.tail_tokens]) + 0.5
        present = np.concatenate([by_class.sum(axis=1) > 0, np.ones(TAIL, dtype=bool)])
        w.bias[:] = np.where(present, np.log(mass / mass.sum()), _FAR)
        share = np.log(np.maximum(by_class, 1e-9) / np.maximum(by_class.sum(axis=1, keepdims=True), 1e-9))
        w.word_bias[:] = np.where(by_class > 0, share, _FAR)
        return w


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _count(documents: DataFrame) -> DataFrame:
    """(word, cls, c): how often each word is in ``documents``, the end included."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pd.DataFrame({"word": list(seen), "cls": [tail_class(w) for w in seen], "c": list(seen.values())})

        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text))
                if len(seen) >= FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    counted = documents.select("text").mapInPandas(count, "word binary, cls int, c long")
    return counted.groupBy("word", "cls").agg(F.sum("c").alias("c"))


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, float]:
    """The vocabulary, and the least count level of a word whose count is broadcast."""
    level = F.floor(F.log2("c") * 16)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # some hundreds at any size
    least, n = float("inf"), 0
    for r in levels:
        n += r.n
        if n > LOOKUP:
            break
        least = r.level
    frequent = counts.where(level >= F.lit(least)).select("word", "c").collect()
    tail_tokens, tail_words = np.zeros(TAIL), np.zeros(TAIL)
    for r in counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tail_tokens[r.cls], tail_words[r.cls] = r.c, r.n
    total, distinct = int(tail_tokens.sum()), int(tail_words.sum())
    words = [bytes(r.word) for r in frequent]
    return Vocabulary(words, np.array([r.c for r in frequent], dtype=np.int64), total, distinct, tail_tokens, tail_words), least


def _encode(documents: DataFrame, shared) -> DataFrame:
    """Texts as symbols, with what the broadcast counts tell; words beyond them as a list."""
    cache = {}

    def encode(batches):
        v = shared.value
        index = cache.setdefault("index", _Index(zip(v.words, range(len(v.words)))))
        symbols, logs = np.append(v.symbols, np.uint16(0)), np.append(v.logs, 0.0)
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part, rows = batch.iloc[k : k + 1000], []
                for doc, held_out, text in zip(part["doc_id"], part["held_out"], part["text"]):
                    words = words_of(text)
                    at = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
                    s, unknown = symbols[at], np.flatnonzero(at < 0)
                    rare = [words[i] for i in unknown]
                    s[unknown] = [HEAD + tail_class(w) for w in rare]
                    known_logs = logs[at]
                    rows.append((
                        doc, held_out, s.tobytes(), len(words), len(words) - len(rare), float(known_logs.sum()),
                        float(known_logs[s >= HEAD].sum()), rare,
                    ))
                yield pd.DataFrame(rows, columns=["doc_id", "held_out", "symbols", "n_tokens", "known", "logs", "tail_logs", "rare"])

    return documents.mapInPandas(
        encode, "doc_id string, held_out boolean, symbols binary, n_tokens long, known long, logs double, tail_logs double, rare array<binary>"
    )


def _train_round(texts: DataFrame, weights: Weights) -> Weights:
    """Weights after one pass over ``texts`` (symbols): each row moves by the mean change of the tasks that touched it."""
    shared = texts.sparkSession.sparkContext.broadcast(weights.matrix)
    borders = np.linspace(0, Weights.ROWS, SHARDS + 1).astype(int)

    def train(batches):
        start = Weights(shared.value)
        trainer, seen = Trainer(start), False
        for batch in batches:
            for held in batches_of(batch["symbols"]):
                trainer.update(Batch([s for _, s in held]))
                seen = True
        if seen:
            change = trainer.w.matrix - start.matrix
            touched = np.any(change != 0, axis=1).astype(np.float32)
            yield pd.DataFrame({
                "shard": range(SHARDS), "change": [change[a:b].tobytes() for a, b in zip(borders, borders[1:])],
                "touched": [touched[a:b].tobytes() for a, b in zip(borders, borders[1:])],
            })

    def add(key, pdf):
        total = [sum((np.frombuffer(x, dtype=np.float32) for x in pdf[c]), np.float32(0)).astype(np.float32).tobytes() for c in ("change", "touched")]
        return pd.DataFrame({"shard": [int(key[0])], "change": [total[0]], "touched": [total[1]]})

    row = "shard int, change binary, touched binary"
    changes = texts.select("symbols").mapInPandas(train, row).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTIAL)))
    partial = changes.groupBy("shard", "part").applyInPandas(add, row)
    new = weights.matrix.copy()
    for r in partial.groupBy("shard").applyInPandas(add, row).collect():  # one model
        a, b = borders[r.shard], borders[r.shard + 1]
        touched = np.maximum(np.frombuffer(r.touched, dtype=np.float32), 1)[:, None]
        new[a:b] += np.frombuffer(r.change, dtype=np.float32).reshape(b - a, CLASSES) / touched
    return Weights(new)


def _score(texts: DataFrame, weights: Weights, tail_floor: np.ndarray) -> DataFrame:
    """(uid, part): log10 probability of each text, but for the logarithms of the counts of other words."""
    shared = texts.sparkSession.sparkContext.broadcast((weights.matrix, tail_floor))

    def score(batches):
        matrix, floor = shared.value
        w = Weights(matrix)
        for batch in batches:
            part = np.zeros(len(batch))
            for held in batches_of(batch["symbols"]):
                b = Batch([s for _, s in held])
                values = b.log_probabilities(w) / np.log(10)
                values[~b.is_head] -= floor[b.target[~b.is_head] - HEAD]
                part[[i for i, _ in held]] = b.per_text(values)
            yield pd.DataFrame({"uid": batch["uid"], "part": part})

    return texts.select("uid", "symbols").mapInPandas(score, "uid long, part double")


def score_corpus(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``documents``.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's; both count the end. The
    fold ``HELD_OUT_FOLD`` of five is held out of counts and training. A null text is empty, a null id is
    not held out. Repeated rows are scored each. Without training texts both scores rest on one unseen word.
    """
    kind = documents.schema[id_column].dataType
    rows = documents.select(
        F.col(id_column).cast("string").alias("doc_id"), F.coalesce(fold(F.col(id_column)) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    counts = stage(_count(rows.where(~F.col("held_out"))), "word-counts")
    vocabulary, least = _vocabulary(counts)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    texts = stage(_encode(rows, shared).withColumn("uid", F.monotonically_increasing_id()), "symbols")

    weights = vocabulary.first_weights()
    turn = F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(ROUNDS))
    for i in range(ROUNDS):
        weights = _train_round(texts.where(~F.col("held_out") & (turn == i)), weights)

    # what lies beyond the broadcast counts: one row for each such word of a text, joined to its count
    rare_counts = counts.where(F.floor(F.log2("c") * 16) < F.lit(least)).select("word", "c")
    lookups = texts.select("uid", F.explode("rare").alias("word")).join(rare_counts, "word", "left")
    rare = lookups.groupBy("uid").agg(
        F.count("c").alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs")
    )
    found = texts.drop("symbols", "rare").join(_score(texts, weights, vocabulary.tail_floor), "uid").join(rare, "uid", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    denominator = float(np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1)))
    return found.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("part") + F.col("tail_logs") + rare_logs).alias("score"),
    )
