"""Toxicity as expected severity, by cumulative-link ordinal regression on sparse text features.

Grades run from 0 (not toxic) to ``GRADES``. All thresholds share one weight vector, so P(grade >= k) is
logistic(w.x - theta_k) with ascending theta, and the expected severity is the sum of these over k. Features
are words and beginnings of words that mark toxic documents in the labelled sample. Labels know only toxic or
not; the grade of a toxic document is the number of different marked words it holds, in steps.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from origintrace.llm.sampling import labelled_sample

#: Labelled documents to fit on, about, at most; features, at most.
FIT_DOCUMENTS, MAX_FEATURES = 8000, 4096
#: A feature is in so many times more of the toxic than of the other documents, and in this share of the toxic ones.
LEAST_RATIO, LEAST_SHARE = 15.0, 0.008
GRADES, STEPS = 3, (2, 4)
THRESHOLD = 0.5
HELD_OUT_FOLD = 0
PREFIXES = (4, 5, 6)
_BLANKS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Words without features that a Python worker remembers, at most.
_REMEMBERED = 150_000


def words_of(text: str | None) -> set[bytes]:
    """The different words of a text, lower-cased; letters, digits and everything outside ASCII make words."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split())


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings (``<`` marks a whole word, which no word holds)."""
    return [b"<" + word, *[word[:n] for n in PREFIXES if len(word) >= n]]


@dataclass(frozen=True)
class OrdinalModel:
    """Feature numbers, shared weights, ascending thresholds. Without thresholds, every severity is ``constant``."""

    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray
    constant: float = 0.0
    _plain: set = field(default_factory=set, compare=False)

    def active(self, text: str | None) -> tuple[set[int], int]:
        """The features of a text, and how many of its words have any."""
        found, marked = set(), 0
        unknown = words_of(text).difference(self._plain)
        for word in unknown:
            mine = [i for f in features_of(word) if (i := self.features.get(f)) is not None]
            if mine:
                found.update(mine)
                marked += 1
            else:
                self._plain.add(word)
        if len(self._plain) > _REMEMBERED:
            self._plain.clear()
        return found, marked

    def severity_of(self, active: set[int]) -> float:
        if not len(self.thresholds):
            return self.constant
        z = float(self.weights[sorted(active)].sum()) if active else 0.0
        return float((1 / (1 + np.exp(self.thresholds - z))).sum())

    def severity(self, text: str | Column) -> Column:
        """Expected severity of a text column, 0 to ``GRADES``; null counts as empty."""

        @F.pandas_udf("double")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series([self.severity_of(self.active(t)[0]) for t in texts], dtype="float64")

        return of(text)


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, size: int, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on all rows at once."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], dtype=np.int64)
    above = grades[:, None] >= np.arange(1, GRADES + 1)
    rate = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    base = -np.log(rate / (1 - rate))
    value = np.concatenate([np.zeros(size), [base[0]], np.log(np.maximum(np.diff(base), 0.05))])
    m, v = np.zeros_like(value), np.zeros_like(value)
    edge = lambda p: np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
    for step in range(1, steps + 1):
        gaps = np.exp(value[size + 1 :])
        theta = value[size] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, value[:size][col], len(rows))
        p = 1 / (1 + np.exp(np.clip(theta - z[:, None], -40, 40)))  # P(grade >= k)
        full, density = edge(p), np.pad(p * (1 - p), ((0, 0), (1, 1)))
        at = np.arange(len(rows))
        mass = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        # d log mass / d (z - theta_k): up at the grade's own edge, down at the next one
        own, following = density[at, grades] / mass, density[at, grades + 1] / mass
        slope_z = -(own - following) / len(rows)
        slope_theta = np.zeros(GRADES + 2)
        np.add.at(slope_theta, grades, own / len(rows))
        np.add.at(slope_theta, grades + 1, -following / len(rows))
        slope_theta = slope_theta[1:-1]
        tail = np.cumsum(slope_theta[::-1])[::-1]
        slope = np.concatenate([np.bincount(col, slope_z[row], size) + ridge * value[:size], [tail[0]], tail[1:] * gaps])
        m += 0.1 * (slope - m)
        v += 0.01 * (slope**2 - v)
        value = value - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return value[:size], value[size] + np.concatenate([[0], np.cumsum(np.exp(value[size + 1 :]))])


def _marks(sample: DataFrame, n_toxic: int, n_other: int) -> list[bytes]:
    """The features that mark toxic documents, counted on the executors, strongest first."""

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                seen[int(label >= 1)].update({f for w in words_of(text) for f in features_of(w)})
        keys = list(seen[1])
        yield pd.DataFrame({"feature": keys, "toxic": [seen[1][k] for k in keys], "other": [0] * len(keys)})
        keys = list(seen[0])
        yield pd.DataFrame({"feature": keys, "toxic": [0] * len(keys), "other": [seen[0][k] for k in keys]})

    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("other") + 0.5) / (n_other + 1))
    rows = (
        sample.mapInPandas(count, "feature binary, toxic long, other long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where((F.col("toxic") >= max(3, LEAST_SHARE * n_toxic)) & (ratio >= LEAST_RATIO))
        .orderBy((F.col("toxic") * F.log(ratio)).desc(), "feature").limit(MAX_FEATURES).collect()
    )
    return [bytes(r.feature) for r in rows]


def fit(documents: DataFrame, labels: DataFrame, bound: int = FIT_DOCUMENTS) -> OrdinalModel:
    """A model from about ``bound`` labelled documents at most, none of the held-out fold.

    Without toxic documents every severity is 0, and with toxic ones only it is 1.
    """
    sample = labelled_sample(documents, labels, "toxic", HELD_OUT_FOLD, bound)
    toxic, other = sample.agg(F.count_if(F.col("label") >= 1), F.count_if(F.col("label") < 1)).first()
    if not toxic or not other:
        return OrdinalModel({}, np.zeros(0), np.zeros(0), float(bool(toxic)))
    features = {f: i for i, f in enumerate(_marks(sample, toxic, other))}
    shape = OrdinalModel(features, np.zeros(len(features)), np.zeros(0))

    @F.pandas_udf("active array<int>, marked int")
    def active(texts: pd.Series) -> pd.DataFrame:
        found = [shape.active(t) for t in texts]
        return pd.DataFrame({"active": [sorted(a) for a, _ in found], "marked": [n for _, n in found]})

    # Sorted here, as most rows are alike and a sort by range would put them into one task; the sample is bounded.
    rows = sample.select(active("text").alias("f"), "label").select("f.*", "label").collect()
    rows.sort(key=lambda r: (r.label, r.marked, r.active))
    marked = np.array([r.marked for r in rows])
    grades = np.where(np.array([r.label for r in rows]) >= 1, 1 + sum(marked >= s for s in STEPS), 0)
    return OrdinalModel(features, *fit_ordinal([list(r.active) for r in rows], grades, len(features)))
