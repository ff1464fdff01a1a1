"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is good or bad. Its score comes from its own form and from that of the lines
beside it; a transition score ties it to its neighbours' labels. Labels are known for documents only: a line
takes that of its document. Forward-backward gives each line's probability to be good; their mean, weighted
by line length, is mapped to the probability that the document is labelled good.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from origintrace.llm.sampling import labelled_sample

#: Labelled documents to fit on, at most (about, as they are taken by hash).
FIT_DOCUMENTS = 3000
THRESHOLD = 0.3
HELD_OUT_FOLD = 0

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\r\x0b\x0c"
_USUAL = b".,;:?'\"-()"
_ODD = bytes(c for c in range(128) if bytes([c]) not in (b"\n",) and c not in _LETTER + _DIGIT + _SPACE + _USUAL)
#: Borders of the bins of every measure of a line.
_SHARES = [0.01, 0.05, 0.12, 0.25, 0.5, 0.8]
_BINS = {
    "upper": _SHARES, "digit": _SHARES, "usual": _SHARES, "odd": _SHARES, "odd_per_word": _SHARES,
    "repeated": _SHARES, "followed_by_itself": _SHARES, "word_length": [2, 4, 6, 9, 14, 30],
    "words": [2, 4, 8, 16, 64, 512], "closed": [0.5],
}
WIDTH = sum(len(b) + 1 for b in _BINS.values())


def _measures(line: str) -> tuple:
    data, words = line.encode("utf-8", "surrogatepass"), line.split()
    size, n = len(data), max(1, len(words))
    count = lambda chars: size - len(data.translate(None, chars))
    letters, odd = max(1, count(_LETTER)), count(_ODD)
    return (
        count(_UPPER) / letters, count(_DIGIT) / size, count(_USUAL) / size, odd / size, odd / n,
        1 - len(set(words)) / n, sum(map(eq, words, words[1:])) / n, size / n, n, line[-1] in ".?:",
    )


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bin numbers of each line that is not blank, byte lengths). A text without any is one line of length 1."""
    lines = [s for line in (text or "").split("\n") if (s := line.strip())] or ["?"]
    values = np.array([_measures(line) for line in lines], dtype=np.float64)
    columns, base = [], 0
    for j, borders in enumerate(_BINS.values()):
        columns.append(base + np.searchsorted(borders, values[:, j], side="right"))
        base += len(borders) + 1
    return np.stack(columns, axis=1).astype(np.int16), np.array([len(line) for line in lines], dtype=np.float64)


class Chains:
    """Lines of many documents one after another, longest document first, to step through all at once."""

    def __init__(self, features: list[np.ndarray]):
        sizes = np.array([len(f) for f in features])
        self.by_length = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.by_length]
        self.bins = np.concatenate([features[i] for i in self.by_length]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.document = np.repeat(np.arange(len(sizes)), self.sizes)
        place = np.arange(len(self.bins)) - self.starts[self.document]
        self.first, self.last = place == 0, place == self.sizes[self.document] - 1
        self.active = [int(np.searchsorted(-self.sizes, -t, side="left")) for t in range(int(self.sizes.max()))]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Good minus bad for each line; ``weights`` has rows for the line, the one before, the one after, and the bias."""
        own, before, after = (weights[k][self.bins].sum(axis=1) for k in range(3))
        total = own + weights[3][0]
        total[~self.first] += before[np.flatnonzero(~self.first) - 1]
        total[~self.last] += after[np.flatnonzero(~self.last) + 1]
        return total

    def marginals(self, scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, pair probabilities (line to next: 2 x 2), log Z of each document."""
        node = np.stack([np.zeros_like(scores), scores], axis=1)
        alpha, beta = node.copy(), np.zeros_like(node)
        for t in range(1, len(self.active)):
            at = self.starts[: self.active[t]] + t
            alpha[at] += np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1])
        for t in range(len(self.active) - 1, 0, -1):
            at = self.starts[: self.active[t]] + t
            ahead = node[at] + beta[at]
            beta[at - 1] = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
        log_z = np.logaddexp(*alpha[self.starts + self.sizes - 1].T)
        good = np.exp(alpha[:, 1] + beta[:, 1] - log_z[self.document])
        i = np.flatnonzero(~self.last)
        pair = alpha[i, :, None] + trans + (node[i + 1] + beta[i + 1])[:, None, :] - log_z[self.document[i], None, None]
        return good, np.exp(pair), log_z

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        """Of the weights, for a residual of each line."""
        out = np.zeros((4, WIDTH))
        width = self.bins.shape[1]
        for k, (mine, other) in enumerate(((np.arange(len(residual)),) * 2, (f := np.flatnonzero(~self.first), f - 1), (g := np.flatnonzero(~self.last), g + 1))):
            out[k] = np.bincount(self.bins[other].ravel(), np.repeat(residual[mine], width), WIDTH)
        out[3][0] = residual.sum()
        return out


@dataclass(frozen=True)
class CrfModel:
    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    intercept: float

    def good_shares(self, texts) -> np.ndarray:
        """Length-weighted share of good lines of each text."""
        parts = [line_features(t) for t in texts]
        if not parts:
            return np.zeros(0)
        chains = Chains([f for f, _ in parts])
        good, _, _ = chains.marginals(chains.scores(self.weights), self.transitions)
        weight = np.concatenate([parts[i][1] for i in chains.by_length])
        share = np.empty(len(parts))
        share[chains.by_length] = np.add.reduceat(good * weight, chains.starts) / np.add.reduceat(weight, chains.starts)
        return share

    def score(self, text: str | Column) -> Column:
        """Probability that a text is of good quality, 0 to 1; null and empty texts have one too."""

        @F.pandas_udf("double")
        def of(batch: pd.Series) -> pd.Series:
            parts = [self.good_shares(batch.iloc[i : i + 2000]) for i in range(0, len(batch), 2000)]
            share = np.concatenate(parts) if parts else np.zeros(0)
            return pd.Series(1 / (1 + np.exp(-(self.slope * share + self.intercept))))

        return of(text)


def _calibrate(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the share, with a small ridge; constant for one class only."""
    rate = (label.sum() + 1) / (len(label) + 2)
    if len(set(label.tolist())) < 2:
        return 0.0, float(np.log(rate / (1 - rate)))
    x, w = np.stack([share, np.ones_like(share)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - label) + 0.05 * w), -2, 2)
    return float(w[0]), float(w[1])


def fit_lines(features: list[np.ndarray], lengths: list[np.ndarray], label: np.ndarray, steps: int = 150, ridge: float = 2e-4) -> CrfModel:
    """Maximum conditional likelihood by Adam; each document and each class counts alike."""
    weights, trans = np.zeros((4, WIDTH)), np.zeros((2, 2))
    if len(set(label.tolist())) < 2:
        return CrfModel(weights, trans, *_calibrate(np.zeros(len(label)), label))
    chains = Chains(features)
    y = label[chains.by_length].astype(np.float64)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / (len(y) * chains.sizes)
    line_y, line_w = y[chains.document], balance[chains.document]
    pair_doc = chains.document[~chains.last]
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        good, pair, _ = chains.marginals(chains.scores(weights), trans)
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = balance[pair_doc][y[pair_doc] == k].sum()
        slope_w = chains.gradient((good - line_y) * line_w) + ridge * weights
        slope_t = (pair * balance[pair_doc][:, None, None]).sum(axis=0) - seen + 0.01 * trans
        for j, (value, slope) in enumerate(((weights, slope_w), (trans, slope_t))):
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    good, _, _ = chains.marginals(chains.scores(weights), trans)
    length = np.concatenate([lengths[i] for i in chains.by_length])
    share = np.add.reduceat(good * length, chains.starts) / np.add.reduceat(length, chains.starts)
    return CrfModel(weights, trans, *_calibrate(share, y))


def fit(documents: DataFrame, labels: DataFrame, bound: int = FIT_DOCUMENTS) -> CrfModel:
    """A model from about ``bound`` labelled documents at most; the held-out fold is never used.

    Executors turn the sampled texts into line features; the driver gets those and no text. Without labelled
    documents, or with one label only, the score is one constant.
    """

    @F.pandas_udf("bins binary, lengths binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        parts = [line_features(t) for t in texts]
        return pd.DataFrame({"bins": [f.tobytes() for f, _ in parts], "lengths": [n.tobytes() for _, n in parts]})

    rows = (
        labelled_sample(documents, labels, "quality", HELD_OUT_FOLD, bound)
        .select(features("text").alias("f"), F.when(F.col("label") >= 1, 1).otherwise(0).alias("label")).select("f.*", "label")
        .collect()
    )
    rows.sort(key=lambda r: (r.label, bytes(r.bins)))  # bounded; a sort by range would put most of them into one task
    bins = [np.frombuffer(r.bins, dtype=np.int16).reshape(-1, len(_BINS)) for r in rows]
    return fit_lines(bins, [np.frombuffer(r.lengths) for r in rows], np.array([r.label for r in rows], dtype=np.float64))
