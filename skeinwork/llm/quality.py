"""Quality by pairwise ranking: Bradley-Terry scores from preferences, a threshold from score quantiles.

A document's score is a weighted sum of its features, and one document is preferred to another with the logistic
probability of their scores' difference. Weights are learned from pairs of a better and a worse labelled document by
that loss on feature differences, with an L2 penalty, by Newton steps. Each feature enters as it is and as hinges at its
quantiles, so that weights can express thresholds. The threshold is the quantile of the labelled scores that
leaves the share of worse documents below it, and the score from 0 to 1 is the logistic function that
takes the value CUT there.

All fitting is on SAMPLE_ROWS labelled rows at most, outside the held-out fold; every row is scored.

Defined cases: null and empty texts have the score of a text without words; without labels of both kinds every score is
CUT if there are only better documents or none, and 0 if there are only worse ones; repeated rows have equal scores; of repeated
labels of an id the largest counts, of repeated labelled rows one; an empty table gives no rows; texts of any length are read whole; columns other
than doc_id and text, whatever their names, are ignored; documents with the threshold's score count as better.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import read_table
from skeinwork.llm.learn import fold, labelled, matrix, scored

FOLDS, HELD_OUT = 4, 2
CUT = 0.7
#: Pairs for each worse document.
PAIRS = 8
#: Pairs that are worked on at a time.
BLOCK = 16_384
SYMBOLS = re.compile(r"[#*$%&|<>]")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"[0-9]")
STOPS = frozenset("the of and to in a is that it on for as with was der die das und in zu den von mit ist ein le la les de et en un une que du el los las y por con una del".split())


def features(text: str) -> list[float]:
    words = text.lower().split()
    n, chars = len(words) or 1, len(text) or 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = sum(map(str.__eq__, words, words[1:]))
    triples = len(words) - 2
    return [
        float(np.log1p(len(words))),
        chars / n,
        len(SYMBOLS.findall(text)) / n,
        text.count("!") / n,
        len(CAPITALS.findall(text)) / chars,
        len(DIGITS.findall(text)) / chars,
        text.count("|") / n,
        pairs / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,
        len(counts) / n,
        counts.most_common(1)[0][1] / n if words else 0.0,
        sum(counts[w] for w in counts.keys() & STOPS) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines) if lines else 0.0,
        len(re.findall(r"[.,;:]", text)) / n,
    ]


@dataclass
class Ranking:
    """Scores of documents, on the scale on which preferences are logistic, and the threshold among them."""

    knots: list[np.ndarray]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0
    constant: float | None = None

    def basis(self, x: np.ndarray) -> np.ndarray:
        parts = [x] + [np.maximum(x[:, k : k + 1] - t[None, :], 0) for k, t in enumerate(self.knots) if len(t)]
        return (np.concatenate(parts, axis=1) - self.center) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.basis(x), -8, 8) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def bradley_terry(differences: np.ndarray, penalty: float = 20.0, steps: int = 25) -> np.ndarray:
    """Weights w that minimise the sum of log(1 + exp(-difference . w)) + penalty |w|^2 / 2."""
    w = np.zeros(differences.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -60, 60)))  # of the less likely order
        grad = differences.T @ p - penalty * w
        hess = penalty * np.eye(len(w))
        for i in range(0, len(p), BLOCK):
            x, q = differences[i : i + BLOCK], p[i : i + BLOCK]
            hess += (x * (q * (1 - q))[:, None]).T @ x
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def rank(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranking:
    """A ranking from features and labels (1: better)."""
    if not 0 < y.sum() < len(y):
        return Ranking([], np.zeros(1), np.ones(1), np.zeros(1), constant=CUT if not len(y) or y[0] else 0.0)
    knots = [np.unique(np.quantile(x[:, k], (0.05, 0.2, 0.5, 0.8, 0.9, 0.95))) for k in range(x.shape[1])]
    r = Ranking(knots, np.zeros(1), np.ones(1), np.zeros(1))
    b = r.basis(x)
    r.center, r.scale = b.mean(axis=0), np.maximum(b.std(axis=0), 1e-6)
    b = np.clip((b - r.center) / r.scale, -8, 8)
    random = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    worse = random.permutation(np.repeat(bad, max(PAIRS, -(-len(good) // len(bad)))))
    better = np.resize(random.permutation(good), len(worse))
    differences = b[better]
    for i in range(0, len(worse), BLOCK):
        differences[i : i + BLOCK] -= b[worse[i : i + BLOCK]]
    r.weights = bradley_terry(differences)
    s = b @ r.weights
    ordered = np.sort(s)
    k = len(bad)
    r.threshold = float((ordered[k - 1] + ordered[min(k, len(ordered) - 1)]) / 2)
    # the likeliest slope of the logistic curve through (threshold, CUT)
    shift = np.log(CUT / (1 - CUT))
    losses = {c: np.logaddexp(0, -(2 * y - 1) * (c * (s - r.threshold) + shift)).sum() for c in np.geomspace(0.05, 20, 40)}
    r.slope = float(min(losses, key=losses.get))
    return r


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    x, y, _ = matrix(labelled(docs, labels, "quality", FOLDS, HELD_OUT), lambda text, _: features(text), len(features("")))
    found = scored(docs, features, rank(x, y))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
