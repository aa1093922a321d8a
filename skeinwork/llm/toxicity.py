"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

One lexicon, of plain English insults and of words and word beginnings learned from labelled texts of any language, serves all features:
densities of its words, how near they stand to words of the second person, capitals, punctuation, symbols, and rates of
obfuscation (digits and signs inside words, stretched and spaced letters, words that are in the lexicon only after these are undone).

Labelled rows outside the held-out fold are dealt to the other folds, and nothing is judged by what has seen it: a row's features use the
lexicon learned without its fold, and the calibration is fitted on margins of trees grown without the row's fold. The final
lexicon and trees are those of all folds. It is so at every number of rows.
All fitting is on SAMPLE_ROWS labelled rows at most; every row is scored.

Defined cases: null and empty texts have the score of a text without words; without labels of both kinds every score is
the share of toxic labels (0 without any); repeated rows have equal scores; of repeated labels of an id the largest counts, of repeated
labelled rows one; an empty table gives no rows; texts of any length are read whole; columns other than doc_id and text,
whatever their names, are ignored by the scores and kept by without_toxic().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import Work, read_table, text_slices
from skeinwork.llm.learn import fold, labelled, matrix, score_column, scored

FOLDS, HELD_OUT = 5, 0
#: Insults in plain English.
LEXICON = frozenset(
    "arse arsehole ass asshole bastard bitch bollocks bullshit clown coward cretin crap cunt damn dickhead disgusting dumb dumbass dunce fag filth filthy fool fraud freak fuck fucking garbage goon halfwit hate"
    " idiot idiotic idiots imbecile jackass jerk lame liar loser losers lunatic maggot moron moronic morons nazi nitwit parasite pathetic pig prick psycho pussy rat retard retarded rubbish scum scumbag shit shitty"
    " shut slut stupid sucker suck sucks trash trashy twat twit ugly useless vermin vile whore wimp worm worthless".split()
)
YOU = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros".split())
NEAR = 5
LETTERS = re.compile(r"[^\W\d_]+")
#: Words with digits or signs inside. A run is tried at its beginning alone and never given back, so that long runs cost their length.
SIGNED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*+][\w@$!*+]*+|(?<![0-9@$!])[0-9@$!]++[^\W\d_][\w@$!*+]*+")
LEET = str.maketrans("01345@$!+7", "oieasasitt")
STRETCHED = re.compile(r"([^\W\d_])\1\1+")
SPACED = re.compile(r"(?:\b[^\W\d_][ .\-*]){3,}[^\W\d_]\b")
PUNCTUATION = re.compile(r"[!?.,;:]")
SYMBOLS = re.compile(r"[#*$%&|<>@^~]")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
#: Learned grams: whole words ("word$") and beginnings of longer ones ("begin*"). The LEARNED_GRAMS most telling ones are kept.
LEARNED_GRAMS = 400
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Weight of the fixed lexicon's words, and the least weight of a word that counts as a hit.
FIXED_WEIGHT, HIT = 4.0, 2.5


def grams(word: str) -> list[str]:
    """The word as a whole, and its beginnings."""
    return [word + "$", *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


NAMES = (
    "hits", "hit density", "different hits", "weight density", "largest weight", "hits near you", "nearness", "you density",
    "capitals", "exclamations", "punctuation", "symbols", "undone density", "signed words", "stretched words", "different words", "words",
)
WIDTH = len(NAMES)


class Features:
    """The features of a text, with the weights of learned grams."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.begins = frozenset(g[:3] for g in learned) | {w[:3] for w in LEXICON}

    def weight(self, word: str) -> float:
        """The largest weight of a word's grams, 0 without any."""
        if word[:3] not in self.begins:
            return 0.0
        return max((self.learned.get(g, 0.0) for g in grams(word)), default=0.0) if word not in LEXICON else FIXED_WEIGHT

    def undone(self, low: str, counts: Counter) -> tuple[int, int, int]:
        """Words that are hits only after signs, stretched letters and spaces between letters are undone; words with signs; stretched ones."""
        signed, stretched = SIGNED.findall(low), STRETCHED.findall(low)
        undone = sum(any(not c.isalpha() for c in w) and self.weight("".join(LETTERS.findall(w.translate(LEET)))) >= HIT for w in signed)
        if stretched:
            undone += sum(w not in counts and self.weight(w) >= HIT for w in LETTERS.findall(STRETCHED.sub(r"\1", low)))
        undone += sum(self.weight("".join(LETTERS.findall(w))) >= HIT for w in SPACED.findall(low))
        return undone, len(signed), len(stretched)

    def __call__(self, text: str, _: int = 0) -> list[float]:
        low = text.lower()
        words = LETTERS.findall(low)
        n = len(words) or 1
        chars = len(text) or 1
        counts = Counter(words)
        begins = self.begins
        weights = {w: x for w in counts if w[:3] in begins and (x := self.weight(w))}
        hit = {w for w, x in weights.items() if x >= HIT}
        hits = sum(counts[w] for w in hit)
        you = sum(counts[w] for w in counts.keys() & YOU)
        near, nearness = 0, 0.0
        if hits and you:
            at = np.array([i for i, w in enumerate(words) if w in YOU])
            spots = np.array([i for i, w in enumerate(words) if w in hit])
            k = np.searchsorted(at, spots)
            gap = np.minimum(np.abs(at[np.maximum(k - 1, 0)] - spots), np.abs(at[np.minimum(k, len(at) - 1)] - spots))
            near, nearness = int((gap <= NEAR).sum()), float((1 / (1 + gap)).max())
        undone, signed, stretched = self.undone(low, counts)
        return [
            float(hits), 100 * hits / n, float(len(hit)), 100 * sum(x * counts[w] for w, x in weights.items()) / n, max(weights.values(), default=0.0),
            100 * near / n, nearness, 100 * you / n, len(CAPITALS.findall(text)) / chars, text.count("!") / chars, len(PUNCTUATION.findall(text)) / chars, len(SYMBOLS.findall(text)) / chars,
            100 * undone / n, 100 * signed / n, 100 * stretched / n, len(counts) / n, float(np.log1p(len(words))),
        ]


# -- trees


@dataclass
class Boosted:
    """Boosted trees of fixed depth over binned features. Tree t: split feature and bin of each inner node, value of each leaf."""

    edges: list[np.ndarray]
    features: np.ndarray
    bins: np.ndarray
    leaves: np.ndarray
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for f, t, leaf in zip(self.features, self.bins, self.leaves):
            node = np.zeros(len(x), dtype=int)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, least: float = 4.0) -> Boosted:
    """Newton boosting of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(edges, np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth)), float(np.log(p0 / (1 - p0))))
    b, margin, n_bins, rows = model.binned(x), np.full(len(x), model.start), bins + 1, np.arange(len(x))
    splits, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), dtype=int)
        feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, n_bins)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain_of = np.full((width, x.shape[1], n_bins), -np.inf)
            for k in range(x.shape[1]):
                key = local * n_bins + b[:, k]
                gs = np.bincount(key, g, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = -np.inf
                gain_of[:, k] = gain
            best = gain_of.reshape(width, -1).argmax(axis=1)
            for w in range(width):
                k, t = divmod(int(best[w]), n_bins)
                if gain_of[w, k, t] > 1e-9:
                    feature[first + w], cut[first + w] = k, t
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        splits.append(feature), cuts.append(cut), values.append(value)
    model.features, model.bins, model.leaves = np.array(splits), np.array(cuts), np.array(values)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    """Calibrated scores."""

    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.trees is None else np.interp(self.trees.raw(x), *self.knots)


# -- fitting


def gram_counts(rows: DataFrame) -> tuple[dict[str, list[int]], list[int]]:
    """Documents with each gram, and all documents, as 2 * fold + label counts. Grams of less than a fiftieth of the toxic documents, or of less than three, stay out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in text_slices(batch):
                seen: dict[str, list[int]] = {}
                for label, k, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), raw):
                    words = set(LETTERS.findall(t.decode("utf-8", "replace").lower()))
                    for g in {g for w in words for g in grams(w)}:
                        seen.setdefault(g, [0] * (2 * FOLDS))[2 * k + label] += 1
                columns = [pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(2 * FOLDS)]
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *columns], names=["gram", *(f"n{i}" for i in range(2 * FOLDS))])

    kind = ", ".join(f"n{i} long" for i in range(2 * FOLDS))
    totals = [0] * (2 * FOLDS)
    for k, label, n in rows.groupBy("fold", "label").count().collect():
        totals[2 * k + label] = n
    sums = rows.mapInArrow(counted, f"gram string, {kind}").groupBy("gram").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(2 * FOLDS)))
    toxic = sum((F.col(f"n{2 * k + 1}") for k in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"n{2 * k}") for k in range(FOLDS)), F.lit(0))
    # at most fifty times a text's grams: what a fiftieth of the toxic texts have, and clean ones have less often
    kept = sums.where((toxic >= max(3, round(0.02 * sum(totals[1::2])))) & (toxic * sum(totals[::2]) > 2 * clean * sum(totals[1::2])))
    return {r[0]: list(r[1:]) for r in kept.collect()}, totals


def lexicon(counts: dict[str, list[int]], totals: list[int], without: int | None = None, most: int = LEARNED_GRAMS) -> dict[str, float]:
    """The most telling grams of all folds but `without`, with the logarithm of the ratio of their shares of toxic and of other documents."""
    folds = [k for k in range(FOLDS) if k != without]
    pick = lambda v, label: sum(v[2 * k + label] for k in folds)
    toxic, clean = pick(totals, 1), pick(totals, 0)
    found = []
    for g, v in counts.items():
        t, c = pick(v, 1), pick(v, 0)
        if t >= 3 and (w := float(np.log((t / toxic) / ((c + 1) / (clean + 1))))) > 1.4:
            found.append((-w * np.log1p(t), g, w))
    return {g: w for _, g, w in sorted(found)[:most]}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> tuple[Features, Model]:
    """Features and model from labelled rows outside the held-out fold."""
    with Work(docs.sparkSession) as work:
        rows = work.put(labelled(docs, labels, "toxic", FOLDS, HELD_OUT, *([sample_rows] if sample_rows else [])), "toxicity-sample")
        counts, totals = gram_counts(rows)
        apart = {k: Features(lexicon(counts, totals, k)) for k in range(FOLDS) if k != HELD_OUT}
        x, y, folds = matrix(rows, lambda text, k: apart[k](text), WIDTH)
    features = Features(lexicon(counts, totals))
    if not 0 < y.sum() < len(y):
        return features, Model(None, (np.zeros(1), np.zeros(1)), float(y.mean()) if len(y) else 0.0)
    margins = np.zeros(len(y))
    for k in np.unique(folds):
        margins[folds == k] = boost(x[folds != k], y[folds != k]).raw(x[folds == k]) if (folds != k).any() else 0.0
    return features, Model(boost(x, y), isotonic(margins, y), float(y.mean()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    features, model = fit(docs, labels)
    found = scored(docs, features, model)
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose score is below the threshold."""
    features, model = fit(docs, labels)
    return docs.where(score_column(features, model)(F.col("text")) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
