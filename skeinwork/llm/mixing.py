"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their sums over each dimension meet its targets.
A document's weight is that of its cell; its probability is the weight times a constant, at most one, so that the
expected tokens are the wanted share of all; a hash of its id decides. Probabilities that reach one hold their cells, and the
other cells are raked again to what is left, until no more do.

Only sums per cell leave the aggregation: cells are sources x languages x topics, not documents. They are raked in one way: sums over
Arrow batches of cells, one row for each source. Up to MOST_CELLS cells the batches are held by the driver and joined by a broadcast; more
are in the shared folder, where such a sum is a Spark job, and the join deals rows of hot cells over tasks.

Targets that can't be met together are raked until a round changes nothing (STILL), ROUNDS times at most; a warning tells by how much they are missed, and the last weights count.

Defined cases: a null source, language or topic is a category of its own; targets for categories without tokens are
shared out among the others; documents without tokens have their cell's probability; null ids are decided as one id, and so are repeated
ids; equal cells have equal factors, whatever the order of rows; an empty table gives no rows; texts of any length are counted whole; columns that
aren't read, whatever their names, are kept by sampled().
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import Work, drop_at_exit, drop_path, read_table, spread_join, work_path, written

DIMENSIONS = ("source", "lang", "topic")
MOST_CELLS = 50_000
ROUNDS, TOLERANCE, STILL = 200, 1e-9, 1e-13

#: The first condition that holds names a text's topic; {t} stands for the text.
TOPICS = (
    ("contact", "contains({t}, '@')"),
    ("license", "contains({t}, 'icense')"),
    ("tabular", "contains({t}, ' | ')"),
    ("marked", "contains({t}, '###') OR contains({t}, '$$$') OR contains({t}, '!!')"),
    ("long", "length({t}) > 4000"),
    ("short", "length({t}) < 400"),
)


@dataclass(frozen=True)
class Targets:
    """share: expected tokens that stay, as a share of all. Each dimension's targets are its token shares to a power (1: as they are,
    0: equal), unless `fixed` names them; what fixed shares leave is shared out by that power."""

    share: float = 0.5
    powers: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 1.0, "topic": 0.7})
    fixed: dict[str, dict[str, float]] = field(default_factory=lambda: {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}})
    seed: int = 17


TEXT = "coalesce(CAST(text AS STRING), '')"


def topic(topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    """The topic of a row's text."""
    return F.expr("CASE " + " ".join(f"WHEN {condition.format(t=TEXT)} THEN '{name}'" for name, condition in topics) + " ELSE 'prose' END")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the dimensions and tokens (white-space words) of every row."""
    tokens = F.regexp_count(F.expr(TEXT), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic().alias("topic"), tokens.alias("tokens"))


def marginal(names: list, tokens: np.ndarray, power: float, fixed: dict[str, float]) -> np.ndarray:
    """Target shares of a dimension's categories."""
    there = tokens > 0
    out = np.zeros(len(names))
    for i, n in enumerate(names):
        if there[i] and n in fixed:
            out[i] = fixed[n]
    rest = np.array([there[i] and n not in fixed for i, n in enumerate(names)])
    total = tokens.sum()
    if rest.any():
        left = max(0.0, 1 - sum(fixed.values())) if fixed else 1.0
        own = (tokens[rest] / total) ** power
        # a category that no target names keeps its share at least of what is left
        out[rest] = max(left, tokens[rest].sum() / total if fixed else 0.0) * own / own.sum()
    return out / out.sum() if out.sum() else out


def missed(worst: float, total: float) -> None:
    if worst > 1e-6 * total:
        warnings.warn(f"targets can't all be met: the worst is off by {worst / total:.2%} of the tokens", stacklevel=3)


Batches = Iterator[pa.RecordBatch]


class Cells:
    """The cells as one row for each source, with arrays over its languages and topics: tokens t, first factor f, probability p, held h.

    A round of raking is one pass: a source's factor follows from those of languages and topics, and the passes give
    the sums over sources that the other two dimensions need. Languages and topics are on the driver; sources are there if `few`, else in the shared folder.
    """

    SCHEMA = "source string, g double, l array<int>, k array<int>, t array<double>, f array<double>, p array<double>, h array<boolean>"

    def __init__(self, cells: DataFrame, langs: list, topics: list, goal, few: bool):
        self.spark, self.shape, self.path, self.few = cells.sparkSession, (len(langs), len(topics)), None, few
        at, of = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(topics)}

        def run(batches: Batches) -> Batches:
            for batch in batches:
                for r in batch.to_pylist():
                    t, n = [float(c["tokens"]) for c in r["cells"]], len(r["cells"])
                    row = {"source": r["source"], "g": goal(r["source"], sum(t)), "l": [at[c["lang"]] for c in r["cells"]], "k": [of[c["topic"]] for c in r["cells"]]}
                    yield pa.RecordBatch.from_pylist([row | {"t": t, "f": [1.0] * n, "p": [1.0] * n, "h": [False] * n}], schema=ROWS)

        grouped = cells.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("lang", "topic", "tokens"))).alias("cells"))
        if few:
            made = pa.Table.from_batches(run(grouped.orderBy("source").toArrow().to_batches()), schema=ROWS)
            self.batches = made.combine_chunks().to_batches()
        else:
            self._write(grouped.mapInArrow(run, self.SCHEMA))

    def _write(self, rows: DataFrame) -> None:
        new = work_path(self.spark, "mixing-cells")
        rows.write.parquet(new)
        drop_at_exit(self.spark, new)
        if self.path:
            drop_path(self.spark, self.path)
        self.rows, self.path = self.spark.read.schema(self.SCHEMA).parquet(new), new

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(pa.Table.from_batches(self.batches, schema=ROWS), self.SCHEMA) if self.few else self.rows

    @staticmethod
    def flat(batch: pa.RecordBatch) -> tuple:
        """Each cell's row, and goals, l, k, t, f, p, h as arrays."""
        lists = [batch.column(i) for i in range(2, 8)]
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
        return row, batch.column(1).to_numpy(), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)

    def sums(self, of, n: int) -> np.ndarray:
        """The sum over batches of of(*flat(batch)), n numbers."""

        def run(batches: Batches) -> Batches:
            total = np.zeros(n)
            for batch in batches:
                if batch.num_rows:
                    total += of(*Cells.flat(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["i", "x"])

        if self.few:
            return next(run(iter(self.batches))).column(1).to_numpy()
        out = np.zeros(n)
        for i, x in self.rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect():
            out[i] = x
        return out

    def change(self, to) -> None:
        """Put the (f, p, h) that to(*flat(batch)) gives."""

        def run(batches: Batches) -> Batches:
            for batch in batches:
                if batch.num_rows:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(Cells.flat(batch)[0], minlength=batch.num_rows))]).astype(np.int32))
                    made = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in to(*Cells.flat(batch))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *made], schema=ROWS)

        if self.few:
            self.batches = list(run(iter(self.batches)))
        else:
            self._write(self.rows.mapInArrow(run, self.SCHEMA))

    def left(self) -> tuple[float, float, float]:
        """What held cells leave of the sources' goals; tokens and number of the cells that aren't held."""
        return tuple(self.sums(lambda row, g, l, k, t, f, p, h: np.array([np.maximum(g - np.bincount(row, t * h, len(g)), 0).sum(), t[~h].sum(), (~h).sum()]), 3))

    def rake(self, scale: float, langs: np.ndarray, topics: np.ndarray, tokens: float, rounds: int = ROUNDS):
        """Factors of the cells that aren't held, such that factors * tokens has langs, topics and `scale` times what is left of the sources' goals as its sums:
        a function of flat() that returns them."""
        (nl, nk), b, c = self.shape, np.ones(len(langs)), np.ones(len(topics))
        before, now, gap = None, np.full((nl, nk), np.inf), np.inf

        def source(row, g, t, l, k, h, b, c):
            have = np.bincount(row, t * ~h * b[l] * c[k], len(g))
            goal = np.maximum(g - np.bincount(row, t * h, len(g)), 0) * scale
            return np.divide(goal, have, out=np.ones(len(g)), where=have > 0), goal, have

        for _ in range(rounds):
            size, b, c = b.max() * c.max(), b / b.max(), c / c.max()  # sources take over what they have in common

            def step(row, g, l, k, t, f, p, h, b=b, c=c, before=before, size=size):
                a, goal, have = source(row, g, t, l, k, h, b, c)
                was = np.ones(len(g)) if before is None else source(row, g, t, l, k, h, *before)[0]
                # a sum over batches: whether any source is off is what counts
                gaps = np.abs(was * have * size - goal)
                return np.concatenate([[(gaps >= TOLERANCE * max(1.0, tokens)).sum(), gaps.sum()], np.bincount(l * nk + k, t * ~h * a[row], nl * nk)])

            last, wide = now, gap
            off, gap, *m = self.sums(step, 2 + nl * nk)
            m, gap, before = np.array(m).reshape(nl, nk), gap if before else np.inf, (b, c)
            have = b * (m @ c)
            worst = np.abs(have - langs).max()
            b = b * np.divide(langs, have, out=np.ones(nl), where=have > 0)
            have = c * (b @ m)
            worst = max(worst, np.abs(have - topics).max())
            c = c * np.divide(topics, have, out=np.ones(nk), where=have > 0)
            now = b[:, None] * m * c  # tokens of each language and topic
            if (not off and worst < TOLERANCE * max(1.0, tokens)) or max(np.abs(now - last).max(), abs(gap - wide)) <= STILL * tokens:
                break
        missed(worst, tokens)

        def factors(row, g, l, k, t, f, p, h):
            a = source(row, g, t, l, k, h, *before)[0]
            return np.where((t > 0) & ~h, a[row] * b[l] * c[k], 1.0)

        return factors


ROWS = pa.schema([("source", pa.string()), ("g", pa.float64()), *((x, pa.list_(pa.int32())) for x in "lk"), *((x, pa.list_(pa.float64())) for x in "tfp"), ("h", pa.list_(pa.bool_()))])


def fitted(cells: DataFrame, targets: Targets, few: bool) -> DataFrame:
    """source, lang, topic, tokens, factor, probability of the cells, which are on disk; few: whether the driver may hold them.

    Cells whose probability would pass one hold it; the rest is raked to what they leave of the targets.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return written(cells.select(*DIMENSIONS, "tokens", F.lit(1.0).alias("factor"), F.lit(1.0).alias("probability")), "mixing-cells")
    names, wanted = [], []
    for name in DIMENSIONS[1:]:
        rows = sorted(map(tuple, cells.groupBy(name).agg(F.sum("tokens")).collect()), key=lambda r: (r[0] is not None, r[0] or ""))
        names.append([r[0] for r in rows])
        wanted.append(marginal(names[-1], np.array([r[1] for r in rows], dtype=float), targets.powers[name], targets.fixed.get(name, {})) * targets.share * total)
    # as marginal(), of the sources, of which the driver has none
    fixed, power = targets.fixed.get("source", {}), targets.powers["source"]
    sums = cells.groupBy("source").agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    free = sums.where(~F.coalesce(F.col("source").isin(*fixed), F.lit(False))) if fixed else sums
    own, rest = free.agg(F.coalesce(F.sum(F.pow(F.col("t") / total, F.lit(power))), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    there = [r[0] for r in sums.where(F.col("source").isin(*fixed)).select("source").collect()] if fixed else []
    share = max(max(0.0, 1 - sum(fixed.values())), rest / total) if fixed else 1.0
    norm = sum(fixed[n] for n in there) + (share if own else 0.0)

    def goal(name, t: float) -> float:
        part = 0.0 if not t else fixed[name] if name in fixed else share * (t / total) ** power / own
        return part / (norm or 1.0) * targets.share * total

    table = Cells(cells, *names, goal, few)
    factors = table.rake(1.0, *wanted, total)
    table.change(lambda *x: ((y := factors(*x)), y, x[-1]))
    while True:  # each time at least one more cell is held
        over = lambda p, h: ~h & (p > 1 + 1e-9)
        if not table.sums(lambda row, g, l, k, t, f, p, h: np.array([over(p, h).sum()]), 1)[0]:
            break
        table.change(lambda row, g, l, k, t, f, p, h: (f, p, h | over(p, h)))
        nl, nk = table.shape
        held = table.sums(lambda row, g, l, k, t, f, p, h: np.bincount(l * nk + k, t * h, nl * nk), nl * nk).reshape(nl, nk)
        others = [np.maximum(w - held.sum(axis=1 - d), 0) for d, w in enumerate(wanted)]
        sources, tokens, cells_left = table.left()
        least = min(sources, *(x.sum() for x in others))
        if not cells_left or least <= 0:
            break
        again = table.rake(least / sources, *(x * least / x.sum() for x in others), tokens)
        table.change(lambda *x: (x[5], again(*x), x[-1]))
    # the constant: cells that it brings to one are held, and it is worked out again, until no more are
    weight = lambda p: np.minimum(p, 1.0) + 1e-12
    high, need = 0.0, targets.share * total
    while True:
        done, left = table.sums(lambda row, g, l, k, t, f, p, h, c=high: np.array([t[c * weight(p) > 1].sum(), (t * weight(p))[c * weight(p) <= 1].sum()]), 2)
        before, high = high, (need - done) / left if left > 0 else np.inf
        if high <= before * (1 + 1e-12) or not np.isfinite(high):
            break
    table.change(lambda row, g, l, k, t, f, p, h: (f, np.minimum(1.0, high * weight(p)) if np.isfinite(high) else np.ones(len(p)), h))
    langs, topics = (F.array(*(F.lit(x).cast("string") for x in y)) for y in names)
    each = table.table().select("source", F.explode(F.arrays_zip("l", "k", "t", "f", "p")).alias("x"))
    return each.select("source", F.get(langs, F.col("x.l")).alias("lang"), F.get(topics, F.col("x.k")).alias("topic"), F.col("x.t").cast("long").alias("tokens"), F.col("x.f").alias("factor"), F.col("x.p").alias("probability"))


def cell_table(keys: DataFrame, targets: Targets, most_cells: int = MOST_CELLS) -> tuple[DataFrame, bool]:
    """Factor and probability of every cell, and whether these are most_cells at most. keys: as from keyed()."""
    with Work(keys.sparkSession) as work:
        cells = work.put(keys.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mixing-cells")
        few = cells.count() <= most_cells
        return fitted(cells, targets, few).toDF("__source", "__lang", "__topic", "__tokens", "factor", "probability"), few


def _drawn(targets: Targets) -> Column:
    draw = F.pmod(F.xxhash64(F.lit(targets.seed), F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << 40)) / float(1 << 40)
    return draw < F.col("probability")


def _with_cells(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    """rows and their cell's columns. Few cells are broadcast; else rows of hot cells are dealt over tasks by their ids."""
    if few:
        c = F.broadcast(cells)
        return rows.join(c, rows["source"].eqNullSafe(c["__source"]) & rows["lang"].eqNullSafe(c["__lang"]) & rows["topic"].eqNullSafe(c["__topic"]))
    cell = lambda *names: F.to_json(F.struct(*(F.col(n).alias(d) for n, d in zip(names, DIMENSIONS))))  # noqa: E731  (a null is left out, so no text is equal to it)
    keyed_cells = cells.withColumn("__cell", cell("__source", "__lang", "__topic"))
    return spread_join(rows.withColumn("__cell", cell(*DIMENSIONS)), keyed_cells, "__cell", "doc_id")


def weighted(docs: DataFrame, targets: Targets = Targets(), most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, tokens, factor, probability and kept of every row. Texts are read once."""
    k = written(keyed(docs), "mixing-keys")
    joined = _with_cells(k, *cell_table(k, targets, most_cells))
    return joined.select("doc_id", "source", "lang", "topic", "tokens", "factor", "probability", _drawn(targets).alias("kept"))


def sampled(docs: DataFrame, targets: Targets = Targets(), most_cells: int = MOST_CELLS) -> DataFrame:
    """The rows, with all columns, that the draw keeps."""
    cells = cell_table(keyed(docs), targets, most_cells)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic().alias("topic"))
    return _with_cells(rows, *cells).where(_drawn(targets)).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and decision of every document."""
    return weighted(read_table(spark, sf_dir, "documents"))
