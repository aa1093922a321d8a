"""Inverted lists for vector searches by cosine: a search reads the lists near its query, and in exact mode all lists that could hold a nearer vector.

Centroids are fitted on a bounded sample; every vector is stored in the list of its nearest centroid, in buckets by list. Of each list its largest angle to the centroid is
known, and angles obey the triangle inequality: what is in a list is no nearer to a query than the centroid's angle less that. So the lists that an
exact search leaves out can't change its result, whatever the sample was.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skeinwork.operators.relational import cosine
from skeinwork.sources.stored import buckets, put

#: Vectors that centroids are fitted on at most, the most lists, and vectors of a list at least, about, before there are the most lists; beyond, lists grow as the root of all vectors.
SAMPLE_ROWS, MOST_LISTS, LIST_ROWS = 100_000, 4096, 40
#: Parts into which a list's vectors are dealt when they are written.
PARTS = 8
#: Lists that an exact search looks at first. Rows that the number of lists is tuned on, and the share of their ten nearest that it should find.
FIRST, TUNE_ROWS, RECALL = 8, 200, 0.95
#: Vectors of another length than most, without a length, or null: their cosine is 0 to any query.
NONE = -1
#: What rounding of scores to five digits, and of angles, can be off by.
SLACK = 1e-4
#: Vectors of a chunk and queries of a block that meet in a task, about, and queries that it takes at a time.
CHUNK, ASKED, TILE = 8192, 16384, 512
#: Rows of the sample that one task fits centroids on, about.
FIT_ROWS = 2000


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the norm is a lambda's argument: named inside the inner lambda it would be worked out again for each number
    unit = F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))
    return F.when((norm > 0) & ~F.isnan(norm), unit)


def angles_to(query: list[float], lists: list[int], centroids: np.ndarray) -> np.ndarray:
    """The angle of each list's centroid to a query; 90 degrees for what has cosine 0."""
    q = np.asarray(query, float)
    n = np.linalg.norm(q)
    if not n > 0 or len(q) != centroids.shape[1]:
        return np.full(len(lists), math.pi / 2)
    return np.where(np.asarray(lists, int) == NONE, math.pi / 2, np.arccos(np.clip(centroids @ (q / n), -1, 1)))


@dataclass(frozen=True)
class VectorIndex:
    """vectors: all rows that were indexed, with `list`. lists: number, centroid, rows and the largest angle of each list; it is no larger than MOST_LISTS + 1 rows."""

    vectors: DataFrame
    column: str
    lists: list[int]
    centroids: np.ndarray
    angles: np.ndarray
    probes: int = FIRST

    def near(self, query: list[float]) -> np.ndarray:
        return angles_to(query, self.lists, self.centroids)

    def chosen(self, lists: list[int], condition: str) -> DataFrame:
        """Rows of some lists that meet a condition; the literals prune buckets."""
        return self.vectors.where(F.col("list").isin([int(x) for x in lists])).where(condition)

    def search(self, query: list[float], k: int = 10, condition: str = "true", probes: int | None = None, exact: bool = False, id_column: str = "vec_id") -> DataFrame:
        """The k rows nearest to a query among those that meet the condition, with score: from the `probes` nearest lists (by default as tuned), or exactly.

        An exact search looks at those lists first, which gives a score that the result has at least; then it reads what lists could have better or equal ones.
        """
        angles, probes = self.near(query), probes or (FIRST if exact else self.probes)
        order = np.argsort(angles, kind="stable")
        first = [self.lists[i] for i in order[:probes]]
        score = F.round(cosine(F.col(self.column), F.array(*(F.lit(float(x)) for x in query))), 5)

        def best(lists: list[int]) -> DataFrame:
            return self.chosen(lists, condition).withColumn("score", score).orderBy(F.desc("score"), id_column).limit(k)

        if not exact or len(first) == len(self.lists):
            return best(first)
        least = [r["score"] for r in best(first).select("score").collect()]
        floor = min(least) if len(least) == k else -2.0
        bound = np.cos(np.maximum(0, angles - self.angles))
        return best([x for x, b in zip(self.lists, bound) if x in first or b >= floor - SLACK])

    def search_all(self, queries: DataFrame, k: int = 10, probes: int | None = None, id_column: str = "vec_id", exact: bool = False) -> DataFrame:
        """query_id, id, list, score, rank: for every query (query_id, query) its k nearest rows, itself too if it is one.

        Chunks of vectors meet blocks of queries in tasks, which multiply them as matrices, leave out the lists that a query doesn't ask and keep k rows for each query. An exact search
        takes the k-th score of the `probes` nearest lists as its floor, and asks the lists that could have better ones.
        """
        probes = probes or (FIRST if exact else self.probes)
        asked = queries.select("query_id", "query").withColumn("floor", F.lit(None).cast("double"))
        first = self._best(asked, k, probes, id_column, False)
        if not exact or probes >= len(self.lists):
            return first
        floors = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        return self._best(asked.drop("floor").join(floors, "query_id", "left"), k, probes, id_column, True)

    def _best(self, asked: DataFrame, k: int, probes: int, id_column: str, exact: bool) -> DataFrame:
        """The k best of the `probes` nearest lists, or also of what lists can have the floor or better."""
        lists, centroids, reach = np.asarray(self.lists, int), self.centroids, self.angles
        chunks, blocks = max(1, -(-self.vectors.count() // CHUNK)), max(1, -(-asked.count() // ASKED))
        rows = self.vectors.select("list", F.col(id_column).alias("id"), F.col(self.column).alias("v"))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("list", F.pmod(F.xxhash64("id"), F.lit(PARTS))), F.lit(chunks)).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        some = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        ids = {c: f.dataType for c, f in (("query_id", asked.schema["query_id"]), ("id", rows.schema["id"]))}
        kind = T.StructType([T.StructField("query_id", ids["query_id"]), T.StructField("id", ids["id"]), T.StructField("list", self.vectors.schema["list"].dataType), T.StructField("score", T.DoubleType())])

        def met(q: pa.Table, v: pa.Table) -> pa.Table:
            v = v.take(pc.sort_indices(v, sort_keys=[("id", "ascending")], null_placement="at_start"))
            at = np.searchsorted(lists, v["list"].to_numpy())
            queries, floors = q["query"].to_pylist(), q["floor"].to_numpy(zero_copy_only=False).astype(float)
            stored = _Rows(v["v"])
            which, who, scores = [], [], []
            for lo in range(0, len(queries) if len(v) else 0, TILE):
                part = queries[lo : lo + TILE]
                near = np.stack([angles_to([] if x is None or None in x else x, lists, centroids) for x in part])
                wanted = np.zeros(near.shape, bool)
                np.put_along_axis(wanted, np.argsort(near, axis=1, kind="stable")[:, :probes], True, axis=1)
                if exact:
                    floor = floors[lo : lo + TILE, None]
                    wanted |= np.isnan(floor) | (np.cos(np.maximum(0, near - reach)) >= floor - SLACK)
                # NaN is above all, as in SQL; what isn't asked is below
                found = stored.scores(_Rows(pa.array(part, q["query"].type)))
                order = np.where(wanted[:, at], np.where(np.isnan(found), 3.0, found), -3.0)
                least = np.partition(order, -k, axis=1)[:, -k, None] if order.shape[1] > k else np.full((len(part), 1), -2.5)
                i, j = np.nonzero((order >= least) & (order > -2.5))
                sort = np.lexsort((j, -order[i, j], i))
                i, j = i[sort], j[sort]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[rank < k], j[rank < k]
                which.append(i + lo), who.append(j), scores.append(found[i, j])
            none = np.zeros(0, int)
            which, who = np.concatenate([none, *which]), np.concatenate([none, *who])
            return pa.table({"query_id": q["query_id"].take(which), "id": v["id"].take(who), "list": v["list"].take(who), "score": np.concatenate([np.zeros(0), *scores])})

        n = chunks * blocks
        pairs = some.repartition(n, "chunk", "block").groupBy("chunk", "block").cogroup(rows.repartition(n, "chunk", "block").groupBy("chunk", "block")).applyInArrow(met, kind)
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Rows:
    """Vectors as matrices, one for each length, and their norms."""

    def __init__(self, vectors: pa.ChunkedArray | pa.Array):
        found = [None if v is None or None in v else v for v in vectors.to_pylist()]
        self.n, self.by = len(found), {}
        for d in {len(v) for v in found if v}:
            at = np.array([i for i, v in enumerate(found) if v and len(v) == d])
            m = np.array([found[i] for i in at], float)
            self.by[d] = at, m, np.sqrt(np.cumsum(m * m, axis=1)[:, -1])  # summed in order, as relational.cosine() does

    def scores(self, asked: _Rows) -> np.ndarray:
        """Cosines of all that are asked (rows) to all vectors (columns), rounded to five digits as SQL does."""
        out = np.zeros((asked.n, self.n))
        for d in self.by.keys() & asked.by.keys():
            (qi, q, qn), (vi, v, vn) = asked.by[d], self.by[d]
            with np.errstate(all="ignore"):
                n = qn[:, None] * vn
                s = np.where((n > 0) | np.isnan(n), (q @ v.T) / n, 0.0)
                # a product of matrices sums in another order: what is so near to a half of the last digit is summed in order
                i, j = np.nonzero(np.abs(np.abs(s) * 1e5 % 1 - 0.5) < 1e-4)
                for lo in range(0, len(i), 1 << 16):
                    a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                    s[a, b] = np.cumsum(q[a] * v[b], axis=1)[:, -1] / n[a, b]
            out[np.ix_(qi, vi)] = np.sign(s) * np.floor(np.abs(s) * 1e5 + 0.5) / 1e5 + 0.0
        return out


def vector_index(rows: DataFrame, column: str, key: str, lists: int | None = None, sample: int = SAMPLE_ROWS, seed: int = 7) -> VectorIndex:
    """An index of all rows by their vectors. Centroids are fitted on at most `sample` rows, chosen by a hash of `key`; lists: how many (by default as many as LIST_ROWS asks for)."""
    rows = rows.drop("list") if "list" in rows.columns else rows
    n = rows.count()
    usual = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = rows.sparkSession
    if usual is None:
        stored = put(rows.withColumn("list", F.lit(NONE)), "list", 1)
        return VectorIndex(stored, column, [NONE] if n else [], np.zeros((1 if n else 0, 1)), np.full(1 if n else 0, math.pi))
    unit = rows.withColumn("_unit", F.when(F.size(column) == usual["n"], _unit(F.col(column))))
    k = lists or max(1, min(MOST_LISTS, n // LIST_ROWS, 2 * math.isqrt(n)))
    some = unit.where("_unit IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), key)).limit(sample).repartition(max(1, min(64, min(n, sample) // FIT_ROWS))).select(array_to_vector("_unit").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some) if k > 1 and not some.isEmpty() else None
    centres = np.array([c / (np.linalg.norm(c) or 1) for c in model.clusterCenters()]) if model else np.eye(1, usual["n"])
    there = unit.withColumn("features", array_to_vector(F.coalesce("_unit", F.array_repeat(F.lit(1.0), usual["n"]))))
    there = model.transform(there) if model else there.withColumn("prediction", F.lit(0))
    listed = there.withColumn("list", F.when(F.col("_unit").isNull(), NONE).otherwise(F.col("prediction"))).drop("features", "prediction", "_unit")
    # a hot list's rows are written by several tasks
    dealt = listed.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    stored = put(dealt, "list", min(256, max(buckets(n), k // 4)), deal=["list", "_part"]).drop("_part")
    centre = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, _centre array<double>")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col(column), F.col("_centre")))))
    # as many rows as there are lists
    told = {r["list"]: r["angle"] for r in stored.join(F.broadcast(centre), "list", "left").groupBy("list").agg(F.max(F.when(F.col("list") == NONE, F.lit(0.0)).otherwise(angle)).alias("angle")).collect()}
    names = sorted(told)
    return tuned(VectorIndex(stored, column, names, np.array([centres[x] if x != NONE else np.zeros(usual["n"]) for x in names]), np.array([told[x] + 1e-6 for x in names])), key)


def tuned(index: VectorIndex, key: str, recall: float = RECALL) -> VectorIndex:
    """The index with the least number of probes that finds `recall` of the ten nearest of TUNE_ROWS of its vectors, as an exact search over all rows has them."""
    rows = index.vectors.where((F.col("list") != NONE) & F.col(key).isNotNull()).orderBy(F.xxhash64(F.lit(1), key)).limit(TUNE_ROWS)
    asked = {r["query_id"]: r["query"] for r in rows.select(F.col(key).alias("query_id"), F.col(index.column).alias("query")).collect()}
    if not asked:
        return index
    spark = index.vectors.sparkSession
    queries = spark.createDataFrame([*asked.items()], T.StructType([T.StructField("query_id", index.vectors.schema[key].dataType), T.StructField("query", index.vectors.schema[index.column].dataType)]))
    place = {q: {index.lists[i]: p for p, i in enumerate(np.argsort(index.near(v), kind="stable"))} for q, v in asked.items()}
    found = sorted(place[r["query_id"]][r["list"]] for r in index.search_all(queries, id_column=key, exact=True).select("query_id", "list").collect())
    return replace(index, probes=found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)] + 1)
