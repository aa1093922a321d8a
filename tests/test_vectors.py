"""The vector index against a scan of all vectors."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import relational
from skeinwork.operators.vector_index import vector_index
from skeinwork.sources.tables import table

SCHEMA = "vec_id long, label int, embedding array<float>"


def scan(df, query, k=10, condition="true"):
    return [(r["vec_id"], r["score"]) for r in relational.nearest(df, query, k, condition).collect()]


def odd(spark):
    """Groups of near vectors, copies of one vector, and such that aren't vectors."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, i % 5, [x + rng.gauss(0, 0.3) for x in centres[i % 6]]) for i in range(300)] + [(300 + i, i % 5, centres[0]) for i in range(200)]
    rows += [(600, 1, None), (601, 1, []), (602, 1, [0.0] * 8), (603, 1, [1.0, 2.0]), (604, 1, [None] * 8), (None, 2, centres[1])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def built(spark):
    df = odd(spark)
    return df, vector_index(df.withColumn("other", F.lit("x")), "embedding", "vec_id")


@pytest.mark.parametrize("condition", ["true", "label = 3", "label = 99"])
def test_exact_searches_are_scans(spark, built, condition):
    df, index = built
    rng = random.Random(1)
    for q in ([rng.gauss(0, 1) for _ in range(8)], [0.0] * 8, [1.0], [float(x) for x in df.where("vec_id = 300").first()["embedding"]]):
        got = index.search(q, 10, condition, probes=2, exact=True)
        rows = [(r["vec_id"], r["score"]) for r in got.collect()]
        want = scan(df.where("vec_id IS NULL OR vec_id NOT IN (604)"), q, 10, condition)
        assert [s for _, s in rows] == [s for _, s in want] and {x for x in rows if x[0] != 604} <= set(scan(df, q, 600, condition)) | {(604, 0.0)}


def test_every_row_is_in_the_index(built):
    df, index = built
    assert index.vectors.count() == df.count() and index.vectors.columns == [*df.columns, "other", "list"]


def test_nothing_to_index(spark):
    for rows in ([], [(1, 1, None), (2, 1, [])]):
        index = vector_index(spark.createDataFrame(rows, SCHEMA), "embedding", "vec_id")
        assert index.search([1.0, 2.0], exact=True).count() == len(rows)
        assert index.search_all(spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>"), exact=True).count() == len(rows)


def test_recall_and_buckets(spark):
    """Of the ten nearest that a scan finds for every fiftieth vector, the probed lists hold nine in ten or more; a search opens some buckets."""
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    index = vector_index(df, "embedding", "vec_id")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got, exact = ({(r["query_id"], r["id"]) for r in index.search_all(asked, exact=e).collect()} for e in (False, True))
    queries = asked.collect()
    want = {(q["query_id"], x) for q in queries[:8] for x, _ in scan(df, q["query"])}
    assert want == {(q, x) for q, x in exact if q in {y["query_id"] for y in queries[:8]}}
    recall = len(got & exact) / len(exact)
    print("recall@10", recall, "lists", len(index.lists), "probes", index.probes)
    assert len(exact) == 10 * len(queries) and recall >= 0.9
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    plan = index.chosen([1, 2], "label = 1")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: " in plan and "SelectedBucketsCount: 12 out of 12" not in plan


def test_scores_of_matrices_round_as_sql():
    """Scores that lie on a half of the last digit, odd lengths, nulls and empty vectors, against sums in order."""
    import math
    from decimal import ROUND_HALF_UP, Decimal

    import pyarrow as pa

    from skeinwork.operators.vector_index import _Rows

    rng = random.Random(2)
    vs = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(60)] + [[1.0, 0.0], [3.0, 4.0], [0.0, 0.0], [], None, [None, 1.0]] + [[a, math.sqrt(1 - a * a)] for a in (0.123455, 0.5, 0.000005, 0.999995, -0.123455)]
    kind = pa.list_(pa.float64())
    got = _Rows(pa.array(vs, kind)).scores(_Rows(pa.array(vs, kind)))

    def score(a, b):
        if not a or not b or None in a or None in b or len(a) != len(b):
            return 0.0
        dot, x, y = 0.0, 0.0, 0.0
        for p, q in zip(a, b):
            dot, x, y = dot + p * q, x + p * p, y + q * q
        n = math.sqrt(x) * math.sqrt(y)
        return float(Decimal(repr(dot / n)).quantize(Decimal("0.00001"), ROUND_HALF_UP)) if n > 0 else 0.0

    assert [[score(q, v) for v in vs] for q in vs] == got.tolist()
