"""What the classifiers share: bounded samples of labelled rows, feature matrices made on executors, scores for every row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import docs_of, text_slices

#: A classifier is fitted on this many labelled rows at most, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label and fold of at most `rows` documents whose fold isn't held out.

    Of repeated labels of an id the largest counts, of repeated rows of an id the text with the smallest hash.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    some = some.withColumn("fold", fold("doc_id", folds).cast("int")).where(F.col("fold") != held_out)
    some = some.groupBy("doc_id", "fold").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs_of(docs).join(F.broadcast(some), "doc_id")  # of `rows` rows at most
    return found.groupBy("doc_id", "label", "fold").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("doc_id", "text", "label", "fold")


def matrix(rows: DataFrame, features: Callable[[str, int], list[float]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (of a text and its fold), labels and folds of labelled rows, sorted by id. rows: as many as labelled() was told, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in text_slices(batch):
                x = [features(t.decode("utf-8", "replace"), k) for t, k in zip(raw, part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "fold", "x"])

    made = rows.mapInArrow(run, "doc_id long, label int, fold int, x array<double>").toArrow().sort_by("doc_id")
    if not made.num_rows:
        return np.empty((0, width)), np.empty(0), np.empty(0, dtype=int)
    return np.array(made["x"].to_pylist(), dtype=float), made["label"].to_numpy().astype(float), made["fold"].to_numpy()


def scored(docs: DataFrame, features: Callable[[str], list[float]], predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in text_slices(batch):
                x = np.array([features(t.decode("utf-8", "replace")) for t in raw], dtype=float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predict(x).astype(float))], names=["doc_id", "score"])

    return docs_of(docs).mapInArrow(run, "doc_id long, score double")


def score_column(features: Callable[[str], list[float]], predict: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """The score as a function of a text column, for use beside a table's other columns."""

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        parts = [predict(np.array([features(t or "") for t in texts.iloc[i : i + 256]], dtype=float)) for i in range(0, len(texts), 256)]
        return pd.Series(np.concatenate([np.empty(0), *parts]), dtype=float)

    return lambda c: run(F.coalesce(c.cast("string"), F.lit("")))
