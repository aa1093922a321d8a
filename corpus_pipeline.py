"""A corpus pipeline of five operators: toxicity, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and rereads as the next
stage's docs; what the stage before wrote goes then. All stages but the last return the columns of documents.

Defined cases: without documents there are no rows; null texts are empty ones to every stage and stay null up to the last; rows with a null doc_id are told apart by their
texts; of repeated rows one stays; without labels no document is toxic; of equal or near texts that with the smallest known doc_id stays; texts of any
length are read whole; columns that a stage doesn't read, whatever their names, go through to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm.common import Work, read_table, written
from skeinwork.llm.jaccard import deduplicated
from skeinwork.llm.mixing import sampled
from skeinwork.llm.secrets import masked
from skeinwork.llm.toxicity import without_toxic
from skeinwork.llm.unigram import digests


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more) stays."""
    return deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds."""
    return masked(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their target weights."""
    return sampled(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces: their number, a digest of their ids, and whether they decode to the text."""
    import public_tokenizers

    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    with Work(spark) as work:
        for name, stage in STAGES[:-2]:
            docs = work.put(stage(spark, docs, sf_dir), f"pipeline-{name}")
            work.drop_first(len(work.paths) - 1)
        name, stage = STAGES[-2]
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trees, components and a transducer aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
