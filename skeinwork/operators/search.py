"""Searches for symbols: by vectors, by words, by kind of search; the history of searches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.relational import cosine
from skeinwork.operators.traversal import with_confidence


def semantic(nodes: DataFrame, embeddings: DataFrame, query: list[float], k: int = 10, repo_id: str = "", kinds: tuple[str, ...] = ()) -> DataFrame:
    """The k symbols whose vectors are nearest to the query's: node_id, name, kind, filepath, score. Repository and kinds choose first, then the nearest are taken.

    embeddings: key, vector.
    """
    some = nodes.where(F.col("repo_id") == repo_id) if repo_id else nodes
    some = some.where(F.col("kind").isin(*kinds)) if kinds else some
    score = F.round(cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in query))), 5)
    hits = embeddings.join(some, "key").select(F.col("id").alias("node_id"), "name", "kind", "filepath", score.alias("score"))
    return hits.orderBy(F.desc("score"), "node_id").limit(k)


def symbols(nodes: DataFrame, query: str, k: int = 10, repo_id: str = "", kinds: tuple[str, ...] = ()) -> DataFrame:
    """The first k symbols by id whose name or path holds the query, with score 1."""
    some = nodes.where(F.col("name").contains(query) | F.col("filepath").contains(query))
    some = some.where(F.col("repo_id") == repo_id) if repo_id else some
    some = some.where(F.col("kind").isin(*kinds)) if kinds else some
    return some.select(F.col("id").alias("node_id"), "name", "kind", "filepath", F.lit(1.0).alias("score")).orderBy("node_id").limit(k)


def search(nodes: DataFrame, embeddings: DataFrame | None, query: str, repo_id: str, search_type: str = "semantic", k: int = 10, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """A semantic search if asked for and there is something to embed the query with; else, and for tags, a search for symbols. With the list's confidence."""
    if search_type == "semantic" and embed is not None and embeddings is not None:
        return with_confidence(semantic(nodes, embeddings, embed(query), k, repo_id), k)
    return with_confidence(symbols(nodes, query, k, repo_id), k)


def code_facts(nodes: DataFrame, query: str, repo_id: str, k: int = 15, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Symbols of a repository whose name or documentation holds one of the query's first five words of more than three letters, the first k by id, as facts: attr, val, ftype, sdate, score."""
    words = [w for w in query.lower().split() if len(w) > 3][:5]
    hit = reduce(Column.__or__, [F.lower(F.coalesce(c, F.lit(""))).contains(w) for w in words for c in ("name", "docstring")], F.lit(False))
    some = nodes.where(hit & (F.col("repo_id") == repo_id))
    some = some.where(F.col("kind").isin(*kinds)) if kinds else some
    return some.orderBy("id").limit(k).select(F.col("name").alias("attr"), F.coalesce("docstring", "signature", "kind").alias("val"), F.col("kind").alias("ftype"), F.col("filepath").alias("sdate"), F.lit(1.0).alias("score"))


def free_text(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows whose first column that isn't null holds the text, in any case."""
    return rows.where(F.lower(F.coalesce(*columns)).contains(text.lower()))


def source_search(nodes: DataFrame, text: str, repo_id: str, limit: int = 20) -> DataFrame:
    """Symbols of a repository whose name, documentation or source holds the text, the first by id, with a snippet and score 0.5."""
    hit = reduce(Column.__or__, [F.coalesce(c, F.lit("")).contains(text) for c in ("name", "docstring", "source_text")])
    snippet = F.coalesce("docstring", F.substring("source_text", 1, 200))
    return nodes.where(hit & (F.col("repo_id") == repo_id)).select("id", "name", "kind", snippet.alias("snippet"), F.lit(0.5).alias("score")).orderBy("id").limit(limit)


def visible(nodes: DataFrame, edges: DataFrame, hidden: tuple[str, ...] = ("test_", "tgr_")) -> tuple[DataFrame, DataFrame]:
    """What a viewer shows: symbols of repositories without a hidden prefix, and the edges between them."""
    shown = nodes.where(~reduce(Column.__or__, [F.col("repo_id").startswith(p) for p in hidden], F.lit(False)))
    keys = shown.select("key")
    return shown, edges.join(keys.toDF("src"), "src", "left_semi").join(keys.toDF("dst"), "dst", "left_semi")


def with_history(history: DataFrame, new: DataFrame, most: int = 50) -> DataFrame:
    """Searches (query, ts, results) with new ones: the newest `most`."""
    return history.unionByName(new).orderBy(F.desc("ts"), "query").limit(most)


def history(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The last searches, the newest first."""
    return rows.orderBy(F.desc("ts"), "query").limit(limit)


def properties(rows: DataFrame) -> Column:
    """All of a row's columns that aren't null, as JSON."""
    return F.to_json(F.struct(*rows.columns))
