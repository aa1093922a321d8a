"""Command line: index a source tree into a folder of Parquet tables, and ask it."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork import tools
from skeinwork.operators import memory, relational, search, traversal
from skeinwork.session import session
from skeinwork.sources.keyed import Store

MEMORY = "id string, repo_id string, author string, node_type string, data string, summary string, updated_at timestamp, pending_sync boolean"


def shown(df: DataFrame, most: int = 100) -> None:
    """The first rows as JSON lines."""
    for r in df.limit(most).toJSON().collect():
        print(r)


HASHES = "file_path string, file_hash string"


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    store = Store(spark, a.store)
    known = None if a.full or "hashes" not in store.version() else store.read("hashes", HASHES)
    nodes, edges, hashes = tools.index_repository(spark, a.path, a.repo, tuple(a.language), known)
    if known is not None:  # files that aren't parsed again keep their rows, files that are gone lose them
        old_nodes, old_edges = store.read("nodes"), store.read("edges")
        same = relational.diff(hashes, known, "file_path", "file_hash").where("status = 'same'").select(F.col("file_path").alias("filepath"))
        old_nodes = old_nodes.join(same, "filepath", "left_semi").select(*nodes.columns)
        old_edges = old_edges.join(old_nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*edges.columns)
        nodes, edges = old_nodes.unionByName(nodes), old_edges.union(edges)
    with store.change() as change:
        change.put("nodes", nodes, ["id"])
        change.put("edges", edges, edges.columns)
        change.put("hashes", hashes, ["file_path"])
    store.tidy()
    print(json.dumps({"nodes": store.read("nodes").count(), "edges": store.read("edges").count()}))


def keyed(spark: SparkSession, store: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """The store's tables in the form that operators take: nodes with a key, edges by keys."""
    tables = Store(spark, store)
    nodes = tables.read("nodes").withColumns({"key": F.xxhash64("id"), "repo_id": F.lit(repo)})
    edges = tables.read("edges").select(F.xxhash64("source_id").alias("src"), F.xxhash64("target_id").alias("dst"), "relation")
    return nodes, relational.attached(edges, nodes)


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges = keyed(spark, a.store, a.repo)
    shown(relational.repositories(nodes, edges))
    shown(relational.by_kind(nodes).orderBy("kind"))


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges = keyed(spark, a.store, a.repo)
    if a.what == "search":
        shown(search.symbols(nodes, a.text, a.limit))
        return
    key = nodes.where((F.col("id") == a.text) | (F.col("name") == a.text)).agg(F.min_by("key", "id")).first()[0]
    if key is None:
        sys.exit(f"no symbol {a.text}")
    found = {"callers": lambda: traversal.callers(nodes, edges, key, a.depth), "callees": lambda: traversal.callees(nodes, edges, key, a.depth), "impact": lambda: traversal.impact(nodes, edges, nodes.where(F.col("key") == key))}
    shown(found[a.what](), a.limit)


def remember(spark: SparkSession, a: argparse.Namespace) -> None:
    store = Store(spark, a.store)
    rows = store.read("memory", MEMORY)
    if a.what == "remember":
        data = json.loads(a.text)
        row = (data.get("id") or f"{a.type}-{hashlib.sha1(a.text.encode()).hexdigest()[:12]}", a.repo, data.get("author", a.author), a.type, json.dumps(data, sort_keys=True), data.get("title") or data.get("summary") or data.get("problem") or data.get("key") or "", None, False)
        new = spark.createDataFrame([row], MEMORY).withColumn("updated_at", F.current_timestamp())
        row = memory.remembered(rows.limit(0), new, a.author, team=memory.SCOPES[a.type] == "team")
        with store.change() as change:
            change.merge("memory", row, ["id"], "updated_at")
    elif a.what == "search":
        shown(memory.found({k: rows.where(F.col("node_type") == k) for k in memory.SCOPES}, a.text, limit=a.limit))
    elif a.what == "stats":
        shown(rows.groupBy("node_type").count().orderBy("node_type"))
    else:
        shown(memory.listing(rows.where(F.col("node_type") == a.what.removesuffix("s")), a.repo, limit=a.limit))


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skeinwork")
    p.add_argument("--store", default="skeinwork-store", help="folder of the tables")
    p.add_argument("--repo", default="repo", help="name of the repository")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("index", help="parse files that are new or changed")
    c.add_argument("path")
    c.add_argument("--full", action="store_true", help="parse all files")
    c.add_argument("--language", action="append", default=[])
    c.set_defaults(run=index)
    sub.add_parser("status").set_defaults(run=status)
    c = sub.add_parser("query")
    c.add_argument("what", choices=["search", "callers", "callees", "impact"])
    c.add_argument("text")
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--limit", type=int, default=20)
    c.set_defaults(run=ask)
    c = sub.add_parser("memory")
    c.add_argument("what", choices=["remember", "search", "stats", *(f"{k}s" for k in memory.SCOPES)])
    c.add_argument("text", nargs="?", default="")
    c.add_argument("--type", choices=list(memory.SCOPES), default="decision")
    c.add_argument("--author", default="unknown")
    c.add_argument("--limit", type=int, default=20)
    c.set_defaults(run=remember)
    a = p.parse_args(arguments)
    a.run(session(a.master), a)


if __name__ == "__main__":
    main()
