"""What is known of repositories and files: hashes, metadata, their upkeep, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.relational import latest, upsert

#: Dimensions that settings may name.
DIMENSIONS = (256, 512, 768, 1024, 1536, 2048)


def file_hash(hashes: DataFrame, repo_id: str, path: str) -> DataFrame:
    """The stored hash of one file."""
    return hashes.where((F.col("repo_id") == repo_id) & (F.col("file_path") == path)).select("file_hash")


def put_hashes(hashes: DataFrame, new: DataFrame) -> DataFrame:
    """hashes with new ones put in by repository and path; of a file's hashes the one indexed last stays."""
    return upsert(hashes, new.select(*hashes.columns), ["repo_id", "file_path"], "indexed_at")


def changed_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Paths that changed or are new, each once; blank lines don't count."""
    both = tracked.select(F.trim("path").alias("path")).union(untracked.select(F.trim("path")))
    return both.where("path <> ''").distinct()


def repo_id(path: Column) -> Column:
    """A repository's name: its folder's."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def repositories(rows: DataFrame) -> DataFrame:
    """Repositories, the one indexed last first; those that never were come last."""
    return rows.orderBy(F.desc_nulls_last("last_indexed_at"), "repo_id")


def with_status(rows: DataFrame, repo_id: str, status: str, **counts: int) -> DataFrame:
    """rows with a repository's status and the counts that are given."""
    here = F.col("repo_id") == repo_id
    out = rows.withColumn("indexing_status", F.when(here, status).otherwise(F.col("indexing_status")))
    return out.withColumns({c: F.when(here, F.lit(n)).otherwise(F.col(c)) for c, n in counts.items()}) if counts else out


def without_repository(repo_id: str, *tables: DataFrame) -> list[DataFrame]:
    """Every table without a repository's rows: the repository itself, its symbols, hashes and whatever else has a repo_id."""
    return [t.where(~F.col("repo_id").eqNullSafe(repo_id)) for t in tables]


def merged_repository(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with repositories put in or replaced; of rows of one repository the last indexed."""
    one = latest(one, "repo_id", version="last_indexed_at")
    return rows.join(one.select("repo_id"), "repo_id", "left_anti").select(*rows.columns).unionByName(one.select(*rows.columns))


def overview(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Registered repositories (repo_id, last_indexed as ISO text) with node_count and edge_count (within the repository) and last_indexed (null for text that is none), the largest first."""
    n = nodes.groupBy("repo_id").agg(F.count("*").alias("node_count"))
    k = nodes.select("key", "repo_id")
    e = edges.join(k.toDF("src", "repo_id"), "src").join(k.toDF("dst", "other"), "dst").where("repo_id = other").groupBy("repo_id").agg(F.count("*").alias("edge_count"))
    out = repos.join(n, "repo_id", "left").join(e, "repo_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("repo_id", zero("node_count"), zero("edge_count"), F.expr("try_cast(last_indexed AS timestamp_ntz)").alias("last_indexed")).orderBy(F.desc("node_count"), "repo_id")


def json_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols of a repository as JSON with their outgoing edges to symbols of the same one: key, id, json."""
    k = nodes.select("key", "id", "repo_id")
    e = edges.join(k.toDF("src", "a", "repo_id"), "src").join(k.toDF("dst", "b", "other"), "dst").where("repo_id = other")
    out = e.groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("b").alias("target"), F.col("relation")))).alias("edges"))
    j = nodes.select("key", "id", "name", "kind", "filepath").join(out, "key", "left")
    return j.select("key", "id", F.to_json(F.struct("id", "kind", "name", "filepath", F.coalesce("edges", F.array().cast(out.schema["edges"].dataType)).alias("edges"))).alias("json"))


def settings_errors(row: Column) -> Column:
    """What is wrong with settings. row: a struct of uri, port, dimensions, batch; null: not given."""
    wrong = (
        (~(row["uri"].startswith("bolt://") | row["uri"].startswith("neo4j://")), "the address must start with bolt:// or neo4j://"),
        (~row["port"].between(1, 65535), "the port must be between 1 and 65535"),
        (~row["dimensions"].isin(*DIMENSIONS), f"dimensions must be one of {', '.join(map(str, DIMENSIONS))}"),
        (~row["batch"].between(1, 1000), "the batch size must be between 1 and 1000"),
    )
    return F.array_compact(F.array(*(F.when(condition, text) for condition, text in wrong)))


def report(runs: DataFrame) -> DataFrame:
    """Results of a repository's questions as markdown: repo_id, text. runs: repo_id, num, question, facts, episodes, context."""
    part = F.concat(F.lit("## Q"), F.col("num"), F.lit(": "), "question", F.lit("\n\n**Facts:** "), F.col("facts"), F.lit(" | **Episodes:** "), F.col("episodes"), F.lit(" | **Context:** "), F.length("context"), F.lit(" characters\n\n```\n"), F.substring("context", 1, 500), F.lit("\n```\n"))
    g = runs.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("num", part.alias("t")))).alias("x"))
    return g.select("repo_id", F.concat(F.lit("# "), "repo_id", F.lit(" results\n\n"), F.array_join(F.transform("x", lambda r: r["t"]), "\n")).alias("text"))
