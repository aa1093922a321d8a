"""Statistics, filters, merges and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# -- statistics


def by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo_id", "kind").agg(F.count("*").alias("n"))


def repo_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are in one repository, with it."""
    n = nodes.select("key", "repo_id")
    joined = edges.join(n.toDF("src", "repo_id"), "src").join(n.toDF("dst", "dst_repo"), "dst")
    return joined.where("repo_id = dst_repo").select("src", "dst", "relation", "repo_id")


def find_edges(nodes: DataFrame, edges: DataFrame, repo_id: str, source: int | None = None, limit: int = 100) -> DataFrame:
    """Edges inside a repository, of one source if that is given, the first by their ends."""
    some = edges if source is None else edges.where(F.col("src") == source)
    return repo_edges(nodes.where(F.col("repo_id") == repo_id), some).orderBy("src", "dst", "relation").limit(limit)


def by_relation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return repo_edges(nodes, edges).groupBy("repo_id", "relation").agg(F.count("*").alias("n"))


def by_extension(nodes: DataFrame, most: int = 20) -> DataFrame:
    """Symbols by the extension of their file."""
    ext = F.regexp_extract("filepath", r"(\.[^./]*)$", 1)
    out = nodes.groupBy(F.when(ext == "", "(no extension)").otherwise(ext).alias("extension")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "extension").limit(most)


def lines(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo_id").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("total_lines"))


def repositories(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols, distinct outgoing edges and the last indexing of every repository, the last indexed first (unknown ones before). nodes may have last_indexed."""
    at = F.col("last_indexed") if "last_indexed" in nodes.columns else F.lit(None).cast("timestamp_ntz")
    out = nodes.select("key", "repo_id", at.alias("last_indexed")).join(edges.select(F.col("src").alias("key"), "dst", "relation"), "key", "left")
    return out.groupBy("repo_id").agg(F.countDistinct("key").alias("node_count"), F.countDistinct("key", "dst", "relation").alias("edge_count"), F.max("last_indexed").alias("last_indexed")).orderBy(F.desc_nulls_first("last_indexed"), "repo_id")


def compare(nodes: DataFrame, repos: list[str]) -> DataFrame:
    """Kinds as rows, repositories as columns."""
    return nodes.where(F.col("repo_id").isin(repos)).groupBy("kind").pivot("repo_id", repos).count().na.fill(0)


def evaluation(runs: DataFrame) -> DataFrame:
    """One row: resolve rate of the runs that weren't skipped, mean cost and seconds, error rate. runs: resolved, skipped, failed, cost, seconds."""
    done = F.sum(F.when(~F.col("skipped"), 1).otherwise(0))
    return runs.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(~F.col("skipped") & F.col("resolved"), 1).otherwise(0)) / F.nullif(done, F.lit(0)), F.lit(0.0)).alias("resolve_rate"),
        F.round(F.avg("cost"), 6).alias("avg_cost"),
        F.round(F.avg("seconds"), 6).alias("avg_seconds"),
        (F.sum(F.when(F.col("failed"), 1).otherwise(0)) / F.count("*")).alias("error_rate"),
    )


# -- filters and searches


def find_nodes(nodes: DataFrame, repo_id: str | None = None, kind: str | None = None, filepath: str | None = None, name: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols that meet all conditions given, the first by id."""
    conditions = [F.col("repo_id") == repo_id] * (repo_id is not None) + [F.col("kind") == kind] * (kind is not None)
    conditions += [F.col("filepath").contains(filepath)] * (filepath is not None) + [F.col("name").contains(name)] * (name is not None)
    found = nodes.where(reduce(Column.__and__, conditions)) if conditions else nodes
    return found.select("id", "kind", "name", "filepath", "start_line", "end_line").orderBy("id").limit(limit)


def snippet(n: int = 200) -> Column:
    return F.coalesce("docstring", F.substring("source_text", 1, n))


def keyword_search(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Symbols whose name, documentation or path holds the text, in any case."""
    low = text.lower()
    hit = reduce(Column.__or__, [F.lower(F.coalesce(c, F.lit(""))).contains(low) for c in ("name", "docstring", "filepath")])
    return nodes.where(hit).select("id", "name", snippet().alias("snippet"), F.lit(0.5).alias("score")).orderBy("id").limit(limit)


def word_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Symbols whose name or documentation holds one of the first five words of more than three letters."""
    words = [w for w in query.lower().split() if len(w) > 3][:5]
    if not words:
        return nodes.select("id", "name").limit(0)
    hit = reduce(Column.__or__, [F.lower(F.coalesce(c, F.lit(""))).contains(w) for w in words for c in ("name", "docstring")])
    return nodes.where(hit).select("id", "name").orderBy("id").limit(limit)


def worth_documenting(kind: Column, source: Column, least: int = 10) -> Column:
    """Classes always, functions and methods of `least` lines or more; a line feed at the end begins no line."""
    n = F.size(F.split(F.regexp_replace(source, r"\n\z", ""), "\n"))
    return F.when(kind == "class", True).when(kind.isin("function", "method"), n >= least).otherwise(False)


# -- merges


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both; of a key's rows the one with the largest version stays, the new one among equals."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_new")


def latest(rows: DataFrame, *keys: str, version: str | None = None) -> DataFrame:
    """One row for each key: that of the largest version, if there is one; among equals the largest by its columns, in their order. By aggregation with partial results."""
    first = [version] if version in rows.columns else []
    rest = first + [c for c in rows.columns if c not in (*keys, *first)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*rows.columns) if rest else rows.distinct()


def coalesce_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge: a new value where there is one, else the old."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in old.columns))


def merge_keeping(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """On a known key only `replaced` change, the rest of the old row stays; unknown keys are added."""
    a, b = old.alias("a"), new.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in replaced else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return a.join(b, same, "full").select(*(pick(c).alias(c) for c in old.columns))


def list_merge(mine: DataFrame, theirs: DataFrame, key: str, lists: list[str], version: str) -> DataFrame:
    """Two copies of a table: newer scalars win, lists are united and sorted, the later version stays."""
    a, b = mine.alias("a"), theirs.alias("b")
    newer = F.col(f"b.{version}") > F.col(f"a.{version}")
    cols = []
    for c in mine.columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == version:
            cols.append(F.greatest(x, y).alias(c))
        elif c in lists:
            cols.append(F.array_sort(F.array_distinct(F.concat(F.coalesce(x, F.array()), F.coalesce(y, F.array())))).alias(c))
        else:
            cols.append(F.when(newer | x.isNull(), F.coalesce(y, x)).otherwise(x).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def diff(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """key and status: new, changed, same or deleted."""
    a, b = current.select(key, F.col(value).alias("_now"), F.lit(True).alias("_a")), previous.select(key, F.col(value).alias("_was"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(F.col("_now").eqNullSafe(F.col("_was")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends are known."""
    k = nodes.select("key")
    return edges.join(k.toDF("src"), "src", "left_semi").join(k.toDF("dst"), "dst", "left_semi").select("src", "dst", "relation").distinct()


# -- ranks


def hybrid(semantic: Column, score: Column, impact: Column) -> Column:
    return 0.6 * F.coalesce(semantic, score, F.lit(0.5)) + 0.4 * F.coalesce(impact, F.lit(0.5))


#: Parts into which a group's rows are dealt before its budget is applied.
PARTS = 32


def within_budget(ranked: DataFrame, tokens: str, order: list, budget: int, group: str | None = None) -> DataFrame:
    """Rows before the first that doesn't fit: running is the sum of tokens (not negative) so far. `group` gives each of its values a budget of its own.

    Rows are dealt over parts by a hash of all columns first (a task that runs again deals alike), and a row whose part alone has spent the budget before it goes: it can't fit, nor can any row behind it. What is left of a
    group is bounded by the budget, however many rows it has, and the exact sums are over that. The first row that doesn't fit is among it.
    """
    names = [group] if group else []
    part = ranked.withColumn("_part", F.pmod(F.xxhash64(*ranked.columns), F.lit(PARTS)))
    sums = lambda *by: F.sum(tokens).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    some = part.withColumn("running", sums(*names, "_part")).where(F.coalesce(F.col("running") - F.coalesce(tokens, F.lit(0)), F.lit(0)) <= budget).drop("_part", "running")
    return some.withColumn("running", sums(*names)).where(F.col("running") <= budget)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key, by aggregation with partial results."""
    return df.groupBy(key).agg(F.min_by(F.struct("*"), order).alias("_row")).select("_row.*")


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different lengths or of no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot / n).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, condition: str = "true") -> DataFrame:
    """The k vectors nearest to the query among those that meet the condition, which is applied first."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(condition).select("vec_id", "label", F.round(cosine(F.col("embedding"), q), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


# -- exports

#: Colours by kind; others are white.
COLOURS = {"class": "lightblue", "function": "lightgreen", "method": "lightgreen", "module": "lightyellow", "import": "lightgray"}


def csv_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "kind", "name", "filepath", "start_line", "end_line", F.substring(F.coalesce("docstring", F.lit("")), 1, 100).alias("docstring"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Graphviz graph of the symbols and the edges between them: part (0 head, 1 symbols, 2 edges, 3 end), line. A file has them by part."""
    spark = nodes.sparkSession
    colour = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    quoted = F.replace("name", F.lit('"'), F.lit('\\"'))
    head = spark.createDataFrame([(0, x) for x in ("digraph G {", "  rankdir=LR;", "  node [shape=box];")] + [(3, "}")], "part int, line string")
    a = nodes.select(F.lit(1), F.format_string('  "%s" [label="%s", style=filled, fillcolor="%s"];', "id", quoted, F.coalesce(F.try_element_at(colour, "kind"), F.lit("white"))))
    ids = nodes.select("key", "id")
    ends = edges.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst")
    return head.union(a).union(ends.select(F.lit(2), F.format_string('  "%s" -> "%s" [label="%s"];', "a", "b", "relation")))


def similar_patches(patches: DataFrame, query: list[float], files: str, k: int = 3) -> DataFrame:
    """The k patches (id, embedding, files) most like a problem: 0.4 of the files' Jaccard similarity to the column `files`, 0.6 of the problems' cosine."""
    some = F.coalesce("files", F.array().cast(patches.schema["files"].dataType))
    score = 0.4 * jaccard(some, F.col(files)) + 0.6 * F.round(cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), 5)
    return patches.select("id", F.round(score, 5).alias("score")).orderBy(F.desc("score"), "id").limit(k)
