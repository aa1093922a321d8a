"""Symbols as facts and files as episodes, for stores that keep those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.relational import first_n

SYMBOLS = ("class", "function", "method", "module")
#: Fixed value: the namespace of URLs for name-based identifiers.
URLS = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based identifier (version 5) of a name in the namespace of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URLS)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def symbol_facts(nodes: DataFrame, desc: DataFrame) -> DataFrame:
    """A fact for each class, function, method and module: attribute (80 characters) and value (400) from signature and description or documentation."""
    d = desc.select(F.col("node_id").alias("key"), "summary")
    j = nodes.where(F.col("kind").isin(*SYMBOLS)).join(d, "key", "left")
    blank = lambda c: F.when(c != "", c)
    value = F.concat_ws(" — ", blank(F.col("signature")), F.coalesce(blank(F.col("summary")), blank(F.substring("docstring", 1, 200))))
    value = F.when(value == "", F.concat("kind", F.lit(" in "), "filepath")).otherwise(value)
    return j.select("key", F.substring(F.concat("kind", F.lit("."), "name"), 1, 80).alias("attribute"), F.substring(value, 1, 400).alias("value"), F.concat_ws(":", F.lit("index"), "repo_id", "filepath").alias("session_id"))


def dependency_facts(nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """A fact for each of the first `most` calls, imports and inheritances of a symbol's name, by the name of what it needs."""
    n = nodes.select("key", "name")
    j = edges.where("relation in ('calls', 'imports', 'inherits')").join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst")
    few = first_n(j, ["relation", "a"], ["b", "dst", "src"], most)
    return few.select(F.concat("relation", F.lit("_dependency")).alias("attribute"), F.substring(F.concat("a", F.lit(" → "), "b"), 1, 200).alias("value"))


def episodes(nodes: DataFrame, desc: DataFrame, least: int = 50) -> DataFrame:
    """An episode for each file of a repository: its classes, functions and methods by line, with the beginning of their documentation. Files with less than `least` characters have none."""
    d = desc.select(F.col("node_id").alias("key"), "summary")
    j = nodes.join(d, "key", "left")
    text = F.coalesce(F.when(F.col("docstring") != "", F.col("docstring")), "summary", F.lit(""))
    head = F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.concat_ws(" ", "kind", "name"))
    line = F.when(F.col("kind").isin("class", "function", "method"), F.concat(head, F.when(text != "", F.concat(F.lit("\n  # "), F.substring(text, 1, 150))).otherwise(""), F.lit("\n")))
    g = j.groupBy("repo_id", "filepath").agg(F.array_sort(F.collect_list(F.struct("start_line", "key", line.alias("t")))).alias("x"))
    parts = F.array_compact(F.transform("x", lambda r: r["t"]))
    transcript = F.concat(F.lit("FILE: "), "filepath", F.lit("\n"), F.when(F.size(parts) > 0, F.concat(F.lit("\n"), F.array_join(parts, "\n"))).otherwise(""))
    name = F.concat("repo_id", F.lit(":file:"), F.translate("filepath", "/.", "__"))
    out = g.select("repo_id", "filepath", uuid5(name).alias("episode_id"), F.concat(F.lit("Code file: "), "filepath").alias("summary"), transcript.alias("transcript"))
    return out.where(F.length("transcript") >= least)
