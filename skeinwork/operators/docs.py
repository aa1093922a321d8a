"""Documentation layers joined to symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.relational import first_n, latest
from skeinwork.operators.traversal import held, with_confidence


def prefix_links(nodes: DataFrame, arch: DataFrame) -> DataFrame:
    """(key, module_path) where the module is a whole-segment prefix of the path: prefixes are exploded, and the join is an equi-join."""
    parts = F.split("filepath", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    exploded = nodes.select("key", F.explode(prefixes).alias("module_path"))
    return exploded.join(arch, "module_path").select("key", "module_path", "architectural_role")


TESTS = "contains(name, 'test') or contains(name, 'spec') or contains(filepath, 'test') or contains(filepath, 'spec')"


def tests_of(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(key, test): the tests that call or import a symbol, the first `most` by id."""
    tests = nodes.where(TESTS).select(F.col("key").alias("src"), F.col("id").alias("test"))
    pairs = edges.where("relation in ('calls', 'imports')").join(tests, "src").select(F.col("dst").alias("key"), "test").distinct()
    return first_n(pairs, ["key"], ["test"], most)


def traceability(nodes: DataFrame, edges: DataFrame, desc: DataFrame, docs: DataFrame, arch: DataFrame) -> DataFrame:
    """For every symbol: requirement_links (its descriptions, then their details), test_coverage (20 ids), architecture_context (modules), and three flags."""
    link = lambda t, at, text: F.struct(F.lit(at).alias("at"), F.lit(t).alias("type"), F.col(text).alias("text"))
    links = desc.select(F.col("node_id").alias("key"), link("ComponentDescription", 1, "summary").alias("x"))
    links = links.union(docs.select(F.col("component_id").alias("key"), link("ComponentDoc", 2, "data_flow").alias("x")))
    some = links.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("requirement_links"))
    tests = tests_of(nodes, edges).groupBy("key").agg(F.array_sort(F.collect_list("test")).alias("test_coverage"))
    where = prefix_links(nodes, arch).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("module_path", "architectural_role"))).alias("architecture_context"))
    out = nodes.select("key", "id").join(some, "key", "left").join(tests, "key", "left").join(where, "key", "left")
    for n in ("requirement_links", "test_coverage", "architecture_context"):
        out = out.withColumn(n, F.coalesce(n, F.array().cast(out.schema[n].dataType)))
    return out.withColumns({"has_documentation": F.size("requirement_links") > 0, "has_test_coverage": F.size("test_coverage") > 0, "has_architecture_context": F.size("architecture_context") > 0})


def located(nodes: DataFrame, text: str, repo_id: str, most: int) -> DataFrame:
    """Symbols of a repository that are named `text` or whose path holds it, the first `most` by id."""
    hit = (F.col("name") == text) | F.col("filepath").contains(text)
    return nodes.where(hit & (F.col("repo_id") == repo_id)).orderBy("id").limit(most)


def trace(nodes: DataFrame, desc: DataFrame, docs: DataFrame, arch: DataFrame, source: str, repo_id: str, level: str = "architecture", sources: int = 5) -> DataFrame:
    """The chain from a source's symbols to the documentation: key, type, node_id, text, and the confidence of all.

    Descriptions always; their details at level component and architecture; modules at level architecture. Any other level gives descriptions.
    """
    some = located(nodes, source, repo_id, sources).select("key", "filepath")
    parts = [some.join(desc, some["key"] == desc["node_id"]).select("key", F.lit("component_desc").alias("type"), F.col("node_id").cast("string").alias("node_id"), F.col("summary").alias("text"))]
    if level in ("component", "architecture"):
        parts.append(some.join(docs, some["key"] == docs["component_id"]).select("key", F.lit("component"), F.col("component_id").cast("string"), "data_flow"))
    if level == "architecture":
        parts.append(prefix_links(some, arch).select("key", F.lit("architecture"), "module_path", "architectural_role"))
    return with_confidence(reduce(DataFrame.union, parts), 10)


def context(nodes: DataFrame, edges: DataFrame, desc: DataFrame, docs: DataFrame, arch: DataFrame, text: str, repo_id: str, most: int = 10, expanded: int = 5) -> DataFrame:
    """What surrounds the symbols that `text` locates: context_id, type, summary, data_flow, and the confidence of all.

    The first `expanded` of the located symbols are expanded: what contains them or is contained by them, and the modules that they are part of; located ones
    aren't context. Further rounds would expand the same symbols and find nothing new, so one round is what any depth gives.
    """
    at = located(nodes, text, repo_id, most).select("key", "id", "filepath")
    few = at.orderBy("id").limit(expanded)
    c = edges.where("relation = 'contains'").select("src", "dst")
    near = few.join(c.union(c.select("dst", "src")).toDF("key", "context"), "key").select(F.col("context").alias("key")).distinct().join(at, "key", "left_anti")
    keys, near = held(near, "key")
    # symbols and texts of what is near alone are joined
    some = lambda t: t.join(near, "key", "left_semi") if keys is None else t.where(F.col("key").isin(keys))
    named = some(nodes.select("key", "id"))
    d, l = some(desc.select(F.col("node_id").alias("key"), "summary")), some(docs.select(F.col("component_id").alias("key"), "data_flow"))
    symbols = named.join(d, "key", "left").join(l, "key", "left").select(F.col("id").alias("context_id"), F.lit("symbol").alias("type"), "summary", "data_flow")
    modules = prefix_links(few, arch).select(F.col("module_path").alias("context_id"), F.lit("module").alias("type"), F.col("architectural_role").alias("summary"), F.lit(None).cast("string").alias("data_flow")).distinct()
    return with_confidence(symbols.union(modules), 30)


# -- layers stored


def stored_layers(nodes: DataFrame, desc: DataFrame, docs: DataFrame, arch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is kept of new documentation: descriptions of known symbols, details of kept descriptions, and modules with the symbols that they link."""
    kept = desc.join(nodes.select(F.col("key").alias("node_id")), "node_id", "left_semi")
    details = docs.join(kept.select(F.col("node_id").alias("component_id")), "component_id", "left_semi")
    return kept, details, prefix_links(nodes, arch)


def stored_embeddings(nodes: DataFrame, old: DataFrame, new: DataFrame, dimensions: int) -> DataFrame:
    """old with new vectors (key, vector) put in by key; a vector of another length is an error, one of an unknown symbol is dropped.

    Of new vectors of one key that with the largest `version` stays, if there is such a column, and the largest one among equals.
    """
    size = F.coalesce(F.size("vector"), F.lit(-1))
    checked = new.withColumn("vector", F.when(size == dimensions, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("a vector has length "), size.cast("string"), F.lit(f", not {dimensions}")))))
    known = latest(checked.join(nodes.select("key"), "key", "left_semi"), "key", version="version").select(*old.columns)
    return old.join(known.select("key"), "key", "left_anti").unionByName(known)


def import_links(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """imports: id, target (a dotted path). definitions: id, name, kind. Links from an import to what has its last segment as its name."""
    i = imports.select(F.col("id").alias("src"), F.element_at(F.split("target", r"\."), -1).alias("name"))
    d = definitions.where(~F.col("kind").isin("import", "module", "decorator")).select(F.col("id").alias("dst"), "name")
    return i.join(d, "name").where("src <> dst").select("src", "dst").distinct()


def layered(nodes: DataFrame, desc: DataFrame, docs: DataFrame, arch: DataFrame, facts: DataFrame, memory: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (layer, id, label), the first `most` of each layer by id, and the edges between them (source, target, relation), the first 2 * `most` of each kind.

    Layers are symbols, descriptions, details, modules, facts (id, label) and memory (id, label); edges link symbols to each other, to their
    descriptions and modules, and descriptions to details.
    """

    def top(df: DataFrame, layer: str, key: str, label: str) -> DataFrame:
        return df.select(F.lit(layer).alias("layer"), F.col(key).cast("string").alias("id"), F.col(label).alias("label")).orderBy("id", "label").limit(most)

    def links(df: DataFrame, relation: str, a: DataFrame, b: DataFrame) -> DataFrame:
        ends = df.join(a.select(F.col("id").alias("source")), "source", "left_semi").join(b.select(F.col("id").alias("target")), "target", "left_semi")
        return ends.select("source", "target", F.lit(relation).alias("relation")).distinct().orderBy("source", "target").limit(2 * most)

    symbols, about, details, modules = top(nodes, "symbol", "id", "name"), top(desc, "description", "node_id", "summary"), top(docs, "detail", "component_id", "data_flow"), top(arch, "module", "module_path", "architectural_role")
    ids = nodes.select("key", "id")
    calls = edges.join(ids.toDF("src", "source"), "src").join(ids.toDF("dst", "target"), "dst")
    sets = [links(calls.where(F.col("relation") == r).select("source", "target"), r, symbols, symbols) for r in ("calls", "contains")]
    sets.append(links(ids.join(desc, ids["key"] == desc["node_id"]).select(F.col("id").alias("source"), F.col("node_id").cast("string").alias("target")), "described_by", symbols, about))
    sets.append(links(docs.select(F.col("component_id").cast("string").alias("source"), F.col("component_id").cast("string").alias("target")), "detailed_in", about, details))
    sets.append(links(prefix_links(nodes, arch).join(ids, "key").select(F.col("id").alias("source"), F.col("module_path").alias("target")), "part_of_architecture", symbols, modules))
    vertices = [symbols, about, details, modules, top(facts, "fact", "id", "label"), top(memory, "memory", "id", "label")]
    return reduce(DataFrame.union, vertices), reduce(DataFrame.union, sets)
