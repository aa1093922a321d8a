"""Contexts as text, their summaries, and checks of the plans made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skeinwork.operators.relational import hybrid, within_budget

BLANK = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def labelled(label: str, value: Column) -> Column:
    """'label value', or null for a value that is null or empty."""
    return F.when(value != "", F.concat(F.lit(label), value))


def rendered(kind: Column, node_id: Column, name: Column, filepath: Column, source: Column, summary: Column) -> Column:
    """A context as lines: its kind, then what is known of it, or its id where nothing is."""
    known = F.concat_ws("\n", labelled("Name: ", name), labelled("File: ", filepath), labelled("Code:\n", source), labelled("Summary: ", summary))
    return F.concat_ws("\n", F.when(kind != "", F.concat(F.lit("["), kind, F.lit("]"))), F.when(known != "", known).otherwise(labelled("Node: ", node_id)))


def first_tokens(text: Column, most: int) -> Column:
    """The first `most` tokens, parted by spaces, of a text."""
    return F.array_join(F.slice(F.split(text, " "), 1, most), " ")


def embedding_text(kind: Column, name: Column, signature: Column, docstring: Column, source: Column) -> Column:
    """What of a symbol is embedded, a line each: kind and name, signature, documentation, source (cut by the caller); what is null is left out."""
    return F.concat_ws("\n", F.concat_ws(": ", kind, name), signature, docstring, source)


def key_facts(text: Column, most: int = 10) -> Column:
    """The first sentences, which end at '. ' or a line feed, as an array; blank ones don't count."""
    sentences = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(". ")), r"\. ")
    return F.slice(F.filter(F.transform(sentences, stripped), lambda s: s != ""), 1, most)


def truncated(text: Column, most: int) -> Column:
    """A text of more than `most` tokens (parted by spaces) is cut there, at its last full stop if that is in the second half."""
    tokens = F.split(text, " ")
    cut = F.array_join(F.slice(tokens, 1, most), " ")
    after = F.length(cut) - F.instr(F.reverse(cut), ".")  # characters before the last full stop
    sentence = F.when(cut.contains(".") & (after > F.floor(F.length(cut) / 2)), F.substring(cut, F.lit(1), (after + 1).cast("int"))).otherwise(cut)
    return F.when(F.size(tokens) <= most, text).otherwise(sentence)


def summaries(contexts: DataFrame, group: str, budget: int, most: int = 2000) -> DataFrame:
    """One row for each group: its best contexts within the budget as one text of `most` characters at most, how many there are, mean confidence.

    contexts: group, id, score, tokens, text, confidence. What is gathered for a group is bounded by its budget.
    """
    order = [F.desc("score"), F.col("id")]
    fit = within_budget(contexts, "tokens", order, budget, group).withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"])
    out = fit.groupBy(group).agg(F.substring(F.array_join(texts, "\n"), 1, most).alias("summary"), F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    return out


def merged(results: DataFrame) -> DataFrame:
    """Contexts of several results (result, seq, node_id, ...): of a node's contexts the first, by result and place; contexts without a node all stay."""
    named = results.where("coalesce(node_id, '') <> ''").groupBy("node_id").agg(F.min_by(F.struct(*(c for c in results.columns if c != "node_id")), F.struct("result", "seq")).alias("x")).select("node_id", "x.*")
    return named.select(*results.columns).unionByName(results.where("coalesce(node_id, '') = ''"))


def ranked(contexts: DataFrame) -> DataFrame:
    """contexts (semantic_similarity, score, impact_score) with rank_score, 0.6 of the semantic part and 0.4 of the impact."""
    return contexts.withColumn("rank_score", hybrid(F.col("semantic_similarity"), F.col("score"), F.col("impact_score")))


RESERVED = 800


def summarized(results: DataFrame, group: str, budget: int, most: int = 2000, reserved: int = RESERVED) -> DataFrame:
    """Merge, rank, budget, summarise: one row for each request (`group`).

    results: group, result, seq, node_id, text, tokens, confidence, filepath, source_text and the parts of the rank. Of the merged contexts the best stay before the first that
    doesn't fit into budget less `reserved` tokens; summary is their text, cut to `most` characters, with its key facts, snippets, and the results' mean confidence.
    """
    per = results.groupBy(group).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    parts = results.withColumn("node_id", F.when(F.coalesce("node_id", F.lit("")) != "", F.concat_ws("\x00", F.col(group).cast("string"), "node_id")))
    r = ranked(merged(parts))
    order = [F.desc("rank_score"), F.col("result"), F.col("seq")]
    fit = within_budget(r, "tokens", order, max(0, budget - reserved), group).withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("_at", "text", snippet(F.col("filepath"), F.col("source_text")).alias("snippet"))))
    g = fit.groupBy(group).agg(rows.alias("x"), F.count("*").alias("n"))
    summary = F.substring(F.array_join(F.transform("x", lambda v: v["text"]), "\n"), 1, most)
    out = g.select(group, "n", summary.alias("summary"), F.array_compact(F.transform("x", lambda v: v["snippet"])).alias("snippets"))
    return per.join(out, group, "left").withColumn("key_facts", key_facts(F.col("summary")))


def snippet(filepath: Column, source: Column) -> Column:
    """A source text with its file ('unknown' without one); null without a source."""
    return F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.coalesce(filepath, F.lit("unknown")), F.lit("\n"), source))


def narrative(names: Column, relations: Column) -> Column:
    """Names of a path with the relations between them: a (calls) → b."""
    step = lambda x: F.concat(x["names"], F.when(x["relations"].isNotNull(), F.concat(F.lit(" ("), x["relations"], F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(F.arrays_zip(names.alias("names"), relations.alias("relations")), step), " → ")


def hue(module: Column) -> Column:
    """A colour's angle for a module: a rolling hash of its characters whose shift wraps at 32 bits."""
    def wrapped(x: Column) -> Column:
        return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)

    codes = F.transform(F.filter(F.split(module, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: c + wrapped(h * 32) - h)) % 360


def resolved(patch: Column, gold: Column) -> Column:
    """Whether a patch that isn't empty equals the right one, blanks around them aside."""
    return F.coalesce((patch != "") & (stripped(patch) == stripped(gold)), F.lit(False))


def stagnant(runs: DataFrame, key: str, order: str, failed: str, most: int = 3) -> DataFrame:
    """stop: whether a run is the last allowed one or fails in as many tests as the run before it or more."""
    w = W.partitionBy(key).orderBy(order)
    worse = F.coalesce(F.col(failed) >= F.lag(failed).over(w), F.lit(False))
    return runs.withColumn("stop", worse | (F.row_number().over(w) > most))


Task = tuple[str, list[str], str]


def supported(nodes: DataFrame, tasks: list[Task]) -> list[Task]:
    """Tasks (id, queries, agent) of a plan that search freely or have a query which is part of some symbol's name. One scan serves all."""
    asked = {t: [q for q in queries if q] for t, queries, agent in tasks if agent != "search"}
    marks = [F.max(reduce(Column.__or__, [F.col("name").contains(q) for q in qs])).alias(f"t{i}") for i, qs in enumerate(asked.values()) if qs]
    found = nodes.agg(*marks).first().asDict() if marks else {}
    known = {t for i, t in enumerate(asked) if found.get(f"t{i}")}
    return [task for task in tasks if task[2] == "search" or task[0] in known]


def with_signals(tasks: list[Task], symbols: list[str], most: int = 3) -> list[Task]:
    """The plan and a search for each of the first `most` tested symbols that no task asks for."""
    asked = {q for _, queries, _ in tasks for q in queries}
    return tasks + [(f"subtask-test-{s}", [s], "search") for s in symbols[:most] if s not in asked]
