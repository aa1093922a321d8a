"""Journals: entries as text, logs, extraction and promotion of what was said, compaction, permanent sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skeinwork.operators.analysis import extract
from skeinwork.operators.context import stripped

#: Lines from which a log is compacted, and lines that stay.
THRESHOLD, KEEP = 300, 60
SECTIONS = {"decisions": "## Decisions", "preferences": "## Preferences", "conventions": "## Conventions", "failed": "## Failed Approaches"}


def turn_entry(ts: Column, role: Column, content: Column) -> Column:
    """A chat turn as markdown."""
    who = F.when(role == "user", "**User**").otherwise("**Assistant**")
    return F.concat(F.lit("\n### "), ts, F.lit("\n"), who, F.lit(": "), stripped(content), F.lit("\n"))


def tool_entry(ts: Column, tool: Column, args: Column, result: Column) -> Column:
    """A tool call as markdown, its result cut to 200 characters."""
    return F.concat(F.lit("\n### "), ts, F.lit(" [tool]\n**Tool**: `"), tool, F.lit("("), args, F.lit(")`\n**Result**: "), F.substring(result, 1, 200), F.lit("\n"))


def note_entry(ts: Column, tag: Column, text: Column) -> Column:
    return F.concat(F.lit("\n### "), ts, F.lit(" ["), tag, F.lit("]\n"), stripped(text), F.lit("\n"))


def logs(entries: DataFrame, log: str, order: str, entry: str) -> DataFrame:
    """Entries put together by log (a day's or a conversation's, so bounded): log, text."""
    gathered = entries.groupBy(log).agg(F.array_sort(F.collect_list(F.struct(order, entry))).alias("x"))
    return gathered.select(log, F.array_join(F.col(f"x.{entry}"), "").alias("text"))


def turns_of(logs: DataFrame, log: str, text: str) -> DataFrame:
    """The chat turns of markdown logs: log, turn (its place), role, text."""
    parts = F.split(text, "\n### ")
    rows = logs.select(log, F.posexplode(parts).alias("turn", "part"))
    said = F.regexp_extract("part", r"(?s)\*\*(User|Assistant)\*\*:\s*(.*)", 2)
    who = F.regexp_extract("part", r"\*\*(User|Assistant)\*\*:", 1)
    return rows.where(who != "").select(log, "turn", F.lower(who).alias("role"), said.alias("text"))


def promoted(found: DataFrame, repo_id: str, author: str) -> dict[str, DataFrame]:
    """What extract() found, as rows of memory: decisions, attempts and preferences."""
    row = lambda name, *columns: found.where(F.col("class") == name).select("conv_id", F.lit(repo_id).alias("repo_id"), F.lit(author).alias("author"), *columns)
    cut = lambda n: F.substring("text", 1, n)
    return {
        "decisions": row("decisions", cut(100).alias("title"), F.col("text").alias("context"), F.col("text").alias("decision"), F.lit("pending").alias("outcome")),
        "attempts": row("failed", cut(100).alias("problem"), F.lit("unknown").alias("approach"), F.lit("failed").alias("result"), F.col("text").alias("failure_reason")),
        "preferences": row("preferences", F.lit("inferred").alias("preference_type"), cut(60).alias("key"), F.col("text").alias("value"), F.lit("inferred").alias("source"), F.lit(0.6).alias("confidence")),
    }


def line_array(text: Column) -> Column:
    """Lines of a text; a line feed at the end begins no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def compacted(logs: DataFrame, log: str, text: str, counts: DataFrame, least: int = THRESHOLD, keep: int = KEEP) -> DataFrame:
    """Logs of `least` line ends or more cut to their last `keep` lines behind a header with the counts (decisions, attempts, preferences).

    counts: log, decisions, attempts, preferences. Gives log, lines_before, lines_after, reduction_pct, text; other logs stay as they are.
    """
    line = line_array(F.col(text))
    n = F.size(line)
    j = logs.select(log, F.col(text).alias("_t"), line.alias("_l"), n.alias("lines_before")).join(counts, log, "left")
    over = (F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit("")))) >= least
    kept = F.when(F.size("_l") > keep, F.slice("_l", -keep, keep)).otherwise(F.col("_l"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    header = F.concat(F.lit("<!-- compacted | extracted: "), zero("decisions"), F.lit("d "), zero("attempts"), F.lit("a "), zero("preferences"), F.lit("p -->"))
    after = F.when(over, F.least(F.size("_l"), F.lit(keep)) + 1).otherwise(F.size("_l"))
    reduced = F.when(over & (F.size("_l") > 0), F.round((1 - after / F.size("_l")) * 100, 1)).otherwise(0.0)
    return j.select(log, "lines_before", after.alias("lines_after"), reduced.alias("reduction_pct"), F.when(over, F.concat_ws("\n", header, F.array_join(kept, "\n"))).otherwise(F.col("_t")).alias("text"))


def promotion_counts(turns: DataFrame) -> DataFrame:
    """conv_id and how many decisions, attempts and preferences are promoted from its turns."""
    n = lambda name: F.count_if(F.col("class") == name)
    return extract(turns).groupBy("conv_id").agg(n("decisions").alias("decisions"), n("failed").alias("attempts"), n("preferences").alias("preferences"))


def put_in_sections(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Permanent memory (section, key, line, at) with new lines, once for each key: a key that is there already, or earlier in new, is skipped."""
    order = W.partitionBy("key").orderBy("at", "section", "line")
    fresh = new.join(memory.select("key").where("key is not null").distinct(), "key", "left_anti").withColumn("_n", F.when(F.col("key").isNull(), 1).otherwise(F.row_number().over(order)))
    return memory.unionByName(fresh.where("_n = 1").drop("_n").select(*memory.columns))


def memory_text(memory: DataFrame) -> DataFrame:
    """Permanent memory as markdown: section and its text, the newest lines first."""
    g = memory.groupBy("section").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "key", "line")))).alias("x"))
    line = F.transform("x", lambda r: F.concat(F.lit("- "), F.date_format(r["at"], "yyyy-MM-dd"), F.lit(" "), stripped(r["line"]), F.when(r["key"].isNotNull(), F.concat(F.lit(" <!-- key:"), r["key"], F.lit(" -->"))).otherwise("")))
    return g.select("section", F.concat(F.col("section"), F.lit("\n\n"), F.array_join(line, "\n"), F.lit("\n")).alias("text"))


def last_lines(text: Column, n: int) -> Column:
    lines = line_array(text)
    return F.array_join(F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines), "\n")


def dates(logs: DataFrame, date: str) -> DataFrame:
    """The dates that have a log, ascending."""
    return logs.select(date).distinct().where(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$")).orderBy(date)


def entries_of(events: DataFrame) -> DataFrame:
    """Hook events (session_id, ts, type, role, tool, content) as journal entries; names are normalised, unknown types are dropped.

    Prompts and answers are turns, tool uses are tool calls, session starts and ends are notes.
    """
    kind = F.lower(F.regexp_replace("type", "[^A-Za-z]", ""))
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = reduce(
        lambda c, x: c.when(kind == x[0], x[1]),
        (("agentstop", turn_entry(ts, F.lit("assistant"), F.col("content"))), ("posttooluse", tool_entry(ts, F.coalesce("tool", F.lit("unknown")), F.lit(""), F.col("content"))), ("sessionstart", note_entry(ts, F.lit("session"), F.col("content")))),
        F.when(kind == "promptsubmit", turn_entry(ts, F.lit("user"), F.col("content"))),
    )
    return events.select("session_id", "ts", text.alias("entry")).where("entry is not null")
