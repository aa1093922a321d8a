"""Memory tables: reads, searches, writes, snapshots for prompts; tenants and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skeinwork.operators.relational import latest, list_merge


def newest(rows: DataFrame, limit: int, condition: str = "true") -> DataFrame:
    """The newest rows that meet the condition; ties by id."""
    return rows.where(condition).orderBy(F.desc("updated_at"), "id").limit(limit)


def preferences(rows: DataFrame, author: str, repo_id: str) -> DataFrame:
    """An author's preferences for a repository and for all."""
    return rows.where((F.col("author") == author) & F.col("repo_id").isin(repo_id, "")).orderBy(F.desc("updated_at"), "id")


def for_module(decisions: DataFrame, module: str, among: int = 200) -> DataFrame:
    """Decisions that name a module, among the newest ones: the limit comes first."""
    return newest(decisions, among).where(F.array_contains("affected_modules", module))


def listing(rows: DataFrame, repo_id: str = "", author: str = "", limit: int = 20) -> DataFrame:
    """The newest rows of a repository and an author; the empty text stands for all."""
    conditions = [F.col(c) == v for c, v in (("repo_id", repo_id), ("author", author)) if v]
    return newest(rows.where(reduce(Column.__and__, conditions)) if conditions else rows, limit)


def by_id(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.where(F.col("id") == row_id)


def decisions(rows: DataFrame, repo_id: str, limit: int = 50, include_reverted: bool = False) -> DataFrame:
    """A repository's newest decisions; reverted ones only if asked for."""
    return newest(rows.where(F.col("repo_id") == repo_id), limit, "true" if include_reverted else "outcome <> 'reverted'")


def attempts(rows: DataFrame, repo_id: str, result: str = "", limit: int = 50) -> DataFrame:
    some = rows.where(F.col("repo_id") == repo_id)
    return newest(some.where(F.col("result") == result) if result else some, limit)


def conventions(rows: DataFrame, repo_id: str, active_only: bool = True) -> DataFrame:
    """All of a repository's conventions, the newest first."""
    some = rows.where(F.col("repo_id") == repo_id)
    return (some.where("status = 'active'") if active_only else some).orderBy(F.desc("updated_at"), "id")


def remembered(old: DataFrame, new: DataFrame, me: str, team: bool = False) -> DataFrame:
    """old with new rows put in by id; rows without an author are `me`'s, rows of team tables wait for being shared. Of new rows that repeat an id the last updated stays."""
    author = F.when(F.coalesce("author", F.lit("")) == "", me).otherwise(F.col("author"))
    rows = new.withColumn("author", author)
    rows = latest(rows.withColumn("pending_sync", F.lit(True)) if team else rows, "id", version="updated_at")
    return old.join(rows.select("id"), "id", "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))


SCOPES = {"session": "personal", "preference": "personal", "decision": "team", "attempt": "team", "convention": "team"}


def found(tables: dict[str, DataFrame], query: str, repo_id: str = "", scope: str = "", limit: int = 20) -> DataFrame:
    """Rows that hold all terms of the query, in any case: node_type, scope, id, score = min(1, 0.2 * occurrences per term), summary, updated_at.

    tables: by type, with id, repo_id, updated_at, data (the text that is searched), summary. Of each table its newest `limit` hits count, of
    these the `limit` best stay; equal scores by recency, then id.
    """
    terms = query.lower().split()
    parts = []
    for kind, t in tables.items():
        t = t.limit(0) if scope and SCOPES[kind] != scope else t
        low = F.lower("data")
        hit = reduce(Column.__and__, [low.contains(x) for x in terms], F.lit(bool(terms)))
        some = t.where(hit & (F.col("repo_id") == repo_id) if repo_id else hit)
        hits = reduce(Column.__add__, [(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / F.lit(len(x)) for x in terms], F.lit(0.0))
        score = F.round(F.least(F.lit(1.0), hits / F.lit(max(1, len(terms))) * 0.2), 6)
        parts.append(newest(some, limit).select(F.lit(kind).alias("node_type"), F.lit(SCOPES[kind]).alias("scope"), "id", score.alias("score"), "summary", "updated_at"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), F.desc("updated_at"), "node_type", "id").limit(limit)


def similar_attempts(tables: dict[str, DataFrame], query: str, result: str = "", limit: int = 10) -> DataFrame:
    """Attempts among the 3 * limit best hits of the team's tables, with that result if one is given. The attempts' table has a column result."""
    hits = found(tables, query, scope="team", limit=3 * limit).where("node_type = 'attempt'")
    rows = hits.join(tables["attempt"].select("id", "result"), "id")
    return (rows.where(F.col("result") == result) if result else rows).orderBy(F.desc("score"), F.desc("updated_at"), "id").limit(limit)


def context_block(decisions: DataFrame, attempts: DataFrame, preferences: DataFrame, log: str, repo_id: str, author: str) -> DataFrame:
    """One row for a prompt: 5 decisions, 3 failed attempts, an author's preferences and a log's end as markdown (block; empty if there is nothing), and their numbers.

    What is gathered are top-k lists and one author's preferences.
    """
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    d = globals()["decisions"](decisions, repo_id, 5).select("updated_at", "id", F.concat(F.lit("- ["), F.upper("outcome"), F.lit("] "), "title", F.lit(" — "), cut("decision", 100)).alias("line"))
    reason = F.when(F.col("failure_reason") != "", F.concat(F.lit("\n  Failed because: "), cut("failure_reason", 100))).otherwise("")
    lesson = F.when(F.col("lessons_learned") != "", F.concat(F.lit("\n  Lesson: "), cut("lessons_learned", 100))).otherwise("")
    a = globals()["attempts"](attempts, repo_id, "failed", 3).select("updated_at", "id", F.concat(F.lit("- Problem: "), cut("problem", 80), reason, lesson).alias("line"))
    p = globals()["preferences"](preferences, author, repo_id).select("updated_at", "id", F.concat("key", F.lit(": "), "value").alias("line")).withColumn("line", F.concat(F.lit("- "), "line"))
    lists = [x.agg(F.sort_array(F.collect_list(F.struct("updated_at", "id", "line")), asc=False).alias(name)) for name, x in (("d", d), ("a", a), ("p", p))]
    # the newest first, equal ones by id
    ordered = lambda c: F.transform(F.array_sort(c, lambda x, y: F.when(x["updated_at"] > y["updated_at"], -1).when(x["updated_at"] < y["updated_at"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)), lambda x: x["line"])
    one = lists[0].join(F.broadcast(lists[1])).join(F.broadcast(lists[2]))  # a row each
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"**{title}:**\n"), F.array_join(ordered(c), "\n"), F.lit("\n")))
    tail = log[-2000:] if log.strip() else ""
    end = F.lit(f"**Recent Session Activity (last 40 lines):**\n```\n{tail}\n```" if tail else None)
    body = F.concat_ws("\n", part("Recent Architectural Decisions", F.col("d")), part("Known Failed Approaches (don't repeat)", F.col("a")), part("User Preferences", F.col("p")), end)
    block = F.when(body == "", "").otherwise(F.concat(F.lit(f"<!-- Memory Context | repo={repo_id} -->\n\n"), body))
    return one.select(F.size("d").alias("decisions"), F.size("a").alias("failures"), F.size("p").alias("preferences"), block.alias("block"))


def cold_rows(rows: DataFrame) -> DataFrame:
    """Rows for the shared store: without columns that begin with an underscore, with the SHA-1 of their content (canonical JSON: keys sorted, nulls kept)."""
    names = sorted(c for c in rows.columns if not c.startswith("_"))
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    canonical = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{c}": '), text(c)) for c in names)), F.lit("}"))
    return rows.select(*names, F.sha1(canonical).alias("content_hash"))


def synced(mine: DataFrame, theirs: DataFrame, kind: str) -> DataFrame:
    """My rows after a pull: attempts are only added, conventions are taken as they come, of decisions the later version's scalars and both's lists stay.

    Of their rows that repeat an id the last updated counts.
    """
    theirs = latest(theirs.select(*mine.columns), "id", version="updated_at")
    if kind == "attempt":
        return mine.unionByName(theirs.join(mine.select("id"), "id", "left_anti").select(*mine.columns))
    if kind == "convention":
        return mine.join(theirs.select("id"), "id", "left_anti").select(*mine.columns).unionByName(theirs.select(*mine.columns))
    return list_merge(mine, theirs.select(*mine.columns), "id", [c for c, t in mine.dtypes if t.startswith("array")], "updated_at")


def steering(decisions: DataFrame, attempts: DataFrame, preferences: DataFrame, memory_text: str, repo_id: str, author: str) -> DataFrame:
    """One row: a document that tells an agent what is remembered of a repository, with the first 40 lines of its permanent memory."""
    none = "_(none yet)_"
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    d = globals()["decisions"](decisions, repo_id, 5).select("updated_at", "id", F.concat(F.lit("- ["), F.upper("outcome"), F.lit("] "), "title", F.lit(": "), cut("decision", 100)).alias("line"))
    a = globals()["attempts"](attempts, repo_id, "failed", 3).select("updated_at", "id", F.concat(F.lit("- "), cut("problem", 80), F.lit(" → failed because: "), cut("failure_reason", 80)).alias("line"))
    p = globals()["preferences"](preferences, author, repo_id).select("updated_at", "id", F.concat(F.lit("- "), "key", F.lit(": "), "value").alias("line"))
    newest_first = F.transform(F.array_sort("x", lambda u, v: F.when(u["updated_at"] > v["updated_at"], -1).when(u["updated_at"] < v["updated_at"], 1).when(u["id"] < v["id"], -1).when(u["id"] > v["id"], 1).otherwise(0)), lambda u: u["line"])
    blocks = [x.agg(F.collect_list(F.struct("updated_at", "id", "line")).alias("x")).select(F.when(F.size("x") > 0, F.array_join(newest_first, "\n")).otherwise(none).alias(name)) for name, x in (("d", d), ("a", a), ("p", p))]
    one = blocks[0].join(F.broadcast(blocks[1])).join(F.broadcast(blocks[2]))  # a row each
    excerpt = "\n".join(memory_text.split("\n")[:40])
    parts = [F.lit(f"# Memory of {repo_id}\n"), F.lit("## Decisions\n"), F.concat("d", F.lit("\n")), F.lit("## Failed approaches\n"), F.concat("a", F.lit("\n")), F.lit("## Preferences\n"), F.concat("p", F.lit("\n")), F.lit(f"## Permanent memory\n\n{excerpt}\n")]
    return one.select(F.concat_ws("\n", *parts).alias("text"))


def cache_key(kind: Column, *parts: Column) -> Column:
    """The key under which a cache holds a row: its kind and what names it."""
    return F.concat_ws(":", kind, *parts)


def query_key(namespace: Column, query: Column, repo_id: Column) -> Column:
    """The key under which a cache holds a query's result."""
    return F.concat_ws(":", F.lit("query"), namespace, F.substring(F.sha1(F.concat_ws(":", namespace, query, repo_id)), 1, 12))


def as_fact(decision: Column, rationale: Column) -> Column:
    """A decision with its rationale as one text of 400 characters at most."""
    return F.substring(F.when(rationale != "", F.concat(decision, F.lit(" — "), rationale)).otherwise(decision), 1, 400)


def action_episodes(actions: DataFrame) -> DataFrame:
    """Actions (repo_id, ts, action, files array, outcome) as episodes: session, summary, outcome and transcript."""
    files = F.when(F.size("files") > 0, F.array_join("files", ", ")).otherwise("none")
    transcript = F.concat(F.lit("Agent: "), "action", F.lit("\nFiles: "), files, F.lit("\nOutcome: "), "outcome")
    return actions.select(F.concat(F.lit("agent:"), "repo_id", F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), "repo_id", F.substring("action", 1, 200).alias("summary"), "outcome", transcript.alias("transcript"), F.lit("agent_action").alias("source"))


def prompt_context(question: str, facts: DataFrame, episodes: DataFrame, most: int = 12_000) -> DataFrame:
    """One row: the first 20 facts (seq, attr, val, loc) and 8 episodes (seq, label, source, snippet) as one text of `most` characters."""
    gathered = lambda df, n, line, name: df.orderBy("seq").limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias(name))
    place = F.when(F.coalesce("loc", F.lit("")) != "", F.concat(F.lit(" ["), "loc", F.lit("]"))).otherwise("")
    f = gathered(facts, 20, F.concat(F.lit("  - "), "attr", F.lit(": "), F.substring("val", 1, 200), place), "f")
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n"), F.substring("snippet", 1, 600))).otherwise("")
    e = gathered(episodes, 8, F.concat(F.lit("\n--- "), "label", F.lit(" ("), "source", F.lit(") ---"), snippet), "e")
    one = f.join(F.broadcast(e))  # a row each
    parts = [F.lit(f"CODEBASE CONTEXT FOR: {question}\n"), F.when(F.col("f") != "", F.concat(F.lit("CODE SYMBOLS AND FACTS:\n"), "f", F.lit("\n"))), F.when(F.col("e") != "", F.concat(F.lit("RELEVANT CODE FILES / PAST ACTIONS:\n"), "e"))]
    return one.select(F.substring(F.concat_ws("\n", *parts), 1, most).alias("context_str"))


def scoped(rows: DataFrame, user: str, column: str) -> DataFrame:
    """rows with scoped_id: the column's value behind its user's."""
    return rows.withColumn("scoped_id", F.concat_ws(":", user, column))


def unscoped(scoped_id: Column, user: Column) -> Column:
    """What is shown to a user: an id without the user's prefix; ids of others give null."""
    return F.when(scoped_id.startswith(F.concat(user, F.lit(":"))), F.substring(scoped_id, F.length(user) + 2, F.length(scoped_id)))


def allowed_calls(calls: DataFrame, keys: DataFrame, limits: DataFrame, order: list) -> DataFrame:
    """Every call (key, period) with allowed: whether it's among the first of its user's tier in the period. Calls with an unknown key are denied.

    keys: key, user, tier. limits: tier, most.
    """
    known = calls.join(keys, "key", "left").join(F.broadcast(limits), "tier", "left")  # a row for each tier
    place = F.row_number().over(W.partitionBy("user", "period").orderBy(*order))
    return known.withColumn("allowed", F.coalesce((place <= F.col("most")) & F.col("user").isNotNull(), F.lit(False)))


def submitted(requests: DataFrame, owned: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Jobs for requests (job_id, user, url, seq), and the messages that start them. owned: user, n (repositories that the user has).

    A request is rejected for a bad address, or if its user would have more than `most` repositories.
    """
    w = W.partitionBy("user", "_ok").orderBy("seq", "job_id")
    rows = requests.withColumn("_ok", valid_url(F.col("url"))).withColumn("_n", F.row_number().over(w)).join(owned, "user", "left")
    fits = F.col("_ok") & (F.coalesce("n", F.lit(0)) + F.col("_n") <= most)
    status = F.when(fits, "QUEUED").when(F.col("_ok"), "REJECTED_LIMIT").otherwise("REJECTED_URL")
    jobs = rows.select("job_id", "user", "url", status.alias("status"), F.lit(0).alias("progress"))
    return jobs, jobs.where("status = 'QUEUED'").select("job_id", "user", "url")


def job_of(jobs: DataFrame, job_id, user: str) -> DataFrame:
    """A job as its owner sees it; nothing for others."""
    return jobs.where((F.col("job_id") == job_id) & (F.col("user") == user))


def within_rate(calls: DataFrame, user: str, period: str, order: list, most: int) -> DataFrame:
    """Every call with allowed: whether it's among the user's first `most` of the period."""
    return calls.withColumn("allowed", F.row_number().over(W.partitionBy(user, period).orderBy(*order)) <= most)


def pending(rows: DataFrame) -> DataFrame:
    """Rows that wait for being shared."""
    return rows.where("pending_sync")


def mark_synced(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows with pending_sync cleared where their id is in done (id)."""
    d = done.select("id", F.lit(True).alias("_done")).distinct()
    return rows.join(d, "id", "left").withColumn("pending_sync", F.col("pending_sync") & F.col("_done").isNull()).drop("_done").select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose keys is in gone (its first column): a deletion with what hangs on it. Null keys stay."""
    name = gone.columns[0]
    for k in keys:
        rows = rows.join(gone.select(F.col(name).alias("_gone")), F.col(k) == F.col("_gone"), "left_anti")
    return rows


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows left to do after a restart."""
    return rows.join(done.select(key), key, "left_anti")


def summary(kind: Column, row: Column) -> Column:
    """One line for a memory row by its kind. row: a struct of summary, problem, title, result, key, value."""
    text = lambda c: F.coalesce(row[c], F.lit(""))
    session = F.when(text("summary") != "", text("summary")).otherwise(F.substring(text("problem"), 1, 120))
    attempt = F.concat(F.substring(text("problem"), 1, 80), F.lit(" → "), text("result"))
    return F.when(kind == "session", session).when(kind.isin("decision", "convention"), text("title")).when(kind == "attempt", attempt).when(kind == "preference", F.concat(text("key"), F.lit(" = "), text("value"))).otherwise("")


def valid_url(url: Column) -> Column:
    """Whether a repository's address is accepted."""
    return F.coalesce(url.rlike(r"^https://github\.com/[^/\s]+/[^/\s]+/?$"), F.lit(False))
