"""Queries over the memory tables, journals, searches and hosted services."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import analysis, journal, memory, search
from skeinwork.plans.catalogue import _EPISODES, _FOUND, ROOT
from skeinwork.plans.registry import query
from skeinwork.sources import tables
from skeinwork.sources.stored import graph
from skeinwork.sources.tables import table

# -- listings


@query("SELECT id, title, updated_at FROM m_decisions WHERE repo_id = 'r1' AND outcome <> 'reverted' ORDER BY updated_at DESC, id LIMIT 50", views="memory")
def memory_decisions(spark, d):
    return memory.decisions(tables.decisions(spark, d), "r1").select("id", "title", "updated_at")


@query("SELECT id, turns, updated_at FROM m_sessions WHERE repo_id = 'r2' AND author = 'u1' ORDER BY updated_at DESC, id LIMIT 20", views="memory")
def memory_sessions(spark, d):
    return memory.listing(tables.sessions(spark, d), "r2", "u1").select("id", "turns", "updated_at")


@query("SELECT id, result FROM m_attempts WHERE repo_id = 'r1' AND result = 'failed' ORDER BY updated_at DESC, id LIMIT 50", views="memory")
def attempts_by_result(spark, d):
    return memory.attempts(tables.attempts(spark, d), "r1", "failed").select("id", "result")


@query("SELECT id, title, status FROM m_conventions WHERE repo_id = 'r3' AND status = 'active'", views="memory")
def active_conventions(spark, d):
    return memory.conventions(tables.conventions(spark, d), "r3").select("id", "title", "status")


@query(f"SELECT id, title, decision FROM m_decisions WHERE id = 'd{ROOT}'", views="memory")
def memory_by_id(spark, d):
    return memory.by_id(tables.decisions(spark, d), f"d{ROOT}").select("id", "title", "decision")


@query("SELECT row_number() OVER (ORDER BY updated_at DESC, id) AS place, id, key, value FROM m_preferences WHERE author = 'u1' AND repo_id IN ('r2', '')", views="memory")
def preferences_of_author(spark, d):
    from pyspark.sql import Window as W

    p = memory.preferences(tables.preferences(spark, d), "u1", "r2")
    return p.select(F.row_number().over(W.orderBy(F.desc("updated_at"), "id")).cast("long").alias("place"), "id", "key", "value")


@query("SELECT id FROM (SELECT * FROM m_decisions ORDER BY updated_at DESC, id LIMIT 200) WHERE list_contains(affected_modules, 'm3')", views="memory")
def decisions_for_module(spark, d):
    return memory.for_module(tables.decisions(spark, d), "m3").select("id")


@query("SELECT 'decision' AS name, count(*) AS n FROM m_decisions UNION ALL SELECT 'attempt', count(*) FROM m_attempts UNION ALL SELECT 'preference', count(*) FROM m_preferences UNION ALL SELECT 'convention', count(*) FROM m_conventions UNION ALL SELECT 'session', count(*) FROM m_sessions", views="memory")
def memory_stats(spark, d):
    from functools import reduce

    parts = (("decision", tables.decisions), ("attempt", tables.attempts), ("preference", tables.preferences), ("convention", tables.conventions), ("session", tables.sessions))
    return reduce(lambda a, b: a.union(b), [t(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in parts])


@query("SELECT * FROM (SELECT 'decision:' || id AS cache_key FROM m_decisions WHERE repo_id = 'r1' AND outcome <> 'reverted' ORDER BY updated_at DESC, id LIMIT 50) UNION ALL SELECT * FROM (SELECT 'attempt:' || id FROM m_attempts WHERE repo_id = 'r1' ORDER BY updated_at DESC, id LIMIT 50) UNION ALL SELECT 'pref:' || author || ':' || key FROM m_preferences WHERE author = 'u1' AND repo_id IN ('r1', '')", views="memory")
def cache_warmup(spark, d):
    """The keys of what a cache holds at first."""
    a = memory.decisions(tables.decisions(spark, d), "r1", 50).select(F.concat_ws(":", F.lit("decision"), "id").alias("cache_key"))
    b = memory.attempts(tables.attempts(spark, d), "r1", limit=50).select(F.concat_ws(":", F.lit("attempt"), "id"))
    c = memory.preferences(tables.preferences(spark, d), "u1", "r1").select(F.concat_ws(":", F.lit("pref"), "author", "key"))
    return a.union(b).union(c)


# -- search

_DATA = {
    "session": ("m_sessions", "concat_ws(' ', id, problem_statement, summary)", "CASE WHEN summary <> '' THEN summary ELSE problem_statement[1:120] END"),
    "preference": ("m_preferences", "concat_ws(' ', id, key, value)", "key || ' = ' || value"),
    "decision": ("m_decisions", "concat_ws(' ', id, title, decision, outcome)", "title"),
    "attempt": ("m_attempts", "concat_ws(' ', id, problem, approach, result, failure_reason)", "problem[1:80] || ' → ' || result"),
    "convention": ("m_conventions", "concat_ws(' ', id, title, status)", "title"),
}


def _tables(spark, d):
    sources = {"session": tables.sessions, "preference": tables.preferences, "decision": tables.decisions, "attempt": tables.attempts, "convention": tables.conventions}
    summary = {k: F.expr(v[2].replace("problem_statement[1:120]", "substring(problem_statement, 1, 120)").replace("problem[1:80]", "substring(problem, 1, 80)")) if "||" in v[2] or "CASE" in v[2] else F.col(v[2]) for k, v in _DATA.items()}
    return {k: t(spark, d).withColumns({"data": F.expr(_DATA[k][1]), "summary": summary[k]}) for k, t in sources.items()}


def _hits(terms, limit, repo="", kinds=tuple(_DATA), order=("session", "preference", "decision", "attempt", "convention")):
    score = " + ".join(f"(length(lower(data)) - length(replace(lower(data), '{t}', ''))) / {len(t)}" for t in terms)
    where = " AND ".join([*(f"contains(lower(data), '{t}')" for t in terms), *([f"repo_id = '{repo}'"] if repo else [])])
    parts = [f"SELECT * FROM (SELECT '{k}' AS node_type, '{memory.SCOPES[k]}' AS scope, id, round(least(1.0::DOUBLE, ({score}) / {len(terms)} * 0.2::DOUBLE), 6) AS score, s AS summary, updated_at FROM (SELECT *, {_DATA[k][1]} AS data, {_DATA[k][2]} AS s FROM {_DATA[k][0]}) WHERE {where} ORDER BY updated_at DESC, id LIMIT {limit})" for k in order if k in kinds]
    return " UNION ALL ".join(parts) + f" ORDER BY score DESC, updated_at DESC, node_type, id LIMIT {limit}"


@query(_hits(["order", "urgent"], 20), views="memory")
def memory_search(spark, d):
    return memory.found(_tables(spark, d), "Order urgent")


@query(_hits(["error"], 20, "r1", ("decision", "attempt", "convention")), views="memory")
def memory_search_team(spark, d):
    return memory.found(_tables(spark, d), "ERROR", "r1", "team")


@query(_hits(["part_7"], 10), views="memory")
def symbol_history(spark, d):
    """What is remembered of a symbol."""
    return memory.found(_tables(spark, d), "part_7", limit=10)


@query(f"SELECT h.*, a.result FROM ({_hits(['part_1'], 30, kinds=('decision', 'attempt', 'convention'))}) h JOIN m_attempts a ON a.id = h.id WHERE node_type = 'attempt' AND a.result = 'partial' ORDER BY score DESC, h.updated_at DESC, h.id LIMIT 10", views="memory")
def similar_attempts(spark, d):
    return memory.similar_attempts(_tables(spark, d), "part_1", "partial")


_WORDS = "(contains(lower(name), 'blue') OR contains(lower(coalesce(docstring, '')), 'blue') OR contains(lower(name), 'bolt') OR contains(lower(coalesce(docstring, '')), 'bolt'))"
_FACTS = f"SELECT name AS attr, coalesce(docstring, signature, kind) AS val, kind AS ftype, filepath AS sdate, 1.0::DOUBLE AS score FROM g_nodes WHERE repo_id = 'r1' AND {_WORDS} {{kinds}} ORDER BY id LIMIT {{k}}"


@query(_FACTS.format(kinds="AND kind IN ('class', 'function')", k=10))
def code_symbol_search(spark, d):
    return search.code_facts(graph(spark, d).nodes, "a blue bolt is", "r1", 10, ("class", "function"))


@query(_EPISODES + f""", f AS (SELECT row_number() OVER (ORDER BY id) AS seq, id, name AS attr, coalesce(docstring, signature, kind) AS val, filepath AS loc FROM (SELECT * FROM g_nodes WHERE repo_id = 'r1' AND {_WORDS} ORDER BY id LIMIT 15)),
e AS (SELECT filepath AS label, 'index' AS source, transcript[1:400] AS snippet, row_number() OVER (ORDER BY filepath) AS seq FROM t WHERE repo_id = 'r1' AND length(transcript) >= 50 AND contains(lower(transcript), 'blue')),
fs AS (SELECT string_agg('  - ' || attr || ': ' || val[1:200] || ' [' || loc || ']', chr(10) ORDER BY seq) AS x FROM f WHERE seq <= 20), es AS (SELECT string_agg(chr(10) || '--- ' || label || ' (' || source || ') ---' || chr(10) || snippet[1:600], chr(10) ORDER BY seq) AS x FROM e WHERE seq <= 8)
SELECT (concat_ws(chr(10), 'CODEBASE CONTEXT FOR: a blue bolt is' || chr(10), 'CODE SYMBOLS AND FACTS:' || chr(10) || fs.x || chr(10), 'RELEVANT CODE FILES / PAST ACTIONS:' || chr(10) || es.x))[1:12000] AS context_str FROM fs, es""")
def unified_query(spark, d):
    """Facts and files that a question is about, as one text."""
    from pyspark.sql import Window as W

    from skeinwork.operators import bridge

    n = graph(spark, d).nodes
    some = search.code_facts(n, "a blue bolt is", "r1", 15)
    order = W.orderBy("ftype", "attr")  # over 15 rows
    ids = n.where("repo_id = 'r1'").select(F.col("name").alias("attr"), "id")
    facts = some.join(ids, "attr").withColumn("seq", F.row_number().over(W.orderBy("id"))).select("seq", "attr", "val", F.col("sdate").alias("loc"))
    files = bridge.episodes(n, tables.descriptions(spark, d)).where("repo_id = 'r1' and contains(lower(transcript), 'blue')").orderBy("filepath").limit(8)
    episodes = files.select(F.row_number().over(W.orderBy("filepath")).alias("seq"), F.col("filepath").alias("label"), F.lit("index").alias("source"), F.substring("transcript", 1, 400).alias("snippet"))
    del order
    return memory.prompt_context("a blue bolt is", facts, episodes)


_BLOCK = """+ d5 AS (SELECT * FROM m_decisions WHERE repo_id = 'r1' AND outcome <> 'reverted' ORDER BY updated_at DESC, id LIMIT 5), a3 AS (SELECT * FROM m_attempts WHERE repo_id = 'r1' AND result = 'failed' ORDER BY updated_at DESC, id LIMIT 3),
p AS (SELECT * FROM m_preferences WHERE author = 'u1' AND repo_id IN ('r1', '')),
x AS (SELECT (SELECT count(*) FROM d5) AS decisions, (SELECT count(*) FROM a3) AS failures, (SELECT count(*) FROM p) AS preferences,
(SELECT '**Recent Architectural Decisions:**' || chr(10) || string_agg('- [' || upper(outcome) || '] ' || title || ' — ' || decision[1:100], chr(10) ORDER BY updated_at DESC, id) || chr(10) FROM d5) AS d,
(SELECT '**Known Failed Approaches (don''t repeat):**' || chr(10) || string_agg('- Problem: ' || problem[1:80] || CASE WHEN failure_reason <> '' THEN chr(10) || '  Failed because: ' || failure_reason[1:100] ELSE '' END || CASE WHEN lessons_learned <> '' THEN chr(10) || '  Lesson: ' || lessons_learned[1:100] ELSE '' END, chr(10) ORDER BY updated_at DESC, id) || chr(10) FROM a3) AS a,
(SELECT '**User Preferences:**' || chr(10) || string_agg('- ' || key || ': ' || value, chr(10) ORDER BY updated_at DESC, id) || chr(10) FROM p) AS q)
SELECT CAST(decisions AS INTEGER) AS decisions, CAST(failures AS INTEGER) AS failures, CAST(preferences AS INTEGER) AS preferences, '<!-- Memory Context | repo=r1 -->' || chr(10) || chr(10) || concat_ws(chr(10), d, a, q, '**Recent Session Activity (last 40 lines):**' || chr(10) || '```' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || '```') AS block FROM x"""


@query(_BLOCK, views="memory")
def memory_context(spark, d):
    return memory.context_block(tables.decisions(spark, d), tables.attempts(spark, d), tables.preferences(spark, d), "one\ntwo", "r1", "u1")


# -- writes


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'd' || o_orderkey ELSE 'd' || o_orderkey END AS id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'me' ELSE 'u' || (o_custkey % 5) END ELSE 'u' || (o_custkey % 5) END AS author, o_orderkey % 2 = 0 OR o_orderstatus = 'O' AS pending_sync FROM orders", views=False)
def remembered_decisions(spark, d):
    """Every second decision is saved again, some without an author."""
    old = tables.decisions(spark, d).select("id", "author", "pending_sync")
    new = table(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr("concat('d', o_orderkey) AS id", "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('u', o_custkey % 5) END AS author")
    return memory.remembered(old, new, "me", team=True)


@query("SELECT id, author FROM m_decisions WHERE pending_sync AND id NOT IN (SELECT 'd' || o_orderkey FROM orders WHERE o_custkey % 2 = 0)", views="memory")
def pending_after_sync(spark, d):
    done = table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.concat(F.lit("d"), "o_orderkey").alias("id"))
    return memory.pending(memory.mark_synced(tables.decisions(spark, d), done)).select("id", "author")


@query("""SELECT id, sha1('{"id": "' || id || '", "title": "' || title || '", "updated": null}') AS content_hash FROM m_conventions""", views="memory")
def cold_store_rows(spark, d):
    c = tables.conventions(spark, d).select("title", "id", F.lit(None).cast("string").alias("updated"), F.lit("x").alias("_synced"))
    return memory.cold_rows(c).select("id", "content_hash")


@query("SELECT 'agent:' || repo_id || ':' || strftime(updated_at, '%Y-%m-%d') AS session_id, problem[1:200] AS summary, 'Agent: ' || problem || chr(10) || 'Files: ' || CASE WHEN lessons_learned <> '' THEN 'a.py, b.py' ELSE 'none' END || chr(10) || 'Outcome: ' || result AS transcript, (approach || CASE WHEN failure_reason <> '' THEN ' — ' || failure_reason ELSE '' END)[1:400] AS fact FROM m_attempts", views="memory")
def recorded_actions(spark, d):
    a = tables.attempts(spark, d)
    files = F.when(F.col("lessons_learned") != "", F.array(F.lit("a.py"), F.lit("b.py"))).otherwise(F.array().cast("array<string>"))
    rows = a.select("repo_id", F.col("updated_at").alias("ts"), F.col("problem").alias("action"), files.alias("files"), F.col("result").alias("outcome"), memory.as_fact(F.col("approach"), F.col("failure_reason")).alias("fact"), "id")
    done = memory.action_episodes(rows.withColumn("action", F.concat_ws("\x00", "action", "fact")))
    parts = F.split("transcript", "\x00")
    fact = F.regexp_extract(parts[1], "(?s)^(.*?)\nFiles: ", 1)
    return done.select("session_id", F.element_at(F.split("summary", "\x00"), 1).alias("summary"), F.concat(parts[0], F.regexp_extract(parts[1], "(?s)(\nFiles: .*)$", 1)).alias("transcript"), fact.alias("fact"))


# -- journals

_ENTRY = "chr(10) || '### T' || lpad(CAST(turn AS VARCHAR), 4, '0') || chr(10) || CASE WHEN role = 'user' THEN '**User**' ELSE '**Assistant**' END || ': ' || trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) || chr(10)"
_LOGS = f"SELECT conv_id, string_agg({_ENTRY}, '' ORDER BY turn, {_ENTRY}) AS text FROM conversations GROUP BY conv_id"


def _logs(spark, d):
    ts = F.concat(F.lit("T"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    entries = table(spark, d, "conversations").select("conv_id", "turn", journal.turn_entry(ts, F.col("role"), F.col("text")).alias("entry"))
    return journal.logs(entries, "conv_id", "turn", "entry")


@query(f"SELECT conv_id, md5(text) AS text_md5, length(text) AS n FROM ({_LOGS})", views=False)
def journal_logs(spark, d):
    return _logs(spark, d).select("conv_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


@query(_FOUND + " SELECT conv_id, CAST(count_if(class = 'decisions') AS BIGINT) AS decisions, CAST(count_if(class = 'failed') AS BIGINT) AS attempts, CAST(count_if(class = 'preferences') AS BIGINT) AS preferences FROM x GROUP BY conv_id", views=False)
def promotion_counts(spark, d):
    return journal.promotion_counts(tables.turns(spark, d))


@query(_FOUND + " SELECT conv_id, 'u1' AS author, text[1:100] AS title, text AS decision, 'pending' AS outcome FROM x WHERE class = 'decisions'", views=False)
def promoted_decisions(spark, d):
    return journal.promoted(analysis.extract(tables.turns(spark, d)), "r1", "u1")["decisions"].select("conv_id", "author", "title", "decision", "outcome")


@query(_FOUND + f""", logs AS ({_LOGS}), n AS (SELECT conv_id, count_if(class = 'decisions') AS dd, count_if(class = 'failed') AS aa, count_if(class = 'preferences') AS pp FROM x GROUP BY conv_id),
l AS (SELECT conv_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l, len(text) - len(replace(text, chr(10), '')) >= 8 AS over FROM logs), k AS (SELECT *, len(l) AS before, CASE WHEN over THEN least(len(l), 6) + 1 ELSE len(l) END AS after FROM l)
SELECT conv_id, CAST(before AS INTEGER) AS lines_before, CAST(after AS INTEGER) AS lines_after, CASE WHEN over THEN round((1 - after / before) * 100, 1) ELSE 0.0 END AS reduction_pct,
md5(CASE WHEN over THEN '<!-- compacted | extracted: ' || coalesce(dd, 0) || 'd ' || coalesce(aa, 0) || 'a ' || coalesce(pp, 0) || 'p -->' || chr(10) || array_to_string(CASE WHEN before > 6 THEN l[-6:] ELSE l END, chr(10)) ELSE text END) AS text_md5 FROM k LEFT JOIN n USING (conv_id)""", views=False)  # fmt: skip
def journal_compaction(spark, d):
    """Logs of eight line ends or more are cut to six lines (small numbers, as these logs are short)."""
    c = journal.compacted(_logs(spark, d), "conv_id", "text", journal.promotion_counts(tables.turns(spark, d)), least=8, keep=6)
    return c.select("conv_id", "lines_before", "lines_after", "reduction_pct", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2", views=False)
def journal_compact_tail(spark, d):
    return analysis.tail(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2)


@query("""WITH old AS (SELECT '## Decisions' AS section, c_name AS key, c_mktsegment AS line, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 1000 AS INT)) AS at FROM customer WHERE c_custkey % 3 = 0),
new AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN '## Decisions' ELSE '## Failed Approaches' END AS section, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS key, lower(c_mktsegment) AS line, TIMESTAMP '2025-01-01' + to_days(CAST(c_custkey % 1000 AS INT)) AS at FROM customer)
SELECT section, key, line FROM old UNION ALL SELECT section, key, line FROM new WHERE key IS NULL OR key NOT IN (SELECT key FROM old)""", views=False)  # fmt: skip
def permanent_sections(spark, d):
    c = table(spark, d, "customer")
    day = lambda t: F.expr(f"timestamp_ntz'{t}' + make_dt_interval(CAST(c_custkey % 1000 AS INT))")
    old = c.where("c_custkey % 3 = 0").select(F.lit("## Decisions").alias("section"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("line"), day("2024-01-01").alias("at"))
    new = c.select(F.when(F.col("c_custkey") % 2 == 0, "## Decisions").otherwise("## Failed Approaches").alias("section"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("key"), F.lower("c_mktsegment").alias("line"), day("2025-01-01").alias("at"))
    return journal.put_in_sections(old, new).select("section", "key", "line")


# -- searches

_Q = [round(((i * 37) % 64 - 32) / 64, 4) for i in range(64)]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@query(f"SELECT id AS node_id, name, kind, filepath, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 5) AS score FROM embeddings JOIN g_nodes ON key = vec_id WHERE repo_id = 'r1' AND kind IN ('class', 'function', 'method') ORDER BY score DESC, id LIMIT 10")
def semantic_symbols(spark, d):
    return search.semantic(graph(spark, d).nodes, _vectors(spark, d), _Q, 10, "r1", ("class", "function", "method"))


_LIKE = "SELECT id AS node_id, name, kind, filepath, 1.0::DOUBLE AS score FROM g_nodes WHERE (contains(name, 'part_1') OR contains(filepath, 'part_1')) AND repo_id = 'r1' ORDER BY id LIMIT 10"


@query(f"SELECT *, least(1.0::DOUBLE, count(*) OVER () / 10.0::DOUBLE) AS confidence FROM ({_LIKE})")
def search_symbols(spark, d):
    return search.search(graph(spark, d).nodes, None, "part_1", "r1", "semantic")


@query("SELECT id, name, kind, coalesce(docstring, source_text[1:200]) AS snippet, 0.5::DOUBLE AS score FROM g_nodes WHERE (contains(name, 'bolt') OR contains(coalesce(docstring, ''), 'bolt') OR contains(source_text, 'bolt')) AND repo_id = 'r2' ORDER BY id LIMIT 20")
def source_search(spark, d):
    return search.source_search(graph(spark, d).nodes, "bolt", "r2")


@query("SELECT key, id FROM g_nodes WHERE contains(lower(coalesce(docstring, name)), 'blue')")
def free_text_nodes(spark, d):
    return search.free_text(graph(spark, d).nodes, "BLUE", "docstring", "name").select("key", "id")


@query("SELECT src, dst, relation FROM g_edges WHERE src IN (SELECT key FROM g_nodes WHERE repo_id <> 'r3') AND dst IN (SELECT key FROM g_nodes WHERE repo_id <> 'r3')")
def visible_edges(spark, d):
    return search.visible(graph(spark, d).nodes, graph(spark, d).outgoing, ("r3",))[1].select("src", "dst", "relation")


@query("SELECT event_type || ' ' || user_id AS query, ts, event_id AS results FROM events ORDER BY ts DESC, 1, 3 LIMIT 50", views=False)
def search_history(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(" ", "event_type", "user_id").alias("query"), "ts", F.col("event_id").alias("results"))
    half = F.col("results") % 2 == 0
    return search.with_history(e.where(half), e.where(~half))


# -- contexts

_RESULTS = """WITH r AS (SELECT source, doc_id % 3 AS result, doc_id AS seq, CASE WHEN doc_id % 10 = 0 THEN '' ELSE lang || (doc_id % 40) END AS node_id, text, len(string_split(text, ' ')) AS tokens, (doc_id % 4) / 4.0 AS confidence,
CASE WHEN doc_id % 3 = 0 THEN (doc_id % 97) / 97.0 END AS semantic_similarity, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 89) / 89.0 END AS score, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 13) / 13.0 END AS impact_score FROM documents),
m AS (SELECT * FROM r WHERE node_id = '' UNION ALL (SELECT * FROM r WHERE node_id <> '' QUALIFY row_number() OVER (PARTITION BY source, node_id ORDER BY result, seq) = 1)),
k AS (SELECT *, 0.6::DOUBLE * coalesce(semantic_similarity, score, 0.5::DOUBLE) + 0.4::DOUBLE * coalesce(impact_score, 0.5::DOUBLE) AS rank_score FROM m),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY rank_score DESC, result, seq ROWS UNBOUNDED PRECEDING) AS running FROM k),
s AS (SELECT source, count(*) AS n, string_agg(text, chr(10) ORDER BY rank_score DESC, result, seq)[1:2000] AS summary FROM b WHERE running <= 1200 GROUP BY source)
SELECT source, confidence, n, summary FROM (SELECT source, avg(confidence) AS confidence FROM r GROUP BY source) LEFT JOIN s USING (source)"""


@query(_RESULTS, views=False)
def summarized_requests(spark, d):
    """A request for each source, its documents as contexts of three results."""
    from skeinwork.operators import context

    r = table(spark, d, "documents").selectExpr(
        "source", "doc_id % 3 AS result", "doc_id AS seq", "CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat(lang, doc_id % 40) END AS node_id", "text", "size(split(text, ' ')) AS tokens", "(doc_id % 4) / 4.0D AS confidence",
        "CASE WHEN doc_id % 3 = 0 THEN (doc_id % 97) / 97.0D END AS semantic_similarity", "CASE WHEN doc_id % 2 = 0 THEN (doc_id % 89) / 89.0D END AS score", "CASE WHEN doc_id % 5 = 0 THEN (doc_id % 13) / 13.0D END AS impact_score", "CAST(NULL AS STRING) AS filepath", "CAST(NULL AS STRING) AS source_text",
    )
    return context.summarized(r, "source", 2000).select("source", "confidence", "n", "summary")


_TASKS = [("a", ["zz", "art_2"], "impact"), ("b", ["zz"], "impact"), ("c", ["zz"], "search"), ("d", ["part_1", ""], "trace")]


@query("""+ t AS (FROM (VALUES ('a', 'zz', 'impact'), ('a', 'art_2', 'impact'), ('b', 'zz', 'impact'), ('c', 'zz', 'search'), ('d', 'part_1', 'trace')) t(task_id, q, agent)),
k AS (SELECT DISTINCT task_id FROM t WHERE agent = 'search' OR EXISTS (SELECT 1 FROM g_nodes WHERE contains(name, q)))
SELECT task_id FROM k UNION ALL SELECT 'subtask-test-' || s FROM (VALUES ('zz'), ('part_9'), ('part_1')) v(s) WHERE s NOT IN (SELECT q FROM t JOIN k USING (task_id))""")
def plan_checked(spark, d):
    """A plan's tasks that symbols support, and searches for tested symbols that none asks for."""
    from skeinwork.operators import context

    kept = context.with_signals(context.supported(graph(spark, d).nodes, _TASKS), ["zz", "part_9", "part_1"])
    return spark.createDataFrame([(t,) for t, _, _ in kept], "task_id string")


_STEER = _BLOCK.split("x AS (")[0].rstrip().rstrip(",")


@query(_STEER + """ SELECT '# Memory of r1' || chr(10) || chr(10) || '## Decisions' || chr(10) || chr(10) || (SELECT coalesce(string_agg('- [' || upper(outcome) || '] ' || title || ': ' || decision[1:100], chr(10) ORDER BY updated_at DESC, id), '_(none yet)_') FROM d5) || chr(10) || chr(10) || '## Failed approaches' || chr(10) || chr(10)
|| (SELECT coalesce(string_agg('- ' || problem[1:80] || ' → failed because: ' || failure_reason[1:80], chr(10) ORDER BY updated_at DESC, id), '_(none yet)_') FROM a3) || chr(10) || chr(10) || '## Preferences' || chr(10) || chr(10)
|| (SELECT coalesce(string_agg('- ' || key || ': ' || value, chr(10) ORDER BY updated_at DESC, id), '_(none yet)_') FROM p) || chr(10) || chr(10) || '## Permanent memory' || chr(10) || chr(10) || 'kept' || chr(10) AS text""", views="memory")
def memory_steering(spark, d):
    return memory.steering(tables.decisions(spark, d), tables.attempts(spark, d), tables.preferences(spark, d), "kept", "r1", "u1")


@query("SELECT id, 'decision:' || id AS cache_key, 'query:decisions:' || sha1('decisions:' || title || ':' || repo_id)[1:12] AS query_key FROM m_decisions", views="memory")
def cache_keys(spark, d):
    t = tables.decisions(spark, d)
    return t.select("id", memory.cache_key(F.lit("decision"), F.col("id")).alias("cache_key"), memory.query_key(F.lit("decisions"), F.col("title"), F.col("repo_id")).alias("query_key"))


@query("""SELECT id, repo_id, status FROM m_conventions WHERE CAST(id[2:] AS INTEGER) % 4 <> 0 UNION ALL SELECT id, repo_id, 'theirs' FROM m_conventions WHERE CAST(id[2:] AS INTEGER) % 4 = 0 UNION ALL SELECT 'x' || id, repo_id, 'theirs' FROM m_conventions WHERE CAST(id[2:] AS INTEGER) % 4 = 0""", views="memory")
def synced_conventions(spark, d):
    c = tables.conventions(spark, d).select("id", "repo_id", "status")
    t = c.where("CAST(substring(id, 2) AS INT) % 4 = 0").withColumn("status", F.lit("theirs"))
    return memory.synced(c, t.union(t.select(F.concat(F.lit("x"), "id"), "repo_id", "status")), "convention")


@query("SELECT 'a' || event_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'partial' END AS result FROM events UNION ALL SELECT 'xa' || event_id, 'theirs' FROM events WHERE event_id % 9 = 0", views=False)
def synced_attempts(spark, d):
    a = tables.attempts(spark, d).select("id", "result")
    t = table(spark, d, "events").where("event_id % 9 = 0").select(F.concat(F.lit("a"), "event_id").alias("id"), F.lit("theirs").alias("result"))
    return memory.synced(a, t.union(t.select(F.concat(F.lit("x"), "id"), "result")), "attempt")


@query("""SELECT key, CAST(to_json({'key': key, 'id': id, 'kind': kind, 'name': name}) AS VARCHAR) AS data FROM g_nodes""")
def node_properties(spark, d):
    n = graph(spark, d).nodes.select("key", "id", "kind", "name")
    return n.select("key", search.properties(n).alias("data"))


@query("SELECT key, CASE WHEN source_text <> '' THEN md5(filepath || chr(10) || source_text) END AS snippet_md5 FROM g_nodes")
def code_snippets(spark, d):
    from skeinwork.operators import context

    return graph(spark, d).nodes.select("key", F.md5(context.snippet(F.col("filepath"), F.col("source_text"))).alias("snippet_md5"))


@query()
def source_tokens(spark, d):
    """Tokens of each symbol's source by a byte-pair vocabulary, and the source cut to 512 of them."""
    import public_tokenizers

    from skeinwork import providers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    n = graph(spark, d).nodes
    return n.select("key", providers.token_count(F.col("source_text"), path, pattern).alias("n_tokens"), F.length(providers.truncated(F.col("source_text"), 512, path, pattern)).alias("cut_length"))


import skeinwork.plans.index_queries  # noqa: E402, F401
