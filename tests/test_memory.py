"""Memory tables, journals, searches, hosted services, tools, providers and loops."""

import datetime as dt
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from skeinwork import __main__ as cli
from skeinwork import loops, providers, tools
from skeinwork.checkpoint import Checkpoint
from skeinwork.operators import analysis, bridge, catalog, journal, memory, search
from skeinwork.streaming import twins

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(minutes=n)


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# -- memory


def rows(spark):
    return spark.createDataFrame([(f"d{i}", "r" if i % 2 else "", "u", f"title {i}", f"use {i}", "reverted" if i == 5 else "accepted", [f"m{i % 3}"], at(i)) for i in range(10)], "id string, repo_id string, author string, title string, decision string, outcome string, affected_modules array<string>, updated_at timestamp")


def test_listings(spark):
    d = rows(spark)
    assert [r["id"] for r in memory.decisions(d, "r").collect()] == ["d9", "d7", "d3", "d1"]
    assert [r["id"] for r in memory.decisions(d, "r", 2, include_reverted=True).collect()] == ["d9", "d7"]
    assert [r["id"] for r in memory.for_module(d, "m0", 4).collect()] == ["d9", "d6"]  # the limit comes first
    assert memory.listing(d, limit=3).count() == 3 and memory.listing(d, "r", "nobody").count() == 0
    c = spark.createDataFrame([("a", "r", "active", at(1)), ("b", "r", "retired", at(2))], "id string, repo_id string, status string, updated_at timestamp")
    assert memory.conventions(c, "r").count() == 1 and memory.conventions(c, "r", active_only=False).count() == 2


def test_saving_fills_authors_and_marks_team_rows(spark):
    old = spark.createDataFrame([("a", "u", False), ("b", "u", False)], "id string, author string, pending_sync boolean")
    new = spark.createDataFrame([("b", ""), ("c", None), ("d", "v")], "id string, author string")
    assert found(memory.remembered(old, new, "me", team=True), "id", "author", "pending_sync") == [("a", "u", False), ("b", "me", True), ("c", "me", True), ("d", "v", True)]


def test_search_takes_the_newest_first(spark):
    t = rows(spark).withColumns({"data": F.concat_ws(" ", "title", "decision"), "summary": F.col("title")})
    got = memory.found({"decision": t}, "TITLE use", limit=3)
    assert [r["id"] for r in got.collect()] == ["d9", "d8", "d7"] and {r["score"] for r in got.collect()} == {0.2}
    assert memory.found({"decision": t}, "use nothing").count() == 0 and memory.found({"decision": t}, " ").count() == 0
    assert memory.found({"decision": t}, "use", scope="personal").count() == 0


def test_context_block(spark):
    a = spark.createDataFrame([("a1", "r", "p" * 200, "failed", "why", "", at(1)), ("a2", "r", "q", "success", "", "", at(2))], "id string, repo_id string, problem string, result string, failure_reason string, lessons_learned string, updated_at timestamp")
    p = spark.createDataFrame([("p1", "", "u", "k", "v", at(1))], "id string, repo_id string, author string, key string, value string, updated_at timestamp")
    got = memory.context_block(rows(spark), a, p, "", "r", "u").first()
    lines = got["block"].split("\n")
    assert (got["decisions"], got["failures"], got["preferences"]) == (4, 1, 1)
    assert lines[3] == "- [ACCEPTED] title 9 — use 9" and "- Problem: " + "p" * 80 in lines and "  Failed because: why" in lines and lines[-2] == "- k: v"
    nothing = memory.context_block(rows(spark), a, p, " ", "x", "nobody").first()
    assert nothing["block"] == "" and nothing["decisions"] == 0


def test_cold_rows_are_canonical_json(spark):
    df = spark.createDataFrame([("x", 'a "b" ü', None, 1, "hidden")], "id string, title string, note string, n int, _s string")
    want = hashlib.sha1(json.dumps({"id": "x", "title": 'a "b" ü', "note": None, "n": 1}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert memory.cold_rows(df).first()["content_hash"] == want and "_s" not in memory.cold_rows(df).columns


def test_uuid5(spark):
    for name in ("r:file:a_py", "ä", ""):
        assert spark.range(1).select(bridge.uuid5(F.lit(name))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_actions_and_contexts(spark):
    a = spark.createDataFrame([("r", T0, "fixed it", ["a.py"], "success"), ("r", T0, "gave up", [], "failed")], "repo_id string, ts timestamp, action string, files array<string>, outcome string")
    assert found(memory.action_episodes(a), "session_id", "transcript") == [("agent:r:2024-01-01", "Agent: fixed it\nFiles: a.py\nOutcome: success"), ("agent:r:2024-01-01", "Agent: gave up\nFiles: none\nOutcome: failed")]
    facts = spark.createDataFrame([(i, f"f{i}", "v" * 300, "a.py") for i in range(30)], "seq int, attr string, val string, loc string")
    none = spark.createDataFrame([], "seq int, label string, source string, snippet string")
    text = memory.prompt_context("q?", facts, none).first()[0]
    assert text.startswith("CODEBASE CONTEXT FOR: q?\n\nCODE SYMBOLS AND FACTS:\n  - f0: " + "v" * 200 + " [a.py]") and text.count("  - f") == 20 and "PAST ACTIONS" not in text
    assert memory.prompt_context("q?", facts.where("false"), none).first()[0] == "CODEBASE CONTEXT FOR: q?\n"


# -- journals


def test_logs_round_trip_and_extraction(spark):
    t = spark.createDataFrame([(1, 0, "user", "we decided: nothing at all here"), (1, 1, "assistant", "We decided: to keep the old parser.\nIt failed: out of memory; again."), (1, 2, "assistant", "we decided: to keep the old parser"), (2, 0, "assistant", "short")], "conv_id long, turn int, role string, text string")
    entries = t.select("conv_id", "turn", journal.turn_entry(F.lit("T"), F.col("role"), F.col("text")).alias("entry"))
    logs = journal.logs(entries, "conv_id", "turn", "entry")
    back = journal.turns_of(logs, "conv_id", "text")
    got = found(analysis.extract(back), "conv_id", "class", "text")
    assert got == found(analysis.extract(t), "conv_id", "class", "text")
    assert (1, "decisions", "to keep the old parser") in got and (1, "failed", "out of memory; again") in got and not [r for r in got if r[0] == 2]
    rows = journal.promoted(analysis.extract(t), "r", "me")
    assert rows["attempts"].first()["failure_reason"] == "out of memory; again" and rows["decisions"].first()["outcome"] == "pending"


def test_compaction(spark):
    logs = spark.createDataFrame([("long", "\n".join(map(str, range(400))) + "\n"), ("short", "a\nb"), ("empty", "")], "log string, text string")
    counts = spark.createDataFrame([("long", 2, 1, 0)], "log string, decisions int, attempts int, preferences int")
    got = {r["log"]: r for r in journal.compacted(logs, "log", "text", counts).collect()}
    assert (got["long"]["lines_before"], got["long"]["lines_after"], got["long"]["reduction_pct"]) == (400, 61, 84.8)
    assert got["long"]["text"].split("\n")[:2] == ["<!-- compacted | extracted: 2d 1a 0p -->", "340"] and got["short"]["text"] == "a\nb" and got["empty"]["reduction_pct"] == 0.0


def test_sections_take_a_key_once(spark):
    kind = "section string, key string, line string, at timestamp"
    old = spark.createDataFrame([("## Decisions", "k", "kept", at(0))], kind)
    new = spark.createDataFrame([("## Decisions", "k", "skipped", at(1)), ("## Decisions", "n", "first", at(1)), ("## Failed Approaches", "n", "second", at(2)), ("## Decisions", None, "a", at(3)), ("## Decisions", None, "b", at(4))], kind)
    m = journal.put_in_sections(old, new)
    assert found(m, "line") == [("a",), ("b",), ("first",), ("kept",)]
    text = {r["section"]: r["text"] for r in journal.memory_text(m).collect()}
    assert text["## Decisions"] == "## Decisions\n\n- 2024-01-01 b\n- 2024-01-01 a\n- 2024-01-01 first <!-- key:n -->\n- 2024-01-01 kept <!-- key:k -->\n"
    lines = spark.createDataFrame([("a\nb\nc\n",), ("",)], "t string")
    assert [r[0] for r in lines.select(journal.last_lines(F.col("t"), 2)).collect()] == ["b\nc", ""]
    d = spark.createDataFrame([("2024-01-02",), ("2024-01-01",), ("notes",)], "date string")
    assert [r[0] for r in journal.dates(d, "date").collect()] == ["2024-01-01", "2024-01-02"]


# -- services and catalogue


def test_tenants_limits_and_jobs(spark):
    r = spark.createDataFrame([("u:a:b", "u"), ("v:x", "u")], "s string, u string")
    assert [x[0] for x in r.select(memory.unscoped(F.col("s"), F.col("u"))).collect()] == ["a:b", None]
    calls = spark.createDataFrame([("k", "m", i) for i in range(3)] + [("bad", "m", 0)], "key string, period string, n int")
    keys, limits = spark.createDataFrame([("k", "u", "free")], "key string, user string, tier string"), spark.createDataFrame([("free", 2)], "tier string, most int")
    assert found(memory.allowed_calls(calls, keys, limits, ["n"]), "key", "n", "allowed") == [("bad", 0, False), ("k", 0, True), ("k", 1, True), ("k", 2, False)]
    url = "https://github.com/a/"
    requests = spark.createDataFrame([(i, "u", url + str(i), i) for i in range(3)] + [(9, "u", "ftp://x", 9)], "job_id int, user string, url string, seq int")
    jobs, messages = memory.submitted(requests, spark.createDataFrame([], "user string, n int"))
    assert found(jobs, "job_id", "status") == [(0, "QUEUED"), (1, "QUEUED"), (2, "REJECTED_LIMIT"), (9, "REJECTED_URL")] and found(messages, "job_id") == [(0,), (1,)]
    assert memory.job_of(jobs, 0, "u").count() == 1 and memory.job_of(jobs, 0, "v").count() == 0


def test_settings(spark):
    df = spark.createDataFrame([("bolt://h", 80, 512, 10), ("http://h", 0, 3, 1001), (None, None, None, None)], "uri string, port int, dimensions int, batch int")
    assert [len(r[0]) for r in df.select(catalog.settings_errors(F.struct("*"))).collect()] == [0, 4, 0]


def test_checkpoint(spark, tmp_path):
    c, rows = Checkpoint(spark, str(tmp_path / "c"), "r"), spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert c.left("docs", rows, "id").count() == 3
    c.mark("docs", rows.where("id < 'c'"))
    assert found(c.left("docs", rows, "id"), "id") == [("c",)] and c.left("vectors", rows, "id").count() == 3
    assert Checkpoint(spark, str(tmp_path / "c"), "other").left("docs", rows, "id").count() == 3
    c.clear()
    assert c.left("docs", rows, "id").count() == 3


# -- searches, tools, providers


def test_search_falls_back_to_symbols(spark, sf):
    g = tools.Graph.of(spark, sf)
    by_name = tools.dispatch(g, "search", {"query": "part_1", "repo_id": "r1"})
    assert by_name.count() == 10 and {r["score"] for r in by_name.collect()} == {1.0} and {r["confidence"] for r in by_name.collect()} == {1.0}
    g.embed = lambda text: [1.0] * 64
    assert {r["score"] for r in tools.dispatch(g, "search", {"query": "part_1", "repo_id": "r1"}).collect()} != {1.0}
    new = spark.createDataFrame([("q", at(i), i) for i in range(60)], "query string, ts timestamp, results int")
    assert search.with_history(new.limit(0), new).count() == 50


def test_tools(spark, sf):
    g = tools.Graph.of(spark, sf)
    assert tools.dispatch(g, "keyword_search", {"query": "ring"}).count() > 0
    assert "min_depth" in tools.dispatch(g, "callers", {"key": 42, "depth": 2}).columns
    assert tools.dispatch(g, "trace", {"source": "brand", "repo_id": "r1", "target_level": "nonsense"}).count() >= 0
    assert tools.dispatch(g, "query", {"text": "SELECT count(*) FROM nodes WHERE kind = :k", "args": {"k": "class"}}).first()[0] > 0
    for name, arguments in (("history", {"file_or_symbol": "part_7"}), ("decisions", {"module_or_component": "m3"}), ("attempts", {"problem_query": "error"}), ("get_context", {"repo_id": "r1", "author": "u1"}), ("repositories", {}), ("statistics", {}), ("edges", {"repo_id": "r1"}), ("export_dot", {"repo_id": "r1"})):
        assert tools.dispatch(g, name, arguments).count() > 0, name
    for arguments, error in (({}, ValueError), ({"query": 3}, TypeError)):
        with pytest.raises(error):
            tools.dispatch(g, "keyword_search", arguments)
    with pytest.raises(KeyError):
        tools.dispatch(g, "nothing", {})
    assert tools.schemas()["trace"]["required"] == ["source", "repo_id"]


def test_plans_run(spark, sf):
    g = tools.Graph.of(spark, sf)
    task = lambda i, q, agent, deps=(), p=1: {"task_id": i, "description": i, "search_queries": [q], "target_agent": agent, "priority": p, "depends_on": list(deps)}
    tasks = tools.planned("why?", [task("a", "part_1", "trace"), task("b", "zzz", "impact"), task("c", "zzz", "search", ["a"]), task("d", "part_2", "dreams")], g.nodes, ["part_3"])
    assert [t["task_id"] for t in tasks] == ["a", "c", "d", "subtask-test-part_3"]
    results, failures = tools.executed(g, tasks, "r1")
    assert set(results) == {"a", "c", "subtask-test-part_3"} and set(failures) == {"d"}
    assert tools.planned("why?", [task("b", "zzz", "impact")], g.nodes, [])[0]["task_id"] == "subtask-fallback"


def test_providers(spark):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert providers.retried(flaky, sleep=waits.append) == "ok" and 2 <= waits[0] < 3 and 4 <= waits[1] < 5
    with pytest.raises(OSError):
        providers.retried(lambda: (_ for _ in ()).throw(OSError()), sleep=lambda _: None)
    df = spark.createDataFrame([("the cat sat",), ("the cat sat",), ("other words",), (None,), ("",)], "t string")
    v = [list(r["vector"]) for r in providers.embedded(df, "t", providers.HashedWords(16)).collect()]
    assert v[0] == v[1] != v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[3] == v[4] == [0.0] * 16
    assert providers.json_items('sure: [{"a": 1}, 2] ok') == [{"a": 1}] and providers.json_items("no") == [] and providers.json_items('{"a": 1}') == []


def test_documentation_by_rules(spark, sf):
    g = tools.Graph.of(spark, sf)
    prompts = providers.symbol_prompts(g.nodes, g.edges)
    made = providers.documented(prompts, providers.DESCRIPTION, providers.Rules())
    assert made.count() == prompts.count() > 0 and "" not in {r["summary"] for r in made.collect()}
    described = made.select("node_id", "summary").join(g.nodes.select(F.col("id").alias("node_id"), "key"), "node_id").select(F.col("key").alias("node_id"), "summary")
    details = providers.documented(providers.detail_prompts(described, g.nodes), providers.DETAIL, providers.Rules())
    assert details.count() == made.count() and "lines" in details.first()["algorithm_description"]
    modules = providers.documented(providers.module_prompts(g.nodes), providers.MODULE, providers.Rules())
    assert modules.count() > 10 and modules.where("architectural_role like 'module of % symbols'").count() == modules.count()
    broken = providers.documented(prompts, providers.DESCRIPTION, lambda p: "no json")
    assert broken.count() == 0


def test_patch_patterns(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@ def load(a):\n+x\n+++ b/y.py\n@@ -1 +1 @@ class Part:\n"
    p = spark.createDataFrame([("i", "", "old", 1), ("i", diff, "it fails", 2)], "instance_id string, patch string, problem_statement string, at int")
    r = providers.patch_patterns(p, providers.HashedWords(8)).collect()
    assert len(r) == 1 and r[0]["files"] == ["x.py", "y.py"] and r[0]["symbols"] == ["load", "Part"] and r[0]["signature"] == hashlib.sha256(b"x.py,y.py|Part,load|bugfix").hexdigest()
    assert list(r[0]["vector"]) == providers.HashedWords(8)(["it fails"])[0]
    names = spark.createDataFrame([("/a/b/",), ("c",)], "p string")
    assert [x[0] for x in names.select(catalog.repo_id(F.col("p"))).collect()] == ["b", "c"]


def test_plans_from_a_model(spark, sf):
    g = tools.Graph.of(spark, sf)
    answer = 'Sure: [{"description": "d", "search_query": "part_1", "agent": "trace", "depends_on": [1, 7]}, {"description": "e", "search_query": "part_2", "agent": "dreams"}]'
    tasks = tools.decomposed("why?", lambda prompt: answer if "why?" in prompt else "", g.nodes)
    assert [(t["task_id"], t["target_agent"], t["depends_on"]) for t in tasks] == [("subtask-0", "trace", ["subtask-1"]), ("subtask-1", "search", [])]
    assert tools.decomposed("why?", None, g.nodes)[0]["search_queries"] == ["why?"] and tools.decomposed("why?", lambda _: "no idea", g.nodes)[0]["task_id"] == "subtask-fallback"


def test_tokens_of_a_vocabulary(spark):
    p = pytest.importorskip("public_tokenizers")
    path = p.path("byte_bpe_50k.tiktoken")
    text = "One sentence here. And another one, which is longer."
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    n = [r[0] for r in df.select(providers.token_count(F.col("t"), path, p.PATTERN)).collect()]
    e = providers._encoding(path, p.PATTERN)
    assert n == [len(e.encode_ordinary(text)), 0, None]
    assert [r[0] for r in df.select(providers.truncated(F.col("t"), 6, path, p.PATTERN)).collect()] == ["One sentence here.", "", None]


def test_loops(spark):
    patches = iter(["a", "b", "c"])
    outcomes = {"a": loops.Outcome(["t1"], ["t2", "t3"]), "b": loops.Outcome(["t1"], ["t2"]), "c": loops.Outcome(["t1", "t2"])}
    done = loops.refined("p", "c", lambda *_: next(patches), outcomes.get)
    assert done.patch == "c" and done.converged and [len(r.failed) for r in done.runs] == [2, 1, 0] and outcomes["a"].rate == 1 / 3
    stuck = loops.refined("p", "c", lambda *_: "a", outcomes.get)
    assert len(stuck.runs) == 2 and stuck.converged
    i = spark.createDataFrame([("i1", "a/django", "p1", "x"), ("i2", "b", "p2", "y")], "instance_id string, repo string, problem_statement string, patch string")
    assert loops.subset(i).count() == 1 and loops.subset(i, "flask").count() == 2
    runs = {r["instance_id"]: r for r in loops.evaluated(spark, i, lambda p: (" x\n", 0.5) if p == "p1" else 1 / 0).collect()}
    assert runs["i1"]["resolved"] and runs["i2"]["failed"] and loops.evaluated(spark, i, None).where("skipped").count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("from b import helper\ndef run():\n    go()\ndef go():\n    pass\n")
    (tmp_path / "src" / "b.py").write_text("def helper():\n    pass\n")
    run = lambda *a: cli.main(["--store", str(tmp_path / "s"), "--repo", "r", *a])
    run("index", str(tmp_path / "src"))
    first = json.loads(capsys.readouterr().out)
    (tmp_path / "src" / "b.py").write_text("def helper():\n    pass\ndef more():\n    pass\n")
    run("index", str(tmp_path / "src"))
    assert json.loads(capsys.readouterr().out)["nodes"] == first["nodes"] + 1
    run("query", "callers", "go")
    assert json.loads(capsys.readouterr().out)["name"] == "run"
    run("memory", "remember", '{"title": "keep it", "id": "d1"}', "--author", "me")
    run("memory", "search", "keep")
    assert json.loads(capsys.readouterr().out)["id"] == "d1"


# -- streams


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_journal_stream(spark, tmp_path):
    s = source(spark, tmp_path, [("s", at(i), "user" if i % 2 else "assistant", f"t{i}") for i in range(21)], "session_id string, ts timestamp, role string, content string")
    got = twins.drained(twins.journal(s), "journal_out", "append", str(tmp_path / "c"))
    assert [r["n"] for r in got.where("flush").orderBy("n").collect()] == [5, 10, 15, 20] and [r["n"] for r in got.where("compact").collect()] == [20]
    entries = s.select("session_id", "ts", journal.turn_entry(F.lit("T"), F.col("role"), F.col("content")).alias("entry"))
    twins.appended(entries, str(tmp_path / "logs"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 21


def test_hook_stream(spark, tmp_path):
    s = source(spark, tmp_path, [("s", at(0), "session-start", None, "hello"), ("s", at(1), "promptSubmit", None, "do"), ("s", at(2), "postToolUse", "grep", "x" * 300), ("s", at(3), "agentStop", None, "done"), ("s", at(4), "other", None, "?")], "session_id string, ts timestamp, type string, tool string, content string")
    got = [r["entry"] for r in twins.drained(twins.hook_entries(s), "hooks_out", "append", str(tmp_path / "c")).orderBy("ts").collect()]
    assert len(got) == 4 and "[session]" in got[0] and "**User**: do" in got[1] and "**Tool**: `grep()`" in got[2] and got[2].count("x") == 200 and "**Assistant**: done" in got[3]


def test_cache_stream(spark, tmp_path):
    ops = [("set", "a"), ("set", "b"), ("get", "a"), ("set", "c"), ("get", "b"), ("get", "a"), ("invalidate", "a"), ("get", "a"), ("get", "c")]
    s = source(spark, tmp_path, [("x", at(i), op, k) for i, (op, k) in enumerate(ops)] + [("x", at(200), "get", "c")], "cache string, ts timestamp, op string, key string")
    got = twins.drained(twins.cached(s, capacity=2), "cache_out", "append", str(tmp_path / "c")).orderBy("ts").collect()
    assert [r["hit"] for r in got if r["op"] == "get"] == [True, False, True, False, True, False] and (got[-1]["hits"], got[-1]["misses"], got[-1]["evictions"]) == (3, 3, 1)


def test_progress_stream_and_fan_out(spark, tmp_path):
    s = source(spark, tmp_path, [("r", at(0), 0, 10, "running"), ("r", at(1), 5, 10, "running"), ("q", at(0), 1, 0, "running"), ("d", at(0), 3, 3, "complete")], "repo_id string, ts timestamp, processed int, total int, status string")
    got = {r["repo_id"]: r for r in twins.drained(twins.progress_states(s), "progress_out", "complete", str(tmp_path / "c")).collect()}
    assert (got["r"]["percent"], got["r"]["eta"], got["q"]["percent"], got["d"]["eta"]) == (50.0, 60.0, 0.0, 0.0)
    heard = []

    def dead(_):
        raise OSError

    subscribers = [dead, heard.extend]
    twins.fanned_out(s, subscribers, str(tmp_path / "c2")).awaitTermination()
    assert len(heard) == 4 and len(subscribers) == 1 and dead not in subscribers


def test_journals_are_read_once(spark):
    """A log is looked through for all patterns in one pass, so a task reads its exchange once."""
    from skeinwork.operators import analysis

    turns = spark.createDataFrame([(1, 0, "assistant", "We decided: use the pool. I prefer short names here.")], "conv_id long, turn int, role string, text string")
    plan = analysis.extract(turns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan
