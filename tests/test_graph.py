"""The graph operators on small named graphs, against brute force and against DuckDB."""

import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skeinwork.operators import analysis, context, docs, memory, relational, traversal

CHAIN = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]


def edges(spark, pairs, relation="calls"):
    return spark.createDataFrame([(a, b, relation) for a, b in pairs], "src long, dst long, relation string")


def nodes(spark, keys, path=lambda k: f"src/f{k}.py"):
    return spark.createDataFrame([(k, f"n{k}", "function", f"fn_{k}", path(k), 1, 3, "x\ny\n", None, None, None, "r") for k in keys], "key long, id string, kind string, name string, filepath string, start_line int, end_line int, source_text string, docstring string, signature string, parent_id string, repo_id string")


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("depth", "want"), [(1, {5}), (2, {5, 4}), (5, {1, 2, 3, 4, 5}), (0, {5}), (99, {1, 2, 3, 4, 5})])
def test_call_chain(spark, depth, want):
    got = traversal.callers(nodes(spark, range(1, 7)), edges(spark, CHAIN), 6, depth)
    assert {r["node_id"] for r in got.collect()} == {f"n{k}" for k in want}
    assert traversal.callers(nodes(spark, range(1, 7)), edges(spark, CHAIN), 1, depth).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20), st.integers(1, 4))
def test_reach_is_breadth_first(spark, pairs, depth):
    pairs = {(a, b) for a, b in pairs if a != b}
    want = set()
    for root in range(9):
        seen, at = {root}, {root}
        for d in range(1, depth + 1):
            at = {b for a, b in pairs if a in at} - seen
            seen |= at
            want |= {(root, n, d) for n in at}
    e = edges(spark, pairs)
    roots = spark.createDataFrame([(i,) for i in range(9)], "root long")
    assert found(traversal.reach(e, roots, depth), "root", "node", "depth") == sorted(want)
    assert found(traversal.levels(e, roots, depth), "root", "node", "depth") == sorted(want)


def test_impact_and_risk(spark):
    e = edges(spark, [(i, 1) for i in range(2, 17)] + [(20, 21), (21, 22)])
    n = nodes(spark, range(1, 23), lambda k: f"tests/t{k}.py" if k == 2 else f"src/f{k}.py")
    got = {r["key"]: r for r in traversal.impact(n, e, n).collect()}
    assert set(got) == set(range(1, 23))
    one = got[1]  # fifteen callers, in all three depths
    assert (one["direct_callers_count"], one["total_callers_count"], one["risk_score"], one["risk_label"], one["propagation_depth"]) == (15, 45, 1.0, "High", 0)
    assert [x["node_id"] for x in one["test_files"]] == ["n2"] * 3 and len(one["direct_dependents"]) == 14 and len(one["all_callers"]) == 45
    assert got[21]["risk_score"] == 0.16 and got[21]["risk_label"] == "Low" and got[21]["propagation_depth"] == 3
    # a symbol without callers, and one without callees
    assert (got[20]["direct_callers_count"], got[20]["risk_score"], got[20]["propagation_depth"], got[20]["all_callers"]) == (0, 0.0, 3, [])
    assert got[22]["total_callers_count"] == 1 + 2 + 2 and got[22]["propagation_depth"] == 0
    assert [(x["at"], x["node_id"]) for x in got[22]["all_callers"]] == [(1, "n21"), (2, "n20"), (2, "n21"), (3, "n20"), (3, "n21")]


def test_neighbors_and_blast_radius(spark):
    e = edges(spark, CHAIN).union(edges(spark, [(3, 9)], "contains"))
    assert {r["node"] for r in traversal.neighbors(e, 3).collect()} == {2, 4, 9}
    assert {r["node"] for r in traversal.neighbors(e, 3, "contains").collect()} == {9}
    got = traversal.blast_radius(e, spark.createDataFrame([(6,), (3,)], "key long"), 2)
    assert {r["confidence"] for r in got.collect()} == {0.3}
    assert found(got, "node", "impact_score") == [(1, 1 / 3), (2, 0.5), (3, 1.0), (4, 1 / 3), (5, 0.5), (6, 1.0)]


def test_paths_use_an_edge_once(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 3)])
    everything = spark.createDataFrame([(i,) for i in range(1, 4)], "key long")
    got = found(traversal.paths(e, everything, everything), "path_text")
    assert got == sorted((p,) for p in ("1>2>1", "1>2>3", "2>1>2", "1>2>1>2", "2>1>2>3") if p != "1>2>1>2")


@pytest.mark.parametrize(("tasks", "want"), [
    ([("a", [], 1), ("b", [], 2)], [["a", "b"]]),
    ([("a", [], 1), ("b", ["a"], 2), ("c", ["b"], 3)], [["a"], ["b"], ["c"]]),
    ([("a", [], 1), ("b", ["a"], 1), ("c", ["a"], 1)], [["a"], ["b", "c"]]),
    ([("a", ["b"], 2), ("b", ["a"], 1)], [["b"], ["a"]]),
    ([], []),
])
def test_plan_levels(tasks, want):
    assert traversal.plan_levels(tasks) == want


def test_level_rows_are_plan_levels(spark):
    plans = {"diamond": [("a", [], 1), ("b", ["a"], 2), ("c", ["a"], 3), ("d", ["b", "c"], 4)], "ring": [("x", ["y"], 2), ("y", ["x"], 1), ("z", ["x", "gone", "z"], 0)], "one": [("s", ["s"], 1)]}
    rows = [(p, t, n, deps) for p, tasks in plans.items() for t, deps, n in tasks]
    got = found(traversal.level_rows(spark.createDataFrame(rows, "plan string, task_id string, priority int, depends_on array<string>")), "plan", "level", "task_id")
    assert got == sorted((p, k, t) for p, tasks in plans.items() for k, group in enumerate(traversal.plan_levels(tasks), 1) for t in group)
    assert traversal.level_rows(spark.createDataFrame([], "plan string, task_id string, priority int, depends_on array<string>")).count() == 0


def test_module_rings(spark):
    pairs = spark.createDataFrame([(a, b) for a, b in ("ab", "bc", "ca", "cd", "de", "ef", "fd", "gh")], "src_module string, dst_module string")
    assert found(traversal.module_rings(pairs), "module", "ring") == [(x, "a") for x in "abc"] + [(x, "d") for x in "def"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=18))
def test_components_are_strong(spark, pairs):
    after = {n: {b for a, b in pairs if a == n} for n in range(10)}
    for _ in range(10):
        after = {n: x.union(*(after[m] for m in x)) for n, x in after.items()}
    ring = {n: min([n] + [m for m in after[n] if n in after[m]]) for n in range(10)}
    want = sorted((n, r) for n, r in ring.items() if sum(v == r for v in ring.values()) > 1)
    assert found(traversal.components(edges(spark, pairs)), "node", "component") == want


def test_levels_have_no_end(spark):
    """A chain longer than any bound on rounds that there once was."""
    rows = [("p", f"t{i:03}", i, [f"t{i - 1:03}"] if i else []) for i in range(66)]
    got = traversal.level_rows(spark.createDataFrame(rows, "plan string, task_id string, priority int, depends_on array<string>"))
    assert found(got, "level", "task_id") == [(i + 1, f"t{i:03}") for i in range(66)]


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_frontiers_of_any_size(spark, monkeypatch, few):
    """Frontiers that are looked up and such that are joined find the same; keys below zero are keys like others."""
    monkeypatch.setattr(traversal, "FEW", few)
    e = edges(spark, [(-1, 2), (3, -1), (3, 2), (5, 3), (5, 5), (6, 5), (7, 6), (2, 3)])
    n = nodes(spark, [-1, 2, 3, 5, 6, 7])
    assert found(traversal.callers(n, e, 2, 3), "node_id", "min_depth") == [("n-1", 1), ("n3", 1), ("n5", 2), ("n6", 3)]
    assert found(traversal.neighbors(e, -1, None, 2), "node", "min_depth") == [(2, 1), (3, 1), (5, 2)]
    got = traversal.blast_radius(e, spark.createDataFrame([(2,), (2,), (None,)], "key long"))
    assert found(got, "node", "impact_score") == [(-1, 0.5), (2, 1.0), (3, 0.5), (5, 1 / 3), (6, 0.25)]
    assert traversal.blast_radius(e, spark.createDataFrame([], "key long")).count() == 0


LAYERS = "node_id long, summary string", "component_id long, data_flow string", "module_path string, architectural_role string"


def layers(spark):
    return tuple(spark.createDataFrame(rows, schema) for rows, schema in zip(([(1, "one"), (2, "two"), (99, "lost")], [(1, "flow"), (99, "lost")], [("src", "role"), ("src/sub", "inner")]), LAYERS))


def test_trace_levels_are_cumulative(spark):
    n, (desc, details, arch) = nodes(spark, [1, 2, 3]), layers(spark)
    kinds = lambda level, source="src/f1": [r["type"] for r in docs.trace(n, desc, details, arch, source, "r", level).orderBy("type").collect()]
    assert kinds("code") == kinds("no such level") == ["component_desc"] and kinds("component") == ["component", "component_desc"]
    assert kinds("architecture") == ["architecture", "component", "component_desc"]
    assert kinds("architecture", "fn_2") == ["architecture", "component_desc"] and kinds("architecture", "fn_") == []  # a name is whole, a path is part
    assert docs.trace(n, desc, details, arch, "src/", "other").count() == 0
    assert {r["confidence"] for r in docs.trace(n, desc, details, arch, "src/f1", "r").collect()} == {0.3}


def test_context_surrounds_what_is_located(spark):
    n, (desc, details, arch) = nodes(spark, [1, 2, 3, 4]), layers(spark)
    e = edges(spark, [(3, 1), (1, 2), (2, 4)], "contains").union(edges(spark, [(1, 4)]))
    got = {r["context_id"]: r for r in docs.context(n, e, desc, details, arch, "fn_1", "r").collect()}
    assert set(got) == {"n2", "n3", "src"} and got["n2"]["summary"] == "two" and got["n3"]["summary"] is None and got["src"]["type"] == "module"
    assert got["n2"]["confidence"] == 0.1
    t = {r["key"]: r for r in docs.traceability(n, e, desc, details, arch).collect()}
    assert [x["type"] for x in t[1]["requirement_links"]] == ["ComponentDescription", "ComponentDoc"] and t[1]["has_architecture_context"] and not t[3]["has_documentation"]


def test_layers_are_kept_where_they_belong(spark):
    n, (desc, details, arch) = nodes(spark, [1, 2]), layers(spark)
    kept, known, links = docs.stored_layers(n, desc, details, arch)
    assert found(kept, "node_id") == [(1,), (2,)] and found(known, "component_id") == [(1,)] and found(links, "key", "module_path") == [(1, "src"), (2, "src")]
    old = spark.createDataFrame([(1, [1.0, 0.0])], "key long, vector array<double>")
    new = spark.createDataFrame([(1, [0.0, 1.0]), (9, [1.0, 1.0])], "key long, vector array<double>")
    assert [list(r["vector"]) for r in docs.stored_embeddings(n, old, new, 2).collect()] == [[0.0, 1.0]]
    with pytest.raises(Exception, match="length 1, not 2"):
        docs.stored_embeddings(n, old, spark.createDataFrame([(2, [1.0])], "key long, vector array<double>"), 2).collect()


def test_dot_is_a_graph(spark):
    n = nodes(spark, [1, 2])
    lines = [r["line"] for r in relational.dot_lines(n, edges(spark, [(1, 2), (1, 7)])).orderBy("part", "line").collect()]
    assert lines[0] == "  node [shape=box];" and lines[-1] == "}" and lines.count('  "n1" -> "n2" [label="calls"];') == 1
    assert '  "n1" [label="fn_1", style=filled, fillcolor="lightgreen"];' in lines and len(lines) == 7

def test_prefix_join_is_by_whole_segments(spark):
    n = nodes(spark, [1, 2], lambda k: "src/view/a.py" if k == 1 else "src/views/a.py")
    arch = spark.createDataFrame([("src/view", "role")], "module_path string, architectural_role string")
    assert found(docs.prefix_links(n, arch), "key") == [(1,)]


def test_imports_resolve_to_definitions(spark):
    i = spark.createDataFrame([("i1", "a.b.foo"), ("i2", "bar"), ("i3", "x.y")], "id string, target string")
    d = spark.createDataFrame([("d1", "foo", "function"), ("d2", "bar", "module"), ("d3", "bar", "class")], "id string, name string, kind string")
    assert found(docs.import_links(i, d), "src", "dst") == [("i1", "d1"), ("i2", "d3")]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", ["x"], 1), (2, "b", ["y"], 5)], "id int, s string, l array<string>, v int")
    new = spark.createDataFrame([(2, "B", ["z", "y"], 4), (3, "c", None, 1)], "id int, s string, l array<string>, v int")
    assert found(relational.upsert(old, new, ["id"], "v"), "id", "s") == [(1, "a"), (2, "b"), (3, "c")]
    assert found(relational.list_merge(old, new, "id", ["l"], "v"), "id", "s", "l", "v") == [(1, "a", ["x"], 1), (2, "b", ["y", "z"], 5), (3, "c", [], 1)]
    assert found(relational.merge_keeping(old, new, ["id"], ["v"]), "id", "s", "v") == [(1, "a", 1), (2, "b", 4), (3, "c", 1)]
    assert found(relational.diff(new, old, "id", "s"), "id", "status") == [(1, "deleted"), (2, "changed"), (3, "new")]


def test_keys_that_repeat_in_a_batch(spark):
    old = spark.createDataFrame([("a", "r", "me", "x", 1, False)], "id string, repo_id string, author string, title string, updated_at int, pending_sync boolean")
    new = spark.createDataFrame([("b", "r", "", "first", 2, False), ("b", "r", "", "last", 3, False), ("b", "r", "", "last", 3, False), ("a", "r", "you", "y", 2, False)], old.schema)
    assert found(memory.remembered(old, new, "me", team=True), "id", "author", "title", "pending_sync") == [("a", "you", "y", True), ("b", "me", "last", True)]
    for kind in ("attempt", "convention", "decision"):
        assert found(memory.synced(old, new, kind), "id", "title") == [("a", "x" if kind == "attempt" else "y"), ("b", "last")]
    stored = docs.stored_embeddings(nodes(spark, [1]), spark.createDataFrame([(1, [0.0])], "key long, vector array<double>"), spark.createDataFrame([(1, [1.0]), (1, [2.0])], "key long, vector array<double>"), 1)
    assert found(stored, "key", "vector") == [(1, [2.0])]


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", relational.cosine(F.col("a"), F.col("b"))).collect())


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, 5, "g"), (2, 9, "g"), (3, 1, "g")], "rank int, tokens int, g string")
    assert found(relational.within_budget(df, "tokens", ["rank"], 10, "g"), "rank") == [(1,)]


@pytest.mark.parametrize("budget", [0, 1, 40, 10**6])
def test_budget_of_a_hot_group(spark, budget):
    rows = [(i, (i * 7) % 5, "hot" if i % 10 else f"g{i % 3}") for i in range(2000)]
    want, spent = [], {}
    for i, n, g in rows:
        spent[g] = spent.get(g, 0) + n
        if spent[g] <= budget:
            want.append((i, spent[g]))
    df = spark.createDataFrame(rows, "rank int, tokens int, g string").repartition(7)
    assert found(relational.within_budget(df, "tokens", ["rank"], budget, "g"), "rank", "running") == sorted(want)


def test_evaluation(spark):
    rows = [(True, False, False, 1.0, 2.0), (False, False, True, 1.0, 2.0), (True, False, False, 1.0, 2.0), (False, False, False, 1.0, 2.0), (True, True, False, 1.0, 2.0)]
    r = relational.evaluation(spark.createDataFrame(rows, "resolved boolean, skipped boolean, failed boolean, cost double, seconds double")).first()
    assert (r["resolve_rate"], r["error_rate"], r["n"]) == (0.5, 0.2, 5)


def test_documenting_and_complexity(spark):
    df = spark.createDataFrame([("class", "x"), ("function", "a\n" * 10), ("function", "a\n" * 9), ("variable", "a\n" * 50)], "kind string, src string")
    assert [r[0] for r in df.select(relational.worth_documenting(F.col("kind"), F.col("src"))).collect()] == [True, True, False, False]
    t = spark.createDataFrame([("Fix typo", 0), ("fix", 1), ("change", 2), ("x", 4), ("w " * 300, 0), ("w " * 100, 0), ("the module", 0), ("Import a package, refactor", 0)], "text string, files int")
    assert [r[0] for r in t.select(analysis.complexity(F.col("text"), F.col("files"))).collect()] == ["SIMPLE", "SIMPLE", "MODERATE", "COMPLEX", "COMPLEX", "MODERATE", "MODERATE", "COMPLEX"]
    up = analysis.routed(spark.createDataFrame([("SIMPLE", True), ("MODERATE", True), ("COMPLEX", True), ("SIMPLE", False)], "class string, failed boolean"), "failed")
    assert sorted(r["tier"] for r in up.collect()) == ["fast", "reasoning", "reasoning", "standard"]


def test_contexts_by_hand(spark):
    df = spark.createDataFrame([("function", "i", "f", "a.py", None, ""), ("", "i", None, None, None, None), ("note", None, "", "", "", "s")], "k string, i string, n string, f string, c string, s string")
    assert [r[0] for r in df.select(context.rendered(*(F.col(c) for c in "kinfcs"))).collect()] == ["[function]\nName: f\nFile: a.py", "Node: i", "[note]\nSummary: s"]
    t = spark.createDataFrame([(None,), ("",), ("One. Two.\n\n Three ",), (". ".join(map(str, range(30))),)], "t string")
    assert [r[0] for r in t.select(context.key_facts(F.col("t"))).collect()] == [[], [], ["One", "Two.", "Three"], [*map(str, range(10))]]
    t = spark.createDataFrame([("a b",), ("a. bbbb cccc dddd",), ("aaaa bbbb. c dddd",), ("aa bb cc dd",), (None,)], "t string")
    assert [r[0] for r in t.select(context.truncated(F.col("t"), 3)).collect()] == ["a b", "a. bbbb cccc", "aaaa bbbb.", "aa bb cc", None]
    r = spark.createDataFrame([("", ""), (" x\n", "x"), ("x", "y"), (None, "x")], "p string, g string")
    assert [x[0] for x in r.select(context.resolved(F.col("p"), F.col("g"))).collect()] == [False, True, False, False]
    n = spark.createDataFrame([(["a", "b", "c"], ["calls", "imports"])], "n array<string>, r array<string>")
    assert n.select(context.narrative(F.col("n"), F.col("r"))).first()[0] == "a (calls) → b (imports) → c"


@pytest.mark.parametrize("module", [".", "src", "src/a/very/long/path/with/many/parts/in/it/and/more", "ä/b"])
def test_hue_wraps(spark, module):
    h = 0
    for c in module:
        shifted = (h * 32) & 0xFFFFFFFF
        h = ord(c) + (shifted - (1 << 32) if shifted >= 1 << 31 else shifted) - h
    assert spark.range(1).select(context.hue(F.lit(module))).first()[0] == abs(h) % 360


def test_plans_are_checked(spark):
    tasks = [("a", ["zz", "fn_2"], "impact"), ("b", ["zz"], "impact"), ("c", ["zz"], "search"), ("d", [""], "impact")]
    assert [t[0] for t in context.supported(nodes(spark, range(3)), tasks)] == ["a", "c"]
    assert context.supported(nodes(spark, []), tasks[:2]) == [] and context.supported(nodes(spark, range(3)), []) == []
    assert context.with_signals(tasks, ["zz", "new", "x", "late"])[4:] == [("subtask-test-new", ["new"], "search"), ("subtask-test-x", ["x"], "search")]


def test_upkeep_keeps_other_rows(spark):
    rows = spark.createDataFrame([(1, True), (2, True), (3, False), (None, True)], "id long, pending_sync boolean")
    done = spark.createDataFrame([(1,), (1,), (None,), (9,)], "id long")
    assert sorted(map(repr, (tuple(r) for r in memory.mark_synced(rows, done).collect()))) == ["(1, False)", "(2, True)", "(3, False)", "(None, True)"]
    assert memory.pending(rows).count() == 3 and found(memory.without(rows.where("id is not null"), done, "id"), "id") == [(2,), (3,)]
    runs = spark.createDataFrame([("k", i, f) for i, f in enumerate((5, 3, 3, 1))], "k string, i int, failed int")
    assert [r["stop"] for r in context.stagnant(runs, "k", "i", "failed").orderBy("i").collect()] == [False, False, True, True]
    urls = spark.createDataFrame([("https://github.com/a/b",), ("http://github.com/a/b",), ("https://github.com.evil/a/b",), ("https://github.com/a",), (None,)], "u string")
    assert [r[0] for r in urls.select(memory.valid_url(F.col("u"))).collect()] == [True, False, False, False, False]


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


GRAPH = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d|pipeline", n))


@pytest.mark.parametrize("name", GRAPH)
def test_against_duckdb(spark, sf, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = entry.queries()[name](spark, sf), c.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    pick = [want.columns.index(x) for x in columns]
    rows = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert rows == sorted(map(repr, (tuple(r[i] for i in pick) for r in want.fetchall())))


def test_paths_by_a_hub_against_brute_force(spark):
    edges = [(0, 1, "calls"), *((1, i, "calls") for i in range(2, 60)), (7, 100, "imports"), (7, 100, "calls"), (100, 101, "calls"), (1, 0, "calls"), (0, 100, "calls"), (2, 2, "calls"), (2, 101, "calls")]
    starts, ends = [0, 1, 7], [100, 101, 2]
    walks = [[e] for e in edges if e[0] in starts]
    want = []
    for _ in range(2):
        walks = [w + [e] for w in walks for e in edges if e[0] == w[-1][1] and e not in w]
        want += [(w[0][0], ">".join(str(n) for n in (w[0][0], *(e[1] for e in w))), ">".join(e[2] for e in w)) for w in walks if w[-1][1] in ends]
    keys = lambda x: spark.createDataFrame([(k,) for k in x], "key long")
    got = traversal.paths(spark.createDataFrame(edges, "src long, dst long, relation string"), keys(starts), keys(ends), 1000)
    assert sorted((r["start"], r["path_text"], r["relation_text"]) for r in got.collect()) == sorted(want) and want


def test_context_joins_the_texts_of_what_is_near(spark, sf, monkeypatch):
    """Texts are chosen by key where the tables are read, and not moved; beyond FEW keys the rows are the same."""
    from skeinwork.operators import docs, traversal
    from skeinwork.sources import tables
    from skeinwork.sources.stored import graph

    g = graph(spark, sf)
    texts = tables.descriptions(spark, sf), tables.component_docs(spark, sf), tables.architecture(spark, sf)
    found = docs.context(g.nodes, g.outgoing, *texts, "brand", "r1")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(found.collect(), key=repr)
    # each reading of documents is by keys, whether or not any is left after pruning
    scans = [x for x in plan.splitlines() if "Filter" in x and "doc_id" in x]
    assert scans and all("IN (" in x or "INSET" in x or "doc_id" in x and " = " in x for x in scans), plan
    monkeypatch.setattr(traversal, "FEW", 0)
    assert sorted(docs.context(g.nodes, g.outgoing, *texts, "brand", "r1").collect(), key=repr) == rows and len(rows) > 2


def test_impact_of_hubs_and_strangers(spark, monkeypatch):
    """Impacts against a walk by hand: callers that are no symbols, lists that end before, in and after the last level, long lists in parts, copies of edges."""
    import random
    from collections import defaultdict

    from skeinwork.operators import traversal

    monkeypatch.setattr(traversal, "LISTED", 7)
    rng = random.Random(8)
    calls = [(rng.randrange(90), rng.randrange(90)) for _ in range(150)] + [(i, 200) for i in range(100, 160)] + [(i, 100) for i in range(160, 190)] + [(201, 202), (202, 203), (203, 201), (205, 205), (1, 2), (1, 2), (300, 3), (4, 300)]
    symbols = [i for i in range(210) if i % 13 != 5]
    info = {i: (f"x:{i % 7}:{i}", f"n{i % 9}", "function", ("tests/" if i % 4 == 0 else "src/") + str(i)) for i in symbols}
    nodes = spark.createDataFrame([(i, *info[i]) for i in symbols], "key long, id string, name string, kind string, filepath string")
    edges = spark.createDataFrame([(a, b, "calls") for a, b in calls] + [(1, 200, "imports")], "src long, dst long, relation string")
    into = defaultdict(set)
    for a, b in calls:
        into[b].add(a)
    for depth in (1, 2, 3):
        got = {r["key"]: r for r in traversal.impact(nodes, edges, nodes.union(nodes.where("key = 3")), depth).collect()}
        assert set(got) == set(symbols)
        for root in symbols:
            level, at = {}, {root}
            for d in range(1, depth + 1):
                at = {x for y in at for x in into[y]} - {root}
                for x in at:
                    level.setdefault(x, d)
            items = sorted((a, info[x][1], info[x][0], x) for x, d in level.items() if x in info for a in range(d, depth + 1))
            test = lambda x: "test" in info[x][3]
            r = got[root]
            ids = lambda c: [(x["at"], x["node_id"]) for x in r[c]]  # noqa: E731, B023
            assert (r["direct_callers_count"], r["total_callers_count"]) == (sum(a == 1 for a, *_ in items), len(items)), root
            assert ids("all_callers") == [(a, i) for a, _, i, _ in items][:50]
            assert ids("test_files") == [(a, i) for a, _, i, x in items if test(x)][:20]
            assert ids("direct_dependents") == [(a, i) for a, _, i, x in items if a == 1 and not test(x)][:20]


def test_impact_doesnt_name_the_last_level(spark):
    """Callers that fill no list are counted without their names: 64,000 of them, of 100 bytes or more each."""
    from skeinwork.operators import traversal
    from skeinwork.sources.stored import put

    ids = spark.range(1, 40 + 1600 + 64_000 + 1)
    nodes = put(ids.union(spark.range(0, 1)).selectExpr("id AS key", "concat('tests/', sha2(cast(id AS string), 256)) AS id", "md5(cast(id AS string)) AS name", "'class' AS kind", "concat('tests/', md5(cast(id * 7 AS string))) AS filepath"), "key", 2)
    edges = put(ids.selectExpr("id AS src", "cast((id - 1) div 40 AS long) AS dst", "'calls' AS relation"), "src", 2)
    incoming = put(edges, "dst", 2)
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        found = store.stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = max(stages())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # rows of a graph that is too large for copies
    try:
        r = traversal.impact(nodes, edges, nodes.where("key = 0"), incoming=incoming).collect()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(n for i, n in stages().items() if i > before)
    assert (r["direct_callers_count"], r["total_callers_count"], len(r["all_callers"]), len(r["test_files"])) == (40, 3 * 40 + 2 * 1600 + 64_000, 50, 20)
    assert moved < 4_000_000, moved
