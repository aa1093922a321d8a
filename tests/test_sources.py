"""Source trees, parsers and streams."""

import datetime as dt

from pyspark.sql import functions as F

from skeinwork.functions import parsers
from skeinwork.operators import analysis
from skeinwork.sources import files
from skeinwork.sources.tables import table
from skeinwork.streaming import twins

PYTHON = '''"""Doc."""
import os.path as p
from a.b import c

@wraps(c)
class A(B, m.C):
    """A class."""
    x: int = 1

    async def f(self, a, /, b=2, *, k=3, **kw) -> int:
        return g(self.h(a))

def g(n):
    return g(n - 1) + len(n)
'''

SAMPLES = {
    "typescript": ("m.ts", "import {a} from './lib';\nexport class Dog extends Animal {\n  bark(n: number): void {\n    speak(n);\n  }\n}\nfunction speak(n) {\n  console.log(n);\n}\nexport const add = (a, b) => a + b;\n", {("class", "Dog"), ("method", "bark"), ("function", "speak"), ("function", "add"), ("import", "./lib")}),
    "go": ("m.go", 'package m\nimport "fmt"\ntype T struct {\n}\nfunc (t T) Run(n int) {\n\tfmt.Println(n)\n}\n', {("class", "T"), ("function", "Run"), ("import", "fmt")}),
    "rust": ("m.rs", "use std::io;\nstruct S {\n}\nfn run(n: i32) -> i32 {\n    helper(n)\n}\n", {("class", "S"), ("function", "run"), ("import", "std::io")}),
    "java": ("M.java", "import java.util.List;\npublic class M extends Base {\n    public int size(int n) {\n        return count(n);\n    }\n}\n", {("class", "M"), ("method", "size"), ("import", "java.util.List")}),
    "csharp": ("M.cs", "using System;\npublic class M : Base {\n    public int Size(int n) {\n        return Count(n);\n    }\n}\n", {("class", "M"), ("method", "Size"), ("import", "System")}),
    "kotlin": ("M.kt", "import a.b.C\nclass M : Base() {\n    fun size(n: Int): Int {\n        return count(n)\n    }\n}\n", {("class", "M"), ("method", "size"), ("import", "a.b.C")}),
    "ruby": ("m.rb", "require 'json'\nclass M < Base\n  def size(n)\n    count(n)\n  end\nend\n", {("class", "M"), ("method", "size"), ("import", "json")}),
    "php": ("m.php", "<?php\nuse A\\B;\nclass M extends Base {\n  public function size($n) {\n    return count($n);\n  }\n}\n", {("class", "M"), ("method", "size"), ("import", "A\\B")}),
    "swift": ("m.swift", "import Foundation\nclass M: Base {\n    func size(n: Int) -> Int {\n        return count(n)\n    }\n}\n", {("class", "M"), ("method", "size"), ("import", "Foundation")}),
    "cpp": ("m.cpp", '#include "m.h"\nclass M : public Base {\npublic:\n  int size(int n) {\n    return count(n);\n  }\n};\n', {("class", "M"), ("method", "size"), ("import", "m.h")}),
}


def test_python_records():
    rows = parsers.parse_python("src/m.py", PYTHON, "r")
    names = {(r["kind"], r["name"]) for r in rows if r["rec_type"] == "node"}
    assert names == {("module", "m"), ("import", "p"), ("import", "c"), ("class", "A"), ("method", "f"), ("function", "g"), ("variable", "x"), ("decorator", "wraps")}
    by = {r["name"]: r for r in rows if r["rec_type"] == "node"}
    assert by["f"]["signature"] == "async def f(self, a, /, b=..., *, k=..., **kw) -> int" and by["A"]["docstring"] == "A class." and by["c"]["docstring"] == "a.b.c"
    edges = {(r["source_id"], r["target_id"], r["relation"]) for r in rows if r["rec_type"] == "edge"}
    i = lambda k, n: f"r:src/m.py:{k}:{n}"
    assert {(i("class", "A"), i("class", "B"), "inherits"), (i("class", "A"), i("class", "C"), "inherits"), (i("method", "f"), i("function", "g"), "calls"), (i("function", "g"), i("function", "len"), "calls"), (i("decorator", "wraps"), i("class", "A"), "decorates"), (i("class", "A"), i("method", "f"), "contains")} <= edges
    assert (i("function", "g"), i("function", "g"), "calls") not in edges
    assert parsers.parse_python("x.py", "def broken(", "r") == []


def test_other_languages():
    for language, (path, source, want) in SAMPLES.items():
        got = {(r["kind"], r["name"]) for r in parsers.PARSERS[language](path, source, "r") if r["rec_type"] == "node"}
        assert want <= got, (language, want - got)
    calls = {(r["source_id"].rsplit(":", 1)[1], r["target_id"].rsplit(":", 1)[1]) for r in parsers.PARSERS["java"](*SAMPLES["java"][:2], "r") if r.get("relation") == "calls"}
    assert calls == {("size", "count")}


def test_source_tree(spark, tmp_path):
    for name, text in {"a/m.py": PYTHON, "a/n.GO": "package n\n", "node_modules/x.py": "x = 1", ".git/y.py": "y = 1", "a/readme.md": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "a" / "bad.py").write_bytes(b"x = 1 # \xff\n")
    got = files.source_files(spark, str(tmp_path))
    assert sorted(r["filepath"] for r in got.collect()) == ["a/bad.py", "a/m.py", "a/n.GO"]
    records = parsers.parse_files(got, "r")
    assert records.where("rec_type = 'node' and kind = 'class'").count() == 1


def test_diff_and_log_lines(spark, tmp_path):
    diff = "--- a/x.py\n+++ b/x.py\n@@\n-old\n+import os\n+def f():\n"
    df = spark.createDataFrame([(1, diff), (2, "")], "id int, patch string")
    assert sorted((r["kind"], r["value"]) for r in files.diff_lines(df, "id", "patch").collect()) == [("added", "def f():"), ("added", "import os"), ("file", "x.py")]
    (tmp_path / "2024-01-02.md").write_text("one\ntwo\n")
    assert {(r["date"], r["value"]) for r in files.log_lines(spark, str(tmp_path)).collect()} == {("2024-01-02", "one"), ("2024-01-02", "two")}


def test_sessions_stream_is_the_batch(spark, sf, tmp_path):
    batch = table(spark, sf, "events")
    source = tmp_path / "events"
    batch.write.parquet(str(source))
    stream = twins.sessions(twins.events(spark, str(source), batch.schema.simpleString()[7:-1].replace(":", " ")))
    got = twins.drained(stream, "sessions_out", "complete", str(tmp_path / "c"))
    want = analysis.sessions(batch)
    key = lambda df: sorted((r["user_id"], str(r["session_start"]), r["n"]) for r in df.collect())
    assert key(got) == key(want)


def test_breaker_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    oks = [(0, False), (1, False), (2, False), (3, True), (40, False), (41, True), (80, True), (81, False)]
    rows = [("s", t0 + dt.timedelta(seconds=s), ok) for s, ok in oks]
    spark.createDataFrame(rows, "service string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("service string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    got = twins.drained(twins.breaker(stream), "breaker_out", "append", str(tmp_path / "c"))
    assert [((r["ts"] - t0).seconds, r["state"]) for r in got.orderBy("ts").collect()] == [(2, "open"), (40, "open"), (80, "closed")]


def test_incremental_stream_takes_what_changed(spark, tmp_path):
    put = lambda rows, n: spark.createDataFrame(rows, "url string, h string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: twins.incremental(spark.readStream.schema("url string, h string").parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "c"), "url", "h").awaitTermination()
    put([("a", "1"), ("b", "1")], 0)
    run()
    put([("a", "2"), ("b", "1"), ("c", "1")], 1)
    run()
    assert sorted((r["url"], r["h"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [("a", "1", 0), ("a", "2", 1), ("b", "1", 0), ("c", "1", 1)]


TS = '''// about dogs
// and cats
@Component
export class Dog extends Animal {
  private x = 1;
  /* barks
     loudly */
  bark(n: number): void {
    const s = "class Fake { run() }";
    // helper(n)
    speak(n); this.log(s);
  }
}
const limit = 5;
import { a } from './lib';
'''

KOTLIN = '''import a.b.C
@Test
class M : Base() {
    val size = 3
    fun one() = helper(1)
    fun two(n: Int): Int {
        return count(n)
    }
}
'''

RUBY = '''require 'json'
# a store
class Store < Base
  def put(x)
    if x
      save(x)
    end
  end
  def get
    "def fake; end"
  end
end
'''

C = '''#include "m.h"
/* class Old { */
class M : public Base {
public:
  int size(int n) {
    return count("}", n);
  }
};
int main(int argc)
{
  return run(argc);
}
'''


def node_of(rows):
    return {(r["kind"], r["name"]): r for r in rows if r["rec_type"] == "node"}


def calls_of(rows):
    return {(r["source_id"].rsplit(":", 1)[1], r["target_id"].rsplit(":", 1)[1]) for r in rows if r.get("relation") == "calls"}


def test_extents_comments_and_texts():
    rows = parsers.PARSERS["typescript"]("m.ts", TS, "r")
    n = node_of(rows)
    assert set(n) == {("module", "m"), ("class", "Dog"), ("method", "bark"), ("variable", "s"), ("variable", "limit"), ("decorator", "Component"), ("import", "./lib")}
    assert (n["class", "Dog"]["start_line"], n["class", "Dog"]["end_line"], n["method", "bark"]["end_line"]) == (4, 13, 12)
    assert n["class", "Dog"]["docstring"] == "// about dogs\n// and cats" and n["method", "bark"]["docstring"].startswith("/* barks") and n["class", "Dog"]["source_text"].startswith("export class") and n["class", "Dog"]["source_text"].endswith("}")
    assert calls_of(rows) == {("bark", "speak"), ("bark", "log")}
    edges = {(r["source_id"], r["target_id"], r["relation"]) for r in rows if r["rec_type"] == "edge"}
    lib = "r:m.ts:import:./lib"
    assert {(lib, lib, "imports"), ("r:m.ts:module:m", lib, "contains"), ("r:m.ts:decorator:Component", "r:m.ts:class:Dog", "decorates"), ("r:m.ts:class:Dog", "r:m.ts:class:Animal", "inherits")} <= edges

    rows = parsers.PARSERS["kotlin"]("m.kt", KOTLIN, "r")
    n = node_of(rows)
    assert {("class", "M"), ("method", "one"), ("method", "two"), ("variable", "size"), ("decorator", "Test"), ("import", "a.b.C")} <= set(n)
    assert (n["method", "one"]["end_line"], n["method", "two"]["end_line"], n["class", "M"]["end_line"]) == (5, 8, 9) and ("two", "count") in calls_of(rows)

    rows = parsers.PARSERS["ruby"]("m.rb", RUBY, "r")
    n = node_of(rows)
    assert set(n) == {("module", "m"), ("class", "Store"), ("method", "put"), ("method", "get"), ("import", "json")}
    assert (n["class", "Store"]["end_line"], n["method", "put"]["end_line"], n["class", "Store"]["docstring"]) == (12, 8, "# a store") and calls_of(rows) == {("put", "save")}

    rows = parsers.PARSERS["cpp"]("m.cpp", C, "r")
    n = node_of(rows)
    assert set(n) == {("module", "m"), ("class", "M"), ("method", "size"), ("function", "main"), ("import", "m.h")}
    assert (n["method", "size"]["end_line"], n["class", "M"]["end_line"], n["function", "main"]["end_line"]) == (7, 8, 12) and calls_of(rows) == {("size", "count"), ("main", "run")}


def test_python_variables_are_plain_names():
    rows = parsers.parse_python("m.py", "x = 1\na[i] = 2\np, q = 1, 2\ny: int = 3\nclass A:\n    def f(self):\n        self.z = 1\n        w = 2\nmatch x:\n    case 1:\n        def g():\n            v = 1\n", "r")
    n = node_of(rows)
    assert {k for kind, k in n if kind == "variable"} == {"x", "y", "w", "v"} and ("function", "g") in n


def test_registry(spark):
    import pytest

    r = parsers.default_registry()
    assert r.parser("a/B.PY") is parsers.parse_python and r.parser("a.unknown") is None and r.parser("dir.py/file") is None
    with pytest.raises(RuntimeError):
        r.register("x", (".x",), parsers.parse_python)
    own = parsers.Registry()
    own.register("x", (".X",), lambda path, source, repo: [{"rec_type": "node", "seq": 0, "id": path, "kind": "module", "name": source}])
    with pytest.raises(ValueError):
        own.register("y", (".x",), parsers.parse_python)
    rows = spark.createDataFrame([("a.x", "x", "hello"), ("b.py", "python", "x = 1")], "filepath string, language string, source string")
    assert [(r["id"], r["name"]) for r in parsers.parse_files(rows, "r", own.freeze()).collect()] == [("a.x", "hello")]


def test_repository_links_imports_across_files(spark):
    rows = spark.createDataFrame([("a.py", "python", "from b import helper\n"), ("b.py", "python", "def helper():\n    pass\n")], "filepath string, language string, source string")
    nodes, edges = parsers.parse_repository(rows, "r")
    assert ("r:a.py:import:helper", "r:b.py:function:helper", "imports") in {tuple(r) for r in edges.collect()} and nodes.count() == 4


def test_languages_git_and_sinks(spark, tmp_path):
    import subprocess

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("x = 1\n")
    (tmp_path / "t" / "b.go").write_text("package b\n")
    assert [r["filepath"] for r in files.source_files(spark, str(tmp_path / "t"), ("python",)).collect()] == ["a.py"]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "t"), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    assert files.git_changes(spark, str(tmp_path / "t")).count() == 0
    git("init", "-q"), git("add", "a.py"), git("commit", "-qm", "one")
    (tmp_path / "t" / "a.py").write_text("x = 2\n")
    assert sorted(r["path"] for r in files.git_changes(spark, str(tmp_path / "t")).collect()) == ["a.py", "b.go"]
    df = spark.createDataFrame([(0, "first {", "a"), (1, "b", None), (1, "a", "c"), (2, "}", "d")], "part int, line string, _s string")
    files.write_lines(df, str(tmp_path / "text"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part-*"))) == "first {\na\nb\n}\n"
    files.write_cold(df, "kind", str(tmp_path / "cold"))
    assert files.json_rows(spark, str(tmp_path / "cold" / "kind"), "part int, line string, _s string").where("_s is null").count() > 0
    files.write_csv(df.drop("_s"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_changes_stream_is_in_order(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "k string, v string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "2", 2), ("a", "1", 1), ("a", "2", 3), ("b", "x", 1)])
    s = twins.changes(spark.readStream.schema("k string, v string, n int").parquet(str(tmp_path / "in")), "k", "v", "n")
    got = twins.drained(s, "changes_out", "append", str(tmp_path / "c"))
    assert sorted((r["k"], r["v"], r["n"]) for r in got.collect()) == [("a", "1", 1), ("a", "2", 2), ("b", "x", 1)]


def test_stored_graph_reads_one_bucket(spark, sf):
    from skeinwork.operators import traversal
    from skeinwork.sources import stored

    g = stored.graph(spark, sf)
    assert g is stored.graph(spark, sf)
    plan = g.incoming.where("relation = 'calls' and dst = 42")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(relation" in plan
    e = spark.range(500_000).selectExpr("id AS src", "id + 1 AS dst", "'calls' AS relation")
    big = stored.StoredGraph(spark.range(10).selectExpr("id AS key"), e, 10, 500_000)
    # files of other buckets aren't opened, whether the scan keeps its buckets for a join or not
    read = big.incoming.where("dst = 42").select("src", F.col("_metadata.file_name").alias("f"), F.lit(1))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    plan = big.incoming.where("dst = 42")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 3" in plan and read.count() == 1
    # and a frontier's join moves the frontier alone
    frontier = spark.range(100).selectExpr("id AS dst").repartition(5).hint("merge")
    plan = big.incoming.join(frontier, "dst")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan.replace("bucketed: true", "Bucketed: true") or plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in traversal.around([traversal.backward(big.incoming)], traversal.one(big.incoming, 42), 3).where('depth > 0').collect()) == [(39, 3), (40, 2), (41, 1)]


def test_files_are_dealt_over_tasks(spark):
    """Files of one small partition are parsed by many tasks; segments are those of ast."""
    import ast

    from skeinwork.functions import parsers

    source = "import a\r\nclass É(B):\n    x = 'é'; y = 1\n    def f(self, a=1, *, b=2):\n        return g(\n            'ü')\n"
    files = spark.range(0, 3500, 1, 1).selectExpr("concat('m', id, '.py') AS filepath", "'python' AS language", "'v = 1' AS source")
    found = parsers.parse_files(files, "r")
    assert found.rdd.getNumPartitions() == 4 and found.where("rec_type = 'node'").count() == 7000
    rows = {r["id"]: r for r in parsers.parse_python("m.py", source, "r") if r["rec_type"] == "node"}
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, (ast.ClassDef, ast.FunctionDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "method"
            assert rows[f"r:m.py:{kind}:{n.name}"]["source_text"] == ast.get_source_segment(source, n)
    assert rows["r:m.py:method:f"]["signature"] == "def f(self, a=..., *, b=...)"


def test_edges_are_stored_once(spark):
    """Copies of an edge go in its bucket, with no exchange of their own."""
    from skeinwork.sources.stored import StoredGraph

    edges = spark.createDataFrame([(1, 2, "calls"), (1, 2, "calls"), (1, 2, "imports"), (2, 1, "calls")], "src long, dst long, relation string")
    g = StoredGraph(spark.createDataFrame([(1,), (2,)], "key long"), edges, 2, 500_000)
    want = [(1, 2, "calls"), (1, 2, "imports"), (2, 1, "calls")]
    assert sorted(map(tuple, g.outgoing.select("src", "dst", "relation").collect())) == want == sorted(map(tuple, g.incoming.select("src", "dst", "relation").collect()))
