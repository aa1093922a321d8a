"""Timers, sketches, the text index, data source and table function."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import memory, relational, search
from skeinwork.operators.sketches import impact_of_all, reach_counts
from skeinwork.operators.text_index import text_index
from skeinwork.sources import extensions
from skeinwork.sources.stored import graph
from skeinwork.streaming import timers

T0 = datetime(2024, 1, 1)


def written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def drained(spark, stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start(str(out))
    q.awaitTermination()
    return spark.read.parquet(str(out))


def test_a_breaker_opens_half_way_without_an_event(spark, tmp_path):
    """Service a opens and hears nothing more; the other's events move the watermark. The second half comes after a restart from the checkpoint."""
    timers.with_timers(spark)
    schema = "service string, ts timestamp, ok boolean"
    source = str(tmp_path / "in")
    run = lambda: drained(spark, timers.breaker(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), tmp_path / "out", tmp_path / "c")
    at = lambda s: T0 + timedelta(seconds=s)
    written(spark, source, [("a", at(s), False) for s in (1, 2, 3)] + [("b", at(0), True)], schema)
    got = sorted((r["service"], r["ts"], r["state"]) for r in run().collect())
    assert got == [("a", at(3), "open")]
    written(spark, source, [("b", at(60), True)], schema)
    written(spark, source, [("b", at(61), True)], schema)
    got = sorted((r["service"], r["ts"], r["state"]) for r in run().collect())
    assert got == [("a", at(3), "open"), ("a", at(33), "half_open")]
    # a probe that fails opens it again; what comes before it is half open is refused; then one closes it
    written(spark, source, [("a", at(70), False), ("a", at(80), True), ("a", at(101), True)], schema)
    got = sorted((r["ts"], r["state"]) for r in run().collect())
    assert got == [(at(3), "open"), (at(33), "half_open"), (at(70), "open"), (at(100), "half_open"), (at(101), "closed")]


def test_sessions_end_without_an_event(spark, tmp_path):
    timers.with_timers(spark)
    rng, schema, source = random.Random(2), "user_id long, ts timestamp", str(tmp_path / "in")
    rows = [(u, T0 + timedelta(minutes=rng.randrange(1200))) for u in range(5) for _ in range(25)]
    rows.sort(key=lambda r: (r[1] + timedelta(minutes=rng.randrange(50))))  # out of order by less than the watermark waits
    for i in range(0, len(rows), 25):
        written(spark, source, rows[i : i + 25], schema)
    written(spark, source, [(99, T0 + timedelta(days=3))], schema)  # another user's event ends them all
    got = drained(spark, timers.sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 30, "2 hours"), tmp_path / "out", tmp_path / "c")
    want = []
    by = defaultdict(list)
    for u, ts in rows:
        by[u].append(ts)
    for u, found in by.items():
        for ts in sorted(found):
            if want and want[-1][0] == u and ts < want[-1][2] + timedelta(minutes=30):
                want[-1] = (u, want[-1][1], ts, want[-1][3] + 1)
            else:
                want.append((u, ts, ts, 1))
    assert sorted((r["user_id"], r["session_start"], r["session_end"], r["n"]) for r in got.collect()) == sorted(want)


def test_sketches_count_who_reaches_a_symbol(spark):
    """Against exact sets: small counts are exact, larger ones within 5 %."""
    rng = random.Random(8)
    pairs = {(rng.randrange(3000), rng.randrange(3000)) for _ in range(12000)} | {(i, 0) for i in range(1, 2000)}
    into = defaultdict(set)
    for a, b in pairs:
        if a != b:
            into[b].add(a)
    df = spark.createDataFrame([(*p, "calls") for p in pairs], "src long, dst long, relation string")
    rows = reach_counts(df).collect()
    worst = 0.0
    assert len(rows) == len({x for a, b in pairs if a != b for x in (a, b)})
    for r in rows:
        known = {r["key"]}
        for level in (1, 2, 3):
            known |= {a for n in known for a in into[n]}
            n, got = len(known) - 1, r[f"within_{level}"]
            assert got == n or n > 300
            worst = max(worst, abs(got - n) / max(n, 1))
    print("largest error of a sketch", round(worst, 4))
    assert worst < 0.08


def test_impact_of_all_is_impact(spark, sf):
    g = graph(spark, sf)
    some = g.outgoing.where("relation = 'calls' AND (src + dst) % 5 = 0")
    from skeinwork.operators.traversal import impact

    names = ["key", "direct_callers_count", "total_callers_count", "direct_callees_count", "risk_score", "risk_label"]
    want = {tuple(r) for r in impact(g.nodes, some, g.nodes).select(names).collect()}
    assert {tuple(r) for r in impact_of_all(g.nodes, some).select(names).collect()} == want


def test_text_index_is_a_scan(spark, sf):
    g = graph(spark, sf)
    n = g.nodes.select("id", "key", "name", "docstring", "filepath", "source_text", "repo_id", "kind")
    index = text_index(n, "id", "name", "docstring", "filepath", "source_text")
    for term in ("RING", "part_1", "blue", "in", "zzz", "brand7/large", "é"):
        assert relational.keyword_search(index.holding(term), term, 10**6).collect() == relational.keyword_search(n, term, 10**6).collect()
        assert search.source_search(index.holding(term), term, "r1", 10**6).collect() == search.source_search(n, term, "r1", 10**6).collect()
    assert relational.word_search(index.holding("blue", "bolt", every=False), "a blue bolt is", 10**6).collect() == relational.word_search(n, "a blue bolt is", 10**6).collect()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    plan = index.postings.where(F.col("gram").isin(["rin", "ing"]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount" in plan and "PushedFilters: [In(gram" in plan


def test_text_index_of_odd_rows(spark, monkeypatch):
    from skeinwork.operators import text_index as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 3)
    monkeypatch.setattr(module, "PIECE", 5)
    texts = [None, "", "ab", "abc", "ABCABC", "x" * 50, "a\nbc d", "Straße ÄÖÜ", "\U0001f600\U0001f600\U0001f600 z", "hello world", "hello", "world"]
    df = spark.createDataFrame([(f"k{i}", x, str(i)) for i, x in enumerate(texts)], "id string, data string, other string")
    index = text_index(df, "id", "data", "other")
    for term in ("abc", "bca", "hello w", "ÄÖ", "äöü", "\U0001f600\U0001f600\U0001f600", "xxxxxxxxxx", "a\nb", "lo wor", "", "zq", "nothing"):
        found = {r["id"] for r in index.holding(term).where(F.lower("data").contains(term.lower())).collect()}
        assert found == {f"k{i}" for i, x in enumerate(texts) if x is not None and term.lower() in x.lower()}, term
    assert {r["id"] for r in index.holding("hello", "world").collect()} == {"k9"}
    assert text_index(df.limit(0), "id", "data").holding("abc").count() == 0


def stages_of(spark):
    """Stages so far, by id: the bytes that they have written for others."""
    jvm, sc = spark._jvm, spark.sparkContext
    store = sc._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_text_index_moves_lists_not_trigrams(spark):
    """A trigram of a row costs some bits when the index is built, not a row of its own."""
    rows = spark.range(40_000).selectExpr("concat('d', id) AS id", "concat('ship order ', id, ' as 1-urgent, of segment_', id % 25) AS data").repartition(4)
    rows.count()
    before = max(stages_of(spark))
    index = text_index(rows, "id", "data")
    moved = sum(n for i, n in stages_of(spark).items() if i > before)
    assert [r["id"] for r in index.holding("39999", "urgent").where(F.col("data").contains("39999")).collect()] == ["d39999"]
    assert 0 < moved < 40_000 * 100, moved  # the row itself and its 45 trigrams


def test_lists_of_numbers():
    from skeinwork.operators.text_index import _cut, _listed, _lists, _mask

    rng = random.Random(3)
    for rows in (1, 9, 70, 5_000, 70_000):
        for n in {1, rows // 50 + 1, rows // 2 + 1, rows}:
            at = sorted(rng.sample(range(rows), n))
            assert np.flatnonzero(_mask([_listed(np.array(at), rows)], rows + 64)).tolist() == at
    assert len(_listed(np.arange(7, 30_000, 3), 30_000)) < 4_000 and len(_listed(np.array([29_999]), 30_000)) == 3
    # more letters than a number of 64 bits has room for with their rows; a text that is cut into pieces; rows that are out of order
    many = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.sample(many, 20_000)) for _ in range(40)]
    got = _lists(5, list(range(40)), texts).to_pylist()
    want = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 2):
            want.setdefault(t[k : k + 3], set()).add(i)
    assert {x["gram"]: set(np.flatnonzero(_mask([x["held"]], 64)).tolist()) for x in got} == want
    batch = pa.RecordBatch.from_pylist([{"b": 1, "i": 3, "t": "abcdefgh"}, {"b": 1, "i": 2, "t": "cdx"}, {"b": 2, "i": 0, "t": "abc"}, {"b": 2, "i": 1, "t": "ab"}])
    found = [(x["_block"], x["gram"], i) for piece in _cut(iter([batch]), 2) for x in piece.to_pylist() for i in np.flatnonzero(_mask([x["held"]], 64)).tolist()]
    assert sorted(found) == [(1, "abc", 3), (1, "bcd", 3), (1, "cde", 3), (1, "cdx", 2), (1, "def", 3), (1, "efg", 3), (1, "fgh", 3), (2, "abc", 0)]


def test_memory_search_by_the_index(spark, sf):
    rows = spark.createDataFrame([(f"d{i}", "r", f"2024-01-{i % 28 + 1:02}", f"use the {'shared ' if i % 3 else ''}pool number {i}", f"s{i}") for i in range(60)], "id string, repo_id string, updated_at string, data string, summary string")
    index = text_index(rows, "id", "data")
    for query in ("shared pool", "POOL 5", "number", "no such"):
        assert memory.found({"decision": index.holding(*query.lower().split())}, query).collect() == memory.found({"decision": rows}, query).collect()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "pkg/a.py").write_text("def f():\n    return g()\n")
    (root / "b.go").write_text("package b\nfunc Run() {\n}\n")
    (root / "notes.txt").write_text("no source")
    (root / ".git/x.py").write_text("hidden = 1")
    return root


def test_parse_from_sql(spark, tree):
    extensions.register(spark)
    spark.read.format("source_tree").load(str(tree)).createOrReplaceTempView("files")
    assert {(r["filepath"], r["language"], r["status"]) for r in spark.table("files").collect()} == {("pkg/a.py", "python", "new"), ("b.go", "go", "new")}
    got = spark.sql("SELECT kind, name FROM parse_source(TABLE(files), 'repo') WHERE rec_type = 'node'").collect()
    assert {tuple(r) for r in got} == {("module", "a"), ("function", "f"), ("module", "b"), ("function", "Run")}
    assert spark.sql("SELECT source_id, target_id FROM parse_source(TABLE(files), 'repo') WHERE relation = 'calls'").collect() == [("repo:pkg/a.py:function:f", "repo:pkg/a.py:function:g")]


def test_a_deleted_file_is_in_the_stream(spark, tree, tmp_path):
    extensions.register(spark)

    def run():
        stream = spark.readStream.format("source_tree").option("snapshots", str(tmp_path / "snapshots")).load(str(tree)).select("filepath", "status", F.length("source").alias("n"))
        before = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} - before

    assert run() == {("pkg/a.py", "new", 24), ("b.go", "new", 25)}
    (tree / "b.go").unlink()
    (tree / "pkg/a.py").write_text("x = 1\n")
    (tree / "c.py").write_text("y = 2\n")
    assert run() == {("b.go", "deleted", None), ("pkg/a.py", "changed", 6), ("c.py", "new", 6)}
    assert run() == set()


def test_a_sketch_goes_once_to_a_block(spark):
    """What a step moves is bounded by nodes and the blocks that they lead to: rows sent are fewer than edges by far where keys near each other belong together."""
    from skeinwork.operators import sketches

    rng = random.Random(3)
    pairs = {(c * 1000 + rng.randrange(1000), c * 1000 + rng.randrange(1000)) for c in range(8) for _ in range(12000)}
    df = spark.createDataFrame([*pairs], "src long, dst long")
    into = defaultdict(set)
    for a, b in pairs:
        if a != b:
            into[b].add(a)
    met = []
    real = sketches.cut

    def watched(x):
        met.append(real(x))
        return met[-1]

    sketches.cut = watched
    try:
        rows = {r["key"]: r for r in reach_counts(df, 2).collect()}
    finally:
        sketches.cut = real
    leads = met[-1]
    assert leads.count() < len(pairs) / 3 and leads.agg({"b": "max"}).first()[0] > 0
    for n in (0, 999, 1000, 4500, 7999):
        near = into[n] | {a for m in into[n] for a in into[m]}
        assert rows[n]["within_1"] == len(into[n]) and rows[n]["within_2"] == len(near - {n})


def test_lists_give_way_to_registers(spark):
    """513 callers are a count from registers, 511 one from a list; a chain of empty levels and a hub are right as well."""
    pairs = [(i, 100000) for i in range(511)] + [(i, 100001) for i in range(2000)] + [(100000, 100002), (100001, 100002), (100002, 100003)]
    got = {r["key"]: tuple(r)[1:] for r in reach_counts(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got[0] == (0, 0, 0) and got[100000] == (511, 511, 511) and got[100002][0] == 2
    assert all(abs(got[100001][k] - 2000) < 100 and abs(got[100002][max(k, 1)] - 2002) < 100 for k in range(3))


def test_what_sketches_move_is_small(spark):
    """Bytes that are shuffled for copies of a graph whose keys lie between each other, and counts against sets."""
    rng = random.Random(12)
    copies, size = 8, 2500
    pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(8 * size)]
    df = spark.createDataFrame([(a * copies + c, b * copies + c) for a, b in pairs for c in range(copies)], "src long, dst long")
    into = defaultdict(set)
    for a, b in pairs:
        if a != b:
            into[b].add(a)
    written = lambda: sum(x.totalShuffleWrite() for x in _seq(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    rows = {r["key"]: tuple(r)[1:] for r in reach_counts(df).collect()}
    moved = written() - before
    print("MB shuffled", moved / 1e6)
    assert moved < 30e6
    for n in (0, 7, 1234, size - 1):
        known = {n}
        for level in range(3):
            known |= {a for m in known for a in into[m]}
            want = len(known) - 1
            assert all(abs(rows[n * copies + c][level] - want) <= (0 if want <= 512 else 0.08 * want) for c in range(copies))


def _seq(found):
    return [found.apply(i) for i in range(found.size())]


def test_as_many_as_are_listed_are_exact(spark):
    """512 callers are a count from a list as well: the list also has the node itself, which isn't counted."""
    pairs = [(i, 10000 + c) for c in range(4) for i in range(509 + c)]
    got = {r["key"]: tuple(r)[1:] for r in reach_counts(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert [got[10000 + c] for c in range(4)] == [(n, n, n) for n in (509, 510, 511, 512)]


def test_risks_of_all_are_exact(spark):
    """Risks of symbols with few callers, with callers that have many, with loops and repeated calls, against sets."""
    from skeinwork.operators.sketches import risk_of_all

    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(500)] + [(1000 + i, 1) for i in range(60)] + [(1, 2), (2, 3), (3, 4), (4, 5), (2, 2), (1, 2)] + [(2000 + i, 6) for i in range(7)]
    df = spark.createDataFrame([(*p, "calls") for p in pairs], "src long, dst long, relation string")
    into = defaultdict(set)
    for a, b in pairs:
        if a != b:
            into[b].add(a)
    nodes = spark.createDataFrame([(n,) for n in range(420)], "key long")
    for r in risk_of_all(nodes, df).collect():
        one = into[r["key"]]
        two = {a for m in one for a in into[m]} | one
        three = {a for m in two for a in into[m]} | two
        root = {r["key"]}
        points = 12 * len(one) + 2 * (len(two - root) + len(three - root))
        assert r["direct_callers_count"] == len(one) and abs(r["risk_score"] - min(1.0, points / 100)) < 1e-9
