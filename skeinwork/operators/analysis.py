"""Text classification and extraction, logs, state machines over events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What marks a problem as spanning files, and the patterns by which an assistant's turns state decisions, failures, preferences and conventions.
CROSS_FILE = ("import", "dependency", "inheritance", "inherits", "extends", "cross-file", "multiple files", "across files", "module", "package", "refactor", "migration")
PATTERNS = (
    ("decisions", r"(?i)(?:decided|decision|we decided|we'll use|using|chose)\s*[:\-]?\s*(.{10,200})"),
    ("decisions", r"(?i)ADR[:\s]+(.{10,200})"),
    ("failed", r"(?i)(?:failed|didn't work|doesn't work|broke|error|gave up on)\s*[:\-]?\s*(.{10,200})"),
    ("failed", r"(?i)(?:because|reason)\s*[:\-]?\s*(.{10,150})"),
    ("preferences", r"(?i)(?:prefer|always use|we use|I use|use only)\s+(.{5,100})"),
    ("conventions", r"(?i)(?:convention|rule|team rule|standard|policy)[:\s]+(.{10,200})"),
    ("conventions", r"(?i)(?:all PRs?|always|never|must|should)\s+(.{10,150})"),
)
#: Class, pipeline depth, model tier, skipped agents, cost multiplier; each escalates to the next.
ROUTES = (
    ("SIMPLE", "shallow", "fast", "architecture,traceability", 0.3),
    ("MODERATE", "standard", "standard", "architecture", 0.7),
    ("COMPLEX", "deep", "reasoning", "", 1.5),
)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def complexity(text: Column, files: Column) -> Column:
    """SIMPLE: one file at most, no cross-file word, under 100 words. COMPLEX: four files, three such words or 300 words. Else MODERATE."""
    low, n = F.lower(text), words(text)
    hits = reduce(Column.__add__, [F.when(low.contains(w), 1).otherwise(0) for w in CROSS_FILE])
    return F.when((files <= 1) & (hits == 0) & (n < 100), "SIMPLE").when((files >= 4) | (hits >= 3) | (n >= 300), "COMPLEX").otherwise("MODERATE")


def routed(rows: DataFrame, failed: str | None = None) -> DataFrame:
    """rows (with class) and their route. failed: a boolean column; where it's true the class is one step higher, COMPLEX at most."""
    spark = rows.sparkSession
    table = spark.createDataFrame(ROUTES, "class string, depth string, tier string, skipped string, cost double")  # three rows
    if failed:
        up = F.when(F.col(failed) & (F.col("class") == "SIMPLE"), "MODERATE").when(F.col(failed) & (F.col("class") == "MODERATE"), "COMPLEX").otherwise(F.col("class"))
        rows = rows.withColumn("class", up)
    return rows.join(F.broadcast(table), "class")


def extract(turns: DataFrame, patterns: tuple[tuple[str, str], ...] = PATTERNS, least: int = 10, most: int = 200) -> DataFrame:
    """conv_id, class and text of what assistants' turns (conv_id, turn, role, text) say, once for each log by class and first 60 letters.

    The turns of a log are one text with line ends between them, so a statement may go on in the next. Of equal statements the first pattern's first match stays.
    """
    said = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("text")))).alias("x"))
    log = said.select("conv_id", F.array_join(F.col("x.text"), "\n").alias("log"))
    def matches(k: int, name: str, pattern: str) -> Column:
        found = F.regexp_extract_all("log", F.lit(pattern.replace("(?i)", "(?id)")), F.lit(1))
        return F.transform(found, lambda x, i: F.struct(F.lit(name).alias("class"), F.lit(k).alias("k"), i.alias("pos"), x.alias("col")))

    # all patterns are looked for in one pass over the logs
    said = log.select("conv_id", F.inline(F.flatten(F.array(*(matches(k, *p) for k, p in enumerate(patterns))))))
    text = F.regexp_replace(F.trim("col"), r"[.,;]+\z", "")
    found = said.select("conv_id", "class", F.struct("k", "pos").alias("at"), text.alias("text")).where(F.length("text") >= least)
    key = F.substring(F.lower("text"), 1, 60)
    first = found.groupBy("conv_id", "class", key.alias("key")).agg(F.min_by("text", "at").alias("text"))
    return first.select("conv_id", "class", F.substring("text", 1, most).alias("text"))


def tail(log: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return log.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_rn") <= n).drop("_rn")


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """user_id, start, end and events of runs without a gap of `minutes` or more."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) >= F.expr(f"INTERVAL '{minutes}' MINUTE"), F.lit(True))
    marked = events.withColumn("s", F.sum(F.when(gap, 1).otherwise(0)).over(w))
    return marked.groupBy("user_id", "s").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n")).drop("s")


def failure_runs(events: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive failures of a service (a user here), and whether they open its breaker."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events.withColumn("ok", F.when(F.col("event_type") != "error", 1).otherwise(0)).withColumn("run_id", F.sum("ok").over(w))
    runs = marked.where("ok = 0").groupBy("user_id", "run_id").agg(F.count("*").alias("n_failures"))
    return runs.withColumn("tripped", F.col("n_failures") >= least)


def progress(events: DataFrame, total: int) -> DataFrame:
    """processed, percent and the seconds left at the pace so far, of every user."""
    p = events.groupBy("user_id").agg(F.count("*").alias("processed"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b"), F.unix_micros(F.min("ts").cast("timestamp")).alias("a"))
    eta = F.round((total - F.col("processed")) * ((F.col("b") - F.col("a")) / 1e6) / F.col("processed"), 2)
    return p.select("user_id", "processed", F.round(100.0 * F.col("processed") / total, 4).alias("percent"), F.when(F.col("processed") < total, eta).otherwise(0.0).alias("eta"))


def patch_index(patches: DataFrame, key: str, text: str, kind: str = "bugfix") -> DataFrame:
    """Of unified diffs: changed files, functions and classes named by hunk headers, and a signature that doesn't depend on their order."""
    lines = F.split(text, "\n")
    files = F.transform(F.filter(lines, lambda x: x.startswith("+++ b/")), lambda x: F.substring(x, 7, 1 << 20))
    symbols = F.array_distinct(F.regexp_extract_all(text, F.lit(r"@@.*@@\s*(?:def|class)\s+(\w+)"), F.lit(1)))
    out = patches.select(key, files.alias("files"), symbols.alias("symbols"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.withColumn("signature", F.sha2(F.concat_ws("|", joined("files"), joined("symbols"), F.lit(kind)), 256))


#: Names of test frameworks and builtins, which aren't what a test is about.
FRAMEWORK = (
    "assert assertEqual assertNotEqual assertTrue assertFalse assertIs assertIsNot assertIsNone assertIsNotNone assertIn assertNotIn assertIsInstance assertNotIsInstance"
    " assertRaises assertRaisesRegex assertWarns assertWarnsRegex assertLogs assertAlmostEqual assertNotAlmostEqual assertGreater assertGreaterEqual assertLess assertLessEqual"
    " assertRegex assertNotRegex assertCountEqual assertMultiLineEqual assertSequenceEqual assertListEqual assertTupleEqual assertSetEqual assertDictEqual"
    " setUp tearDown setUpClass tearDownClass setUpModule tearDownModule fail skipTest subTest print len str int float list dict set tuple range enumerate zip map filter sorted reversed"
    " isinstance issubclass hasattr getattr setattr type super self"
).split()
#: Cases that tests look at, and how they are seen.
EDGE_CASES = (
    ("None/null check", r"(?:None|null|nil)\b"),
    ("Empty collection", r"(?:\[\]|\(\)|\{\}|\.empty|len\([^)]*\)\s*==\s*0)"),
    ("Boundary value", r"(?:\b0\b|\b1\b|\b-1\b|MAX|MIN|boundary)"),
    ("Exception handling", r"(?:assertRaises|with\s+self\.assertRaises|pytest\.raises)"),
)


def test_signals(patches: DataFrame, key: str, text: str) -> DataFrame:
    """Of the added lines of test patches: tested_files (of imported modules), symbols that are called, assertions, edge_cases, and direct: the symbols that are imported too, whose priority is 1.0 (0.5 for others)."""
    added = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    source = patches.select(key, F.array_join(F.transform(added, lambda x: F.substring(x, 2, 1 << 20)), "\n").alias("s"))
    every = lambda p, g=1: F.regexp_extract_all("s", F.lit(p), F.lit(g))
    froms, names, plain = every(r"from\s+([\w.]+)\s+import\s+[\w, *]+"), every(r"from\s+[\w.]+\s+import\s+([\w, *]+)"), every(r"(?m)^import\s+([\w.]+)")
    imported = F.array_union(F.filter(F.transform(F.flatten(F.transform(names, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: (x != "") & (x != "*")), F.transform(plain, lambda x: F.element_at(F.split(x, r"\."), -1)))
    called = F.array_except(F.array_union(F.filter(every(r"(?:self\.)?(\w+)\s*\("), lambda x: ~x.startswith("test_")), every(r"\b([A-Z]\w+)\s*\(")), F.array(*map(F.lit, FRAMEWORK)))
    cases = F.array_compact(F.array(*(F.when(F.col("s").rlike(p), name) for name, p in EDGE_CASES)))
    asserts = F.concat(every(r"(self\.assert\w+\([^)]*\))"), F.transform(every(r"(?m)^(\s*assert\s+.+)$"), lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))))
    out = source.select(key, F.transform(F.array_distinct(F.concat(froms, plain)), lambda x: F.concat(F.replace(x, F.lit("."), F.lit("/")), F.lit(".py"))).alias("tested_files"), F.array_sort(called).alias("symbols"), asserts.alias("assertions"), cases.alias("edge_cases"), imported.alias("_in"))
    return out.withColumn("direct", F.array_sort(F.array_intersect("symbols", "_in"))).drop("_in")


def boosted(signals: DataFrame, key: str, context: DataFrame) -> DataFrame:
    """Tested symbols as contexts of their priority before others. signals: as from test_signals(). context: key, node_id, seq. Adds priority and order."""
    first = signals.select(key, F.posexplode("symbols").alias("seq", "node_id"), "direct")
    first = first.select(key, "node_id", F.when(F.array_contains("direct", F.col("node_id")), 1.0).otherwise(0.5).alias("priority"), F.lit(0).alias("part"), "seq")
    both = first.unionByName(context.select(key, "node_id", F.lit(None).cast("double").alias("priority"), F.lit(1).alias("part"), F.col("seq").cast("int").alias("seq")))
    return both.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("part", "seq", "node_id"))).drop("part", "seq")
