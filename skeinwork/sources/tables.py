"""The bundled tables, and the property graph that is read from them.

Parts are symbols, consecutive lines of an order are calls, documents are descriptions. Keys are part keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skeinwork.schema import KINDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with kind, path, lines, source and documentation."""
    p = table(spark, sf_dir, "part")
    n = p.select(
        F.col("p_partkey").alias("key"),
        F.get(F.array(*map(F.lit, KINDS)), F.col("p_size") % 8).alias("kind"),
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("name"),
        F.concat(
            F.when(F.col("p_type") == "PROMO", "tests/").otherwise(""),
            F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")),
            F.lit("/"),
            F.lower("p_type"),
            F.lit("/f"),
            F.col("p_partkey") % 50,
            F.get(F.array(*map(F.lit, (".py", ".ts", ".go", ""))), F.col("p_size") % 4),
        ).alias("filepath"),
        F.lit(1).alias("start_line"),
        F.col("p_size").alias("end_line"),
        F.expr("repeat(concat(p_name, '\\n'), p_size)").alias("source_text"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("docstring"),
        F.concat(F.lit("r"), F.col("p_partkey") % 4).alias("repo_id"),
    )
    return n.select(
        "key",
        F.concat_ws(":", "repo_id", "filepath", "kind", "name").alias("id"),
        "kind", "name", "filepath", "start_line", "end_line", "source_text", "docstring",
        F.when(F.col("kind").isin("function", "method"), F.concat("name", F.lit("()"))).alias("signature"),
        F.lit(None).cast("string").alias("parent_id"),
        "repo_id",
    )


def steps(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """calls() with its copies. parts: tasks that orders are dealt over, if the session's number won't do."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = (line.repartition(parts, "l_orderkey") if parts else line).select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return pairs.where("dst is not null and src <> dst").withColumn("relation", F.lit("calls"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between parts that follow each other in an order."""
    return steps(spark, sf_dir).distinct()


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imports() with its copies."""
    line = table(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey")
    return line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("imports").alias("relation"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uses(spark, sf_dir).distinct()


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0")
    return p.select((F.col("p_partkey") - F.col("p_partkey") % 10).alias("src"), F.col("p_partkey").alias("dst"), F.lit("contains").alias("relation"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).unionByName(imports(spark, sf_dir)).unionByName(contains(spark, sf_dir))


def edge_rows(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """edges() with its copies."""
    return steps(spark, sf_dir, parts).unionByName(uses(spark, sf_dir)).unionByName(contains(spark, sf_dir))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer 2: labelled documents describe the part of the same number."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return d.select(F.col("doc_id").alias("node_id"), F.col("text").alias("summary"), "quality", "lang")


def component_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer 3: descriptions of good quality have details."""
    return descriptions(spark, sf_dir).where("quality = 1").select(F.col("node_id").alias("component_id"), F.concat(F.lit("flow of "), "summary").alias("data_flow"))


def architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer 4: every directory of a brand's first level whose number is even has a role."""
    p = table(spark, sf_dir, "part")
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    return p.where("CAST(substring(p_brand, 7) AS INT) % 2 = 0").select(brand.alias("module_path"), F.concat(F.lit("role of "), F.col("p_brand")).alias("architectural_role")).distinct()


# -- memory, read from the bundled tables


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('d', o_orderkey) AS id",
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('r', o_orderkey % 4) END AS repo_id",
        "concat('u', o_custkey % 5) AS author",
        "concat('priority ', o_orderpriority) AS title",
        "concat('ship order ', o_orderkey, ' as ', lower(o_orderpriority)) AS decision",
        "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'reverted' END AS outcome",
        "array(CASE WHEN o_orderpriority = '1-URGENT' THEN 'm3' ELSE 'none' END, concat('m', o_orderkey % 7)) AS affected_modules",
        "o_orderdate AS updated_at",
        "o_orderstatus = 'O' AS pending_sync",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('a', event_id) AS id",
        "concat('r', user_id % 4) AS repo_id",
        "concat('u', user_id % 5) AS author",
        "concat(event_type, ' of part_', user_id) AS problem",
        "concat('try ', props) AS approach",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'partial' END AS result",
        "CASE WHEN event_type = 'error' THEN concat('props were ', props) ELSE '' END AS failure_reason",
        "CASE WHEN user_id % 2 = 0 THEN 'look at the log' ELSE '' END AS lessons_learned",
        "ts AS updated_at",
        "event_type = 'signup' AS pending_sync",
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as preferences."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('p', c_custkey) AS id",
        "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('r', c_custkey % 4) END AS repo_id",
        "concat('u', c_nationkey % 5) AS author",
        "concat('segment_', c_nationkey) AS key",
        "c_mktsegment AS value",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(c_custkey % 100000 AS INT)) AS updated_at",
    )


def conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as conventions."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('c', s_suppkey) AS id",
        "concat('r', s_suppkey % 4) AS repo_id",
        "concat('u', s_nationkey % 5) AS author",
        "s_name AS title",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'retired' ELSE 'active' END AS status",
        "timestamp_ntz'2024-02-01' + make_dt_interval(0, 0, CAST(s_suppkey % 100000 AS INT)) AS updated_at",
        "s_suppkey % 5 = 0 AS pending_sync",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("problem"), F.max_by("text", "turn").alias("summary"), F.count("*").alias("n"))
    return c.selectExpr(
        "concat('s', conv_id) AS id",
        "concat('r', conv_id % 4) AS repo_id",
        "concat('u', conv_id % 5) AS author",
        "problem AS problem_statement",
        "CASE WHEN conv_id % 2 = 0 THEN summary ELSE '' END AS summary",
        "n AS turns",
        "timestamp_ntz'2024-03-01' + make_dt_interval(0, 0, CAST(conv_id % 100000 AS INT)) AS updated_at",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, some of which state something that journals look for."""
    said = "CASE turn % 6 WHEN 1 THEN concat('We decided: ', text) WHEN 2 THEN concat(text, '. This failed: no route to host') WHEN 3 THEN concat('I prefer ', text) WHEN 4 THEN 'you must always use the shared pool' WHEN 5 THEN concat('using  ', text, ' because the tests broke: twice.') ELSE text END"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{said} AS text")


TURNS = "m_turns AS (SELECT conv_id, turn, role, CASE turn % 6 WHEN 1 THEN 'We decided: ' || text WHEN 2 THEN text || '. This failed: no route to host' WHEN 3 THEN 'I prefer ' || text WHEN 4 THEN 'you must always use the shared pool' WHEN 5 THEN 'using  ' || text || ' because the tests broke: twice.' ELSE text END AS text FROM conversations)"

#: The same in DuckDB.
MEMORY_VIEWS = """
m_decisions AS (SELECT 'd' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'r' || (o_orderkey % 4) END AS repo_id, 'u' || (o_custkey % 5) AS author, 'priority ' || o_orderpriority AS title,
  'ship order ' || o_orderkey || ' as ' || lower(o_orderpriority) AS decision, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'reverted' END AS outcome,
  [CASE WHEN o_orderpriority = '1-URGENT' THEN 'm3' ELSE 'none' END, 'm' || (o_orderkey % 7)] AS affected_modules, o_orderdate AS updated_at, o_orderstatus = 'O' AS pending_sync FROM orders),
m_attempts AS (SELECT 'a' || event_id AS id, 'r' || (user_id % 4) AS repo_id, 'u' || (user_id % 5) AS author, event_type || ' of part_' || user_id AS problem, 'try ' || props AS approach,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'partial' END AS result, CASE WHEN event_type = 'error' THEN 'props were ' || props ELSE '' END AS failure_reason,
  CASE WHEN user_id % 2 = 0 THEN 'look at the log' ELSE '' END AS lessons_learned, ts AS updated_at, event_type = 'signup' AS pending_sync FROM events),
m_preferences AS (SELECT 'p' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'r' || (c_custkey % 4) END AS repo_id, 'u' || (c_nationkey % 5) AS author, 'segment_' || c_nationkey AS key, c_mktsegment AS value,
  TIMESTAMP '2024-01-01' + to_minutes(c_custkey % 100000) AS updated_at FROM customer),
m_conventions AS (SELECT 'c' || s_suppkey AS id, 'r' || (s_suppkey % 4) AS repo_id, 'u' || (s_nationkey % 5) AS author, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'retired' ELSE 'active' END AS status,
  TIMESTAMP '2024-02-01' + to_minutes(s_suppkey % 100000) AS updated_at, s_suppkey % 5 = 0 AS pending_sync FROM supplier),
m_sessions AS (SELECT 's' || conv_id AS id, 'r' || (conv_id % 4) AS repo_id, 'u' || (conv_id % 5) AS author, problem AS problem_statement, CASE WHEN conv_id % 2 = 0 THEN summary ELSE '' END AS summary, turns,
  TIMESTAMP '2024-03-01' + to_minutes(conv_id % 100000) AS updated_at FROM (SELECT conv_id, arg_min(text, turn) AS problem, arg_max(text, turn) AS summary, count(*) AS turns FROM conversations GROUP BY conv_id))
"""

#: The same in DuckDB, as common table expressions.
VIEWS = """
p0 AS (SELECT p_partkey AS key, ['module','class','function','method','import','variable','decorator','argument'][CAST(p_size % 8 AS INT) + 1] AS kind,
  'part_' || p_partkey AS name,
  (CASE WHEN p_type = 'PROMO' THEN 'tests/' ELSE '' END) || replace(lower(p_brand), '#', '') || '/' || lower(p_type) || '/f' || (p_partkey % 50) || ['.py','.ts','.go',''][CAST(p_size % 4 AS INT) + 1] AS filepath,
  1 AS start_line, p_size AS end_line, repeat(p_name || chr(10), p_size) AS source_text,
  CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS docstring, 'r' || (p_partkey % 4) AS repo_id FROM part),
g_nodes AS (SELECT *, repo_id || ':' || filepath || ':' || kind || ':' || name AS id,
  CASE WHEN kind IN ('function','method') THEN name || '()' END AS signature FROM p0),
g_calls AS (SELECT DISTINCT src, dst, 'calls' AS relation FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
g_imports AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'imports' AS relation FROM lineitem WHERE l_partkey <> l_suppkey),
g_contains AS (SELECT p_partkey - p_partkey % 10 AS src, p_partkey AS dst, 'contains' AS relation FROM part WHERE p_partkey % 10 <> 0),
g_edges AS (SELECT * FROM g_calls UNION ALL SELECT * FROM g_imports UNION ALL SELECT * FROM g_contains),
g_desc AS (SELECT doc_id AS node_id, text AS summary, quality, lang FROM documents JOIN labels USING (doc_id)),
g_doc AS (SELECT node_id AS component_id, 'flow of ' || summary AS data_flow FROM g_desc WHERE quality = 1),
g_arch AS (SELECT DISTINCT replace(lower(p_brand), '#', '') AS module_path, 'role of ' || p_brand AS architectural_role FROM part WHERE CAST(p_brand[7:] AS INT) % 2 = 0)
"""
