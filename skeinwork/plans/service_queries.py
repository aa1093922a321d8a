"""Queries over repositories, files, jobs, tenants and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import catalog, memory
from skeinwork.plans.registry import query
from skeinwork.sources.stored import graph
from skeinwork.sources.tables import table

_HASHES = "SELECT 'r' || (page_id % 4) AS repo_id, 'p' || page_id || '.html' AS file_path, sha256(html) AS file_hash, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS indexed_at FROM pages"


def _hashes(spark, d):
    return table(spark, d, "pages").selectExpr("concat('r', page_id % 4) AS repo_id", "concat('p', page_id, '.html') AS file_path", "sha2(html, 256) AS file_hash", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(page_id AS INT)) AS indexed_at")


@query(f"SELECT file_hash FROM ({_HASHES}) WHERE repo_id = 'r2' AND file_path = 'p6.html'", views=False)
def file_hash(spark, d):
    return catalog.file_hash(_hashes(spark, d), "r2", "p6.html")


@query(f"SELECT repo_id, file_path, CASE WHEN length(file_path) % 2 = 0 THEN 'new' ELSE file_hash END AS file_hash FROM ({_HASHES})", views=False)
def stored_hashes(spark, d):
    h = _hashes(spark, d)
    new = h.where("length(file_path) % 2 = 0").withColumns({"file_hash": F.lit("new"), "indexed_at": F.expr("indexed_at + interval 1 day")})
    return catalog.put_hashes(h, new).select("repo_id", "file_path", "file_hash")


@query("SELECT DISTINCT trim(url) AS path FROM pages WHERE page_id % 3 <> 1", views=False)
def changed_paths(spark, d):
    p = table(spark, d, "pages")
    return catalog.changed_files(p.where("page_id % 3 = 0").select(F.concat(F.lit(" "), "url").alias("path")), p.where("page_id % 3 = 2").select(F.col("url").alias("path")).union(spark.createDataFrame([(" ",)], "path string")))


_META = "SELECT 'r' || n_nationkey AS repo_id, n_name AS repo_path, CASE WHEN n_nationkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(n_nationkey % 7) END AS last_indexed_at, 'done' AS indexing_status, CAST(n_regionkey AS INTEGER) AS total_files FROM nation"


def _meta(spark, d):
    return table(spark, d, "nation").selectExpr("concat('r', n_nationkey) AS repo_id", "n_name AS repo_path", "CASE WHEN n_nationkey % 4 <> 0 THEN timestamp_ntz'2024-01-01' + make_dt_interval(n_nationkey % 7) END AS last_indexed_at", "'done' AS indexing_status", "n_regionkey AS total_files")


@query(f"SELECT row_number() OVER (ORDER BY last_indexed_at DESC NULLS LAST, repo_id) AS place, repo_id FROM ({_META})", views=False)
def repositories_newest(spark, d):
    from pyspark.sql import Window as W

    rows = catalog.repositories(_meta(spark, d))
    return rows.select(F.row_number().over(W.orderBy(F.desc_nulls_last("last_indexed_at"), "repo_id")).cast("long").alias("place"), "repo_id")


@query(f"SELECT repo_id, CASE repo_id WHEN 'r3' THEN 'running' ELSE indexing_status END AS indexing_status, CASE repo_id WHEN 'r3' THEN 99 ELSE total_files END AS total_files FROM ({_META})", views=False)
def repository_status(spark, d):
    return catalog.with_status(_meta(spark, d), "r3", "running", total_files=99).select("repo_id", "indexing_status", "total_files")


@query(f"SELECT repo_id, CASE WHEN repo_id = 'r5' THEN 'new' ELSE repo_path END AS repo_path FROM ({_META}) UNION ALL SELECT 'r99', 'added'", views=False)
def repository_merge(spark, d):
    m = _meta(spark, d)
    one = m.where("repo_id = 'r5'").withColumn("repo_path", F.lit("new"))
    other = one.withColumns({"repo_id": F.lit("r99"), "repo_path": F.lit("added")})
    return catalog.merged_repository(catalog.merged_repository(m, one), other).select("repo_id", "repo_path")


@query(f"SELECT repo_id, file_path AS what FROM ({_HASHES}) WHERE repo_id <> 'r1' UNION ALL SELECT repo_id, repo_path FROM ({_META}) WHERE repo_id <> 'r1'", views=False)
def repository_removed(spark, d):
    a, b = catalog.without_repository("r1", _hashes(spark, d), _meta(spark, d))
    return a.select("repo_id", F.col("file_path").alias("what")).union(b.select("repo_id", "repo_path"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'the address must start with bolt:// or neo4j://' END, CASE WHEN s_suppkey * 50 > 65535 OR s_suppkey < 1 THEN 'the port must be between 1 and 65535' END,
CASE WHEN s_suppkey % 2 = 1 THEN 'dimensions must be one of 256, 512, 768, 1024, 1536, 2048' END, CASE WHEN s_suppkey % 5 = 0 THEN 'the batch size must be between 1 and 1000' END], lambda x: x IS NOT NULL), ';') AS errors FROM supplier""", views=False)
def settings_errors(spark, d):
    k = F.col("s_suppkey")
    row = F.struct(F.when(k % 3 == 0, "http://h").when(k % 3 == 1, "bolt://h").alias("uri"), (k * 50).alias("port"), F.when(k % 2 == 0, 512).otherwise(500).alias("dimensions"), F.when(k % 5 == 0, 0).otherwise(10).alias("batch"))
    return table(spark, d, "supplier").select(row.alias("r"), "s_suppkey").select("s_suppkey", F.array_join(catalog.settings_errors(F.col("r")), ";").alias("errors"))


@query("""WITH r AS (SELECT 'r' || (item_id % 3) AS repo_id, item_id, '## Q' || item_id || ': ' || left(text, 20) || chr(10) || chr(10) || '**Facts:** ' || (item_id % 5) || ' | **Episodes:** ' || (item_id % 3) || ' | **Context:** ' || length(text) || ' characters' || chr(10) || chr(10) || '```' || chr(10) || text[1:500] || chr(10) || '```' || chr(10) AS t FROM benchmark)
SELECT repo_id, '# ' || repo_id || ' results' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY item_id) AS text FROM r GROUP BY 1""", views=False)
def question_report(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("r"), F.col("item_id") % 3).alias("repo_id"), F.col("item_id").alias("num"), F.substring("text", 1, 20).alias("question"), (F.col("item_id") % 5).alias("facts"), (F.col("item_id") % 3).alias("episodes"), F.col("text").alias("context"))
    return catalog.report(b)


# -- tenants


@query("SELECT key, 'u' || (key % 7) || ':' || id AS scoped_id, CASE WHEN key % 2 = 0 THEN id END AS shown FROM g_nodes")
def tenant_scope(spark, d):
    """Ids behind their users, and as their users (every second asks for another's) see them."""
    n = graph(spark, d).nodes.withColumn("user", F.concat(F.lit("u"), F.col("key") % 7))
    asking = F.when(F.col("key") % 2 == 0, F.col("user")).otherwise("u")
    return memory.scoped(n, "user", "id").select("key", "scoped_id", memory.unscoped(F.col("scoped_id"), asking).alias("shown"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events", views=False)
def rate_limit(spark, d):
    calls = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return memory.within_rate(calls, "user_id", "day", ["ts", "event_id"], 2).select("event_id", "allowed")


@query("""WITH k AS (SELECT c_custkey AS key, 'u' || (c_custkey % 40) AS u, CASE WHEN c_custkey % 2 = 0 THEN 'free' ELSE 'pro' END AS tier FROM customer WHERE c_custkey % 10 <> 3)
SELECT event_id, coalesce(row_number() OVER (PARTITION BY u, CAST(ts AS DATE) ORDER BY ts, event_id) <= CASE tier WHEN 'free' THEN 2 WHEN 'pro' THEN 5 END AND u IS NOT NULL, false) AS allowed FROM events LEFT JOIN k ON key = user_id""", views=False)
def tier_limits(spark, d):
    keys = table(spark, d, "customer").where("c_custkey % 10 <> 3").selectExpr("c_custkey AS key", "concat('u', c_custkey % 40) AS user", "CASE WHEN c_custkey % 2 = 0 THEN 'free' ELSE 'pro' END AS tier")
    limits = spark.createDataFrame([("free", 2), ("pro", 5)], "tier string, most int")
    calls = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), "ts", F.to_date("ts").alias("period"))
    return memory.allowed_calls(calls, keys, limits, ["ts", "event_id"]).select("event_id", "allowed")


@query("SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS n FROM events GROUP BY ALL", views=False)
def usage_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))


_JOBS = """WITH r AS (SELECT page_id AS job_id, 'u' || (page_id % 9) AS u, CASE page_id % 3 WHEN 0 THEN 'https://github.com/a/r' || page_id WHEN 1 THEN url ELSE 'https://github.com/b/r' || page_id END AS url FROM pages),
k AS (SELECT *, regexp_matches(url, '^https://github\\.com/[^/\\s]+/[^/\\s]+/?$') AS ok FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY u, ok ORDER BY job_id) AS n FROM k),
j AS (SELECT job_id, u AS user, CASE WHEN ok AND n + CASE WHEN u = 'u3' THEN 1 ELSE 0 END <= 2 THEN 'QUEUED' WHEN ok THEN 'REJECTED_LIMIT' ELSE 'REJECTED_URL' END AS status FROM n)
"""


def _jobs(spark, d):
    p = table(spark, d, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://github.com/a/r"), "page_id")).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("https://github.com/b/r"), "page_id"))
    requests = p.select(F.col("page_id").alias("job_id"), F.concat(F.lit("u"), F.col("page_id") % 9).alias("user"), url.alias("url"), F.col("page_id").alias("seq"))
    return memory.submitted(requests, spark.createDataFrame([("u3", 1)], "user string, n int"))


@query(_JOBS + 'SELECT job_id, "user", status FROM j', views=False)
def job_submit(spark, d):
    return _jobs(spark, d)[0].select("job_id", "user", "status")


@query(_JOBS + "SELECT job_id, \"user\" FROM j WHERE status = 'QUEUED'", views=False)
def job_messages(spark, d):
    return _jobs(spark, d)[1].select("job_id", "user")


@query(_JOBS + "SELECT job_id, status FROM j WHERE job_id = 6 AND \"user\" = 'u6'", views=False)
def job_status(spark, d):
    return memory.job_of(_jobs(spark, d)[0], 6, "u6").select("job_id", "status")
