"""The graph queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skeinwork.operators import analysis, bridge, catalog, context, docs, memory, relational, traversal, vector_index
from skeinwork.plans.registry import ORACLES, QUERIES, query
from skeinwork.session import drop_at_exit, shared_dir
from skeinwork.sources import tables
from skeinwork.sources.keyed import Store
from skeinwork.sources.stored import graph, stamp
from skeinwork.sources.tables import TURNS, table

__all__ = ["ORACLES", "QUERIES"]
ROOT = 42


def many(df, *names):
    """The named counts as long."""
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# -- traversal

_REACH = """+ r(node, d) AS (SELECT CAST({root} AS BIGINT), 0 UNION SELECT e.{to}, r.d + 1 FROM r JOIN {edges} e ON e.{by} = r.node WHERE r.d < {depth}),
m AS (SELECT node, min(d) AS d FROM r GROUP BY node HAVING min(d) > 0)
"""
_CALLS = _REACH + "SELECT n.id AS node_id, n.name, n.kind, n.filepath, n.start_line, n.end_line, CAST({depth} AS INTEGER) AS call_depth, CAST(m.d AS INTEGER) AS min_depth FROM m JOIN g_nodes n ON n.key = m.node"


@query(_CALLS.format(root=ROOT, edges="g_calls", by="dst", to="src", depth=2), recursive=True)
def callers_depth2(spark, d):
    g = graph(spark, d)
    return traversal.callers(g.nodes, g.incoming, ROOT, 2)


@query(_CALLS.format(root=ROOT, edges="g_calls", by="dst", to="src", depth=5), recursive=True)
def callers_depth5(spark, d):
    g = graph(spark, d)
    return traversal.callers(g.nodes, g.incoming, ROOT, 5)


@query(_CALLS.format(root=ROOT, edges="g_calls", by="src", to="dst", depth=3), recursive=True)
def callees_depth3(spark, d):
    g = graph(spark, d)
    return traversal.callees(g.nodes, g.outgoing, ROOT, 3)


_BOTH = "(SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e})"


@query(_REACH.format(root=ROOT, edges=_BOTH.format(e="g_edges"), by="src", to="dst", depth=2) + "SELECT node, 0.5::DOUBLE AS score, CAST(d AS INTEGER) AS min_depth FROM m", recursive=True)
def neighbors_depth2(spark, d):
    g = graph(spark, d)
    return traversal.neighbors(g.outgoing, ROOT, None, 2, g.incoming)


@query(_REACH.format(root=ROOT, edges=_BOTH.format(e="g_contains"), by="src", to="dst", depth=1) + "SELECT node, 1.0::DOUBLE AS score, CAST(d AS INTEGER) AS min_depth FROM m", recursive=True)
def neighbors_contains(spark, d):
    g = graph(spark, d)
    return traversal.neighbors(g.outgoing, ROOT, "contains", 1, g.incoming)


_IMPACT = """+ asked AS (SELECT key AS root FROM g_nodes WHERE {asked}),
l1 AS (SELECT DISTINCT root, src AS node FROM asked JOIN g_calls ON dst = root),
l2 AS (SELECT DISTINCT root, e.src AS node FROM l1 JOIN g_calls e ON e.dst = l1.node WHERE root <> e.src),
l3 AS (SELECT DISTINCT root, e.src AS node FROM l2 JOIN g_calls e ON e.dst = l2.node WHERE root <> e.src),
u AS (SELECT root, node, min(d) AS d FROM (SELECT *, 1 AS d FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) GROUP BY ALL),
b AS (SELECT root, at_depth, n.id, n.name, n.kind, n.filepath, regexp_matches(lower(n.filepath), 'test|spec') AS test FROM u JOIN g_nodes n ON n.key = u.node, (VALUES (1), (2), (3)) t(at_depth) WHERE d <= at_depth),
k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY at_depth, name, id) AS rn, row_number() OVER (PARTITION BY root, test ORDER BY at_depth, name, id) AS rt FROM b),
c AS (SELECT root, count_if(at_depth = 1) AS c1, count(*) AS c, string_agg(id, ',' ORDER BY name, id) FILTER (WHERE at_depth = 1 AND NOT test AND rt <= 20) AS direct_dependents,
  string_agg(id, ',' ORDER BY at_depth, name, id) FILTER (WHERE test AND rt <= 20) AS test_files, string_agg(id || '@' || at_depth, ',' ORDER BY at_depth, name, id) FILTER (WHERE rn <= 50) AS all_callers FROM k GROUP BY root),
s AS (SELECT root AS key, CAST(coalesce(c1, 0) AS BIGINT) AS direct_callers_count, CAST(coalesce(c, 0) AS BIGINT) AS total_callers_count, CAST((SELECT count(*) FROM g_calls WHERE src = root) AS BIGINT) AS direct_callees_count,
  coalesce(direct_dependents, '') AS direct_dependents, coalesce(test_files, '') AS test_files, coalesce(all_callers, '') AS all_callers FROM asked LEFT JOIN c USING (root)),
r AS (SELECT *, CAST(CASE WHEN direct_callees_count > 0 THEN 3 ELSE 0 END AS INTEGER) AS propagation_depth, round(least(1.0::DOUBLE, (10 * direct_callers_count + 2 * total_callers_count) / 100.0::DOUBLE), 2) AS risk_score FROM s)
SELECT *, CASE WHEN risk_score >= 0.7 THEN 'High' WHEN risk_score >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_label FROM r"""


def _impact(spark, d, asked):
    g = graph(spark, d)
    found = traversal.impact(g.nodes, g.outgoing, g.nodes.where(asked), incoming=g.incoming)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["node_id"]), ",").alias(c)
    depths = F.array_join(F.transform("all_callers", lambda x: F.concat_ws("@", x["node_id"], x["at"])), ",").alias("all_callers")
    return found.select(*(c for c in found.columns if c not in ("direct_dependents", "test_files", "all_callers")), ids("direct_dependents"), ids("test_files"), depths)


_CLASSES = "kind = 'class' AND starts_with(filepath, 'brand2')"
_FOLDER = "starts_with(filepath, 'brand7/large/')"


@query(_IMPACT.format(asked=_FOLDER))
def impact_of_files(spark, d):
    """The symbols of a changed folder."""
    return _impact(spark, d, _FOLDER.replace("starts_with", "startswith"))


@query(_IMPACT.format(asked=f"key = {ROOT}"))
def symbol_impact(spark, d):
    return _impact(spark, d, F.col("key") == ROOT)


@query("""+ r(node, d) AS (SELECT key, 0 FROM g_nodes WHERE contains(filepath, 'brand7/') UNION SELECT e.src, r.d + 1 FROM r JOIN g_edges e ON e.dst = r.node AND e.relation IN ('calls', 'imports') WHERE r.d < 3),
t AS (SELECT node, 1.0 / (min(d) + 1) AS impact_score FROM r GROUP BY node ORDER BY 2 DESC, 1 LIMIT 50) SELECT *, least(1.0::DOUBLE, count(*) OVER () / 20.0::DOUBLE) AS confidence FROM t""", recursive=True)  # fmt: skip
def blast_radius_top50(spark, d):
    g = graph(spark, d)
    return traversal.blast_radius(g.incoming, g.nodes.where(F.col("filepath").contains("brand7/")))


@query("SELECT key, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS key, 1 AS i, 0 AS o FROM g_calls UNION ALL SELECT src, 0, 1 FROM g_calls) GROUP BY key")
def fan_in_out(spark, d):
    return traversal.fan(graph(spark, d).outgoing)


_PATHS = f"""+ e AS (SELECT * FROM g_calls UNION ALL SELECT * FROM g_imports), cand AS (SELECT key FROM g_nodes WHERE {_CLASSES}), begins AS (SELECT key FROM cand ORDER BY key LIMIT 10),
two AS (SELECT a.src AS start, [a.src, a.dst, b.dst] AS p, [a.relation, b.relation] AS r, b.dst AS at_end FROM e a JOIN e b ON a.dst = b.src WHERE a.src IN (FROM begins) AND NOT (a.src = b.src AND a.dst = b.dst AND a.relation = b.relation)),
three AS (SELECT start, list_append(p, c.dst) AS p, list_append(r, c.relation) AS r, c.dst AS at_end FROM two JOIN e c ON two.at_end = c.src
  WHERE NOT (c.src = p[1] AND c.dst = p[2] AND c.relation = r[1]) AND NOT (c.src = p[2] AND c.dst = p[3] AND c.relation = r[2])),
f AS (SELECT start, array_to_string(p, '>') AS path_text, array_to_string(r, '>') AS relation_text, len(p) AS n, p FROM (SELECT * FROM two UNION ALL SELECT * FROM three) WHERE at_end IN (FROM cand)),
g AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n, path_text, relation_text) AS rn FROM f)
"""


def _paths(spark, d):
    g = graph(spark, d)
    return traversal.connecting_paths(g.outgoing.where("relation in ('calls', 'imports')"), g.nodes.where(_CLASSES.replace("starts_with", "startswith")))


@query(_PATHS + "SELECT start, path_text, relation_text FROM g WHERE rn <= 10")
def paths_2_3_hops(spark, d):
    return _paths(spark, d).drop("path")


@query(_PATHS + """, k AS (SELECT start, path_text, relation_text, n, unnest(p) AS key FROM g WHERE rn <= 10)
SELECT start, path_text, relation_text, round(least(1.0::DOUBLE, 0.1::DOUBLE * n + 0.5::DOUBLE * count_if(contains('how does part_5 work', lower(m.name)) OR contains(lower(m.name), 'how does part_5 work'))), 6) AS score
FROM k JOIN g_nodes m USING (key) GROUP BY start, path_text, relation_text, n ORDER BY score DESC, start, path_text, relation_text LIMIT 5""")  # fmt: skip
def chain_scores(spark, d):
    return traversal.chain_scores(_paths(spark, d), graph(spark, d).nodes, "how does part_5 work")


_MODULE = "regexp_replace({}, '/[^/]*$', '')"


@query(f"SELECT {_MODULE.format('filepath')} AS module, count(*) AS n_nodes FROM g_nodes GROUP BY 1")
def modules_group(spark, d):
    return graph(spark, d).nodes.groupBy(traversal.module_of(F.col("filepath")).alias("module")).agg(F.count("*").alias("n_nodes"))


_MODULES = f"""+ m AS (SELECT key, {_MODULE.format("filepath")} AS module FROM g_nodes),
q AS (SELECT a.module AS src_module, b.module AS dst_module, count(*) AS n FROM g_calls c JOIN m a ON a.key = c.src JOIN m b ON b.key = c.dst WHERE a.module <> b.module GROUP BY ALL)
"""


def _module_edges(spark, d):
    g = graph(spark, d)
    return traversal.module_edges(g.nodes, g.outgoing)


@query(_MODULES + "SELECT * FROM q")
def module_dependencies(spark, d):
    return _module_edges(spark, d)


@query(_MODULES + "SELECT x.src_module AS a, x.dst_module AS b, x.n AS n_ab, y.n AS n_ba FROM q x JOIN q y ON x.src_module = y.dst_module AND x.dst_module = y.src_module WHERE x.src_module < x.dst_module")
def module_cycles(spark, d):
    return traversal.module_cycles(_module_edges(spark, d))


@query(_MODULES + """, k AS (SELECT module, sum(n) AS n_symbols, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS kinds FROM (SELECT m.module, n.kind, count(*) AS n FROM m JOIN g_nodes n USING (key) GROUP BY ALL) GROUP BY module),
b AS (SELECT regexp_replace(module, '/[^/]*$', '') AS module, string_agg(module, ',' ORDER BY module) AS children FROM (SELECT DISTINCT module FROM m) WHERE contains(module, '/') GROUP BY 1)
SELECT module, CAST(n_symbols AS BIGINT) AS n_symbols, kinds, coalesce(children, '') AS children, (SELECT count(*) FROM q WHERE src_module = k.module) AS n_calls, (SELECT count(*) FROM q WHERE dst_module = k.module) AS n_called_by FROM k LEFT JOIN b USING (module)""")
def module_details(spark, d):
    return traversal.module_details(graph(spark, d).nodes, _module_edges(spark, d))


@query(_MODULES + """, r(a, b) AS (SELECT src_module, dst_module FROM q UNION SELECT r.a, q.dst_module FROM r JOIN q ON q.src_module = r.b)
SELECT x.a AS module, least(x.a, min(x.b)) AS ring FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""", recursive=True)
def module_rings(spark, d):
    return traversal.module_rings(_module_edges(spark, d))


_RING = """, r(a, b) AS (SELECT src, dst FROM k UNION SELECT r.a, k.dst FROM r JOIN k ON k.src = r.b)
SELECT x.a AS {name}, least(x.a, min(x.b)) AS ring FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a"""


@query(_MODULES + ", k AS (SELECT src_module AS src, dst_module AS dst FROM q WHERE string_split(src_module, '/')[1] = string_split(dst_module, '/')[1])" + _RING.format(name="module"), recursive=True)
def package_rings(spark, d):
    """Rings of modules within one package, the first folder of their paths."""
    first = lambda c: F.split(c, "/")[0]
    return traversal.module_rings(_module_edges(spark, d).where(first("src_module") == first("dst_module")))


@query(_MODULES + ", k AS (SELECT c.src, c.dst FROM g_calls c JOIN m a ON a.key = c.src JOIN m b ON b.key = c.dst WHERE a.module = b.module)" + _RING.format(name="node"), recursive=True)
def recursive_symbols(spark, d):
    """Symbols that call each other in a ring within their module."""
    g = graph(spark, d)
    m = g.nodes.select("key", traversal.module_of(F.col("filepath")).alias("module"))
    calls = g.outgoing.where("relation = 'calls'").join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst").where("a = b")
    return traversal.components(calls).toDF("node", "ring")


@query("SELECT conv_id AS plan, CAST(CASE WHEN conv_id % 5 = 0 THEN r + 1 ELSE r % 3 + 1 END AS INTEGER) AS level, 't' || r AS task_id FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS r FROM conversations)", views=False)
def dag_levels(spark, d):
    """Turns as tasks: each third one needs nothing, others the one before; every fifth conversation is a ring, which breaks at its first turn."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id")
    c = table(spark, d, "conversations").withColumn("r", (F.row_number().over(w.orderBy("turn", "role", "text")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    before = F.when((F.col("conv_id") % 5 == 0) & (F.col("r") == 0), F.col("n") - 1).when((F.col("conv_id") % 5 == 0) | (F.col("r") % 3 != 0), F.col("r") - 1)
    tasks = c.select(F.col("conv_id").alias("plan"), F.concat(F.lit("t"), "r").alias("task_id"), F.col("r").alias("priority"), F.array_compact(F.array(F.concat(F.lit("t"), before))).alias("depends_on"))
    return traversal.level_rows(tasks)


# -- documentation


_ARCH = "g_nodes n JOIN g_arch a ON starts_with(n.filepath, a.module_path || '/')"


@query(f"SELECT n.key, a.module_path, a.architectural_role FROM {_ARCH}")
def arch_prefix_join(spark, d):
    return docs.prefix_links(graph(spark, d).nodes, tables.architecture(spark, d))


_TESTS = "(contains(n.name, 'test') OR contains(n.name, 'spec') OR contains(n.filepath, 'test') OR contains(n.filepath, 'spec'))"
_COVERED = f"SELECT key, test FROM (SELECT key, test, row_number() OVER (PARTITION BY key ORDER BY test) AS rn FROM (SELECT DISTINCT e.dst AS key, n.id AS test FROM g_edges e JOIN g_nodes n ON n.key = e.src WHERE relation IN ('calls', 'imports') AND {_TESTS})) WHERE rn <= 20"


@query(f"""+ c AS ({_COVERED}),
l AS (SELECT node_id AS key, string_agg(type || ':' || text, chr(10) ORDER BY type DESC, text) AS links FROM (SELECT node_id, 'ComponentDescription' AS type, summary AS text FROM g_desc UNION ALL SELECT component_id, 'ComponentDoc', data_flow FROM g_doc) GROUP BY 1),
t AS (SELECT key, string_agg(test, ',' ORDER BY test) AS tests FROM c GROUP BY 1), a AS (SELECT n.key, string_agg(a.module_path, ',' ORDER BY a.module_path) AS modules FROM {_ARCH} GROUP BY 1)
SELECT n.key, md5(coalesce(links, '')) AS links_md5, coalesce(tests, '') AS tests, coalesce(modules, '') AS modules, links IS NOT NULL AS has_documentation, tests IS NOT NULL AS has_test_coverage, modules IS NOT NULL AS has_architecture_context
FROM g_nodes n LEFT JOIN l USING (key) LEFT JOIN t USING (key) LEFT JOIN a USING (key)""".replace("type DESC, text", "CASE type WHEN 'ComponentDescription' THEN 1 ELSE 2 END, text"))  # fmt: skip
def symbol_traceability(spark, d):
    t = docs.traceability(graph(spark, d).nodes, graph(spark, d).outgoing, tables.descriptions(spark, d), tables.component_docs(spark, d), tables.architecture(spark, d))
    links = F.array_join(F.transform("requirement_links", lambda x: F.concat_ws(":", x["type"], x["text"])), "\n")
    return t.select("key", F.md5(links).alias("links_md5"), F.array_join("test_coverage", ",").alias("tests"), F.array_join(F.transform("architecture_context", lambda x: x["module_path"]), ",").alias("modules"), "has_documentation", "has_test_coverage", "has_architecture_context")


_TRACE = f"""+ s AS (SELECT * FROM g_nodes WHERE (name = 'brand' OR contains(filepath, 'brand')) AND repo_id = 'r2' ORDER BY id LIMIT 5),
p AS (SELECT key, 'component_desc' AS type, CAST(node_id AS VARCHAR) AS node_id, summary AS text FROM s JOIN g_desc ON node_id = key
UNION ALL SELECT key, 'component', CAST(component_id AS VARCHAR), data_flow FROM s JOIN g_doc ON component_id = key
UNION ALL SELECT n.key, 'architecture', a.module_path, a.architectural_role FROM {_ARCH.replace("g_nodes", "s")})
SELECT *, least(1.0::DOUBLE, count(*) OVER () / 10.0::DOUBLE) AS confidence FROM p"""


def _trace(spark, d, level):
    return docs.trace(graph(spark, d).nodes, tables.descriptions(spark, d), tables.component_docs(spark, d), tables.architecture(spark, d), "brand", "r2", level)


@query(_TRACE)
def trace_levels(spark, d):
    return _trace(spark, d, "architecture")


@query(_TRACE.replace("FROM p", "FROM p WHERE type <> 'architecture'"))
def trace_components(spark, d):
    return _trace(spark, d, "component")


@query(f"""+ a AS (SELECT * FROM g_nodes WHERE (name = 'brand7' OR contains(filepath, 'brand7/')) AND repo_id = 'r1' ORDER BY id LIMIT 10), few AS (SELECT * FROM a ORDER BY id LIMIT 5),
near AS (SELECT DISTINCT e.dst AS key FROM few JOIN (SELECT src, dst FROM g_contains UNION ALL SELECT dst, src FROM g_contains) e ON e.src = few.key WHERE e.dst NOT IN (SELECT key FROM a)),
p AS (SELECT n.id AS context_id, 'symbol' AS type, summary, data_flow FROM near JOIN g_nodes n USING (key) LEFT JOIN g_desc x ON x.node_id = n.key LEFT JOIN g_doc ON component_id = n.key
UNION ALL SELECT DISTINCT a.module_path, 'module', a.architectural_role, NULL FROM {_ARCH.replace("g_nodes", "few")})
SELECT *, least(1.0::DOUBLE, count(*) OVER () / 30.0::DOUBLE) AS confidence FROM p""")  # fmt: skip
def architecture_context(spark, d):
    return docs.context(graph(spark, d).nodes, graph(spark, d).outgoing, tables.descriptions(spark, d), tables.component_docs(spark, d), tables.architecture(spark, d), "brand7/", "r1")


_LAYERS = """+ v1 AS (SELECT 'symbol' AS layer, id, name AS label FROM g_nodes ORDER BY id, label LIMIT {n}), v2 AS (SELECT 'description' AS layer, CAST(node_id AS VARCHAR) AS id, summary AS label FROM g_desc ORDER BY 2, 3 LIMIT {n}),
v3 AS (SELECT 'detail' AS layer, CAST(component_id AS VARCHAR) AS id, data_flow AS label FROM g_doc ORDER BY 2, 3 LIMIT {n}), v4 AS (SELECT 'module' AS layer, module_path AS id, architectural_role AS label FROM g_arch ORDER BY 2, 3 LIMIT {n}),
v5 AS (SELECT 'fact' AS layer, CAST(key AS VARCHAR) AS id, docstring AS label FROM g_nodes WHERE docstring IS NOT NULL ORDER BY 2, 3 LIMIT {n}), v6 AS (SELECT 'memory' AS layer, id, title AS label FROM m_decisions ORDER BY 2, 3 LIMIT {n}),
""".format(n=200)


def _layers(spark, d):
    n = graph(spark, d).nodes
    facts = n.where("docstring is not null").select(F.col("key").cast("string").alias("id"), F.col("docstring").alias("label"))
    held = tables.decisions(spark, d).select("id", F.col("title").alias("label"))
    return docs.layered(n, tables.descriptions(spark, d), tables.component_docs(spark, d), tables.architecture(spark, d), facts, held, graph(spark, d).outgoing, 200)


@query(_LAYERS + " v AS (FROM v1 UNION ALL FROM v2 UNION ALL FROM v3 UNION ALL FROM v4 UNION ALL FROM v5 UNION ALL FROM v6) SELECT * FROM v", views="both")
def layered_vertices(spark, d):
    return _layers(spark, d)[0]


@query(_LAYERS + f""" c AS (SELECT a.id AS source, b.id AS target, relation FROM g_edges e JOIN g_nodes a ON a.key = e.src JOIN g_nodes b ON b.key = e.dst WHERE a.id IN (SELECT id FROM v1) AND b.id IN (SELECT id FROM v1)),
e1 AS (SELECT DISTINCT * FROM c WHERE relation = 'calls' ORDER BY 1, 2 LIMIT 400), e2 AS (SELECT DISTINCT * FROM c WHERE relation = 'contains' ORDER BY 1, 2 LIMIT 400),
e3 AS (SELECT DISTINCT n.id AS source, CAST(node_id AS VARCHAR) AS target, 'described_by' AS relation FROM g_nodes n JOIN g_desc ON node_id = n.key WHERE n.id IN (SELECT id FROM v1) AND CAST(node_id AS VARCHAR) IN (SELECT id FROM v2) ORDER BY 1, 2 LIMIT 400),
e4 AS (SELECT DISTINCT v3.id AS source, v2.id AS target, 'detailed_in' AS relation FROM v3 JOIN v2 USING (id) ORDER BY 1, 2 LIMIT 400),
e5 AS (SELECT DISTINCT n.id AS source, a.module_path AS target, 'part_of_architecture' AS relation FROM {_ARCH} WHERE n.id IN (SELECT id FROM v1) AND a.module_path IN (SELECT id FROM v4) ORDER BY 1, 2 LIMIT 400),
v AS (FROM e1 UNION ALL FROM e2 UNION ALL FROM e3 UNION ALL FROM e4 UNION ALL FROM e5) SELECT * FROM v""", views="both")  # fmt: skip
def layered_edges(spark, d):
    return _layers(spark, d)[1]


@query("+ k AS (SELECT * FROM g_desc WHERE node_id IN (SELECT key FROM g_nodes)) SELECT component_id, md5(data_flow) AS flow FROM g_doc WHERE component_id IN (SELECT node_id FROM k)")
def stored_details(spark, d):
    """Details are kept where their description is."""
    _, details, _ = docs.stored_layers(graph(spark, d).nodes, tables.descriptions(spark, d), tables.component_docs(spark, d), tables.architecture(spark, d))
    return details.select("component_id", F.md5("data_flow").alias("flow"))


@query("SELECT vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS which FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id IN (SELECT key FROM g_nodes)")
def stored_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    old = e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.lit("old").alias("which"))
    new = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.lit("new").alias("which"))
    return docs.stored_embeddings(graph(spark, d).nodes, old, new, 64).where("size(vector) = 64").select("key", "which")


@query("""+ i AS (SELECT s_suppkey AS id, 'pkg.mod.part_' || (s_suppkey * 3) AS target FROM supplier)
SELECT DISTINCT i.id AS src, n.key AS dst FROM i JOIN g_nodes n ON n.name = string_split(target, '.')[-1] WHERE n.kind NOT IN ('import', 'module', 'decorator') AND i.id <> n.key""")  # fmt: skip
def import_resolution(spark, d):
    i = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("pkg.mod.part_"), F.col("s_suppkey") * 3).alias("target"))
    return docs.import_links(i, graph(spark, d).nodes.select(F.col("key").alias("id"), "name", "kind"))


# -- joins over the plain tables


@query("""SELECT DISTINCT src, dst, relation FROM (SELECT * FROM g_calls UNION ALL SELECT src, -dst, 'calls' FROM g_calls) WHERE src IN (SELECT key FROM g_nodes) AND dst IN (SELECT key FROM g_nodes)""")
def edge_integrity(spark, d):
    c = graph(spark, d).outgoing.where("relation = 'calls'")
    return relational.attached(c.union(c.select("src", -F.col("dst"), "relation")), graph(spark, d).nodes)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", views=False)
def orphan_orders(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(line, o["o_orderkey"] == line["l_orderkey"], "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)", views=False)
def orders_with_lines(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 45")
    return o.join(line, o["o_orderkey"] == line["l_orderkey"], "left_semi").select("o_orderkey")


@query("SELECT n.key, count(c.dst) AS n FROM g_nodes n LEFT JOIN g_calls c ON c.src = n.key GROUP BY n.key")
def optional_edges(spark, d):
    c = graph(spark, d).outgoing.where("relation = 'calls'").groupBy(F.col("src").alias("key")).agg(F.count("*").alias("n"))
    return graph(spark, d).nodes.select("key").join(c, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH cur AS (SELECT url, sha256(html) AS h FROM (SELECT url, min(html) AS html FROM pages GROUP BY url)), old AS (SELECT url, CASE WHEN length(url) % 10 = 0 THEN 'x' ELSE h END AS h FROM cur WHERE length(url) % 17 <> 0 UNION ALL SELECT 'gone-' || url, h FROM cur WHERE length(url) % 19 = 0)
SELECT coalesce(a.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'new' WHEN a.url IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status FROM cur a FULL JOIN old b ON a.url = b.url""", views=False)  # fmt: skip
def hash_diff(spark, d):
    cur = table(spark, d, "pages").groupBy("url").agg(F.min("html").alias("html")).select("url", F.sha2("html", 256).alias("h"))
    old = cur.where("length(url) % 17 <> 0").select("url", F.when(F.length("url") % 10 == 0, "x").otherwise(F.col("h")).alias("h"))
    return relational.diff(cur, old.union(cur.where("length(url) % 19 = 0").select(F.concat(F.lit("gone-"), "url"), "h")), "url", "h")


# -- statistics


@query("SELECT repo_id, kind, count(*) AS n FROM g_nodes GROUP BY ALL")
def repo_stats_kind(spark, d):
    return relational.by_kind(graph(spark, d).nodes)


@query("SELECT a.repo_id, e.relation, count(*) AS n FROM g_edges e JOIN g_nodes a ON a.key = e.src JOIN g_nodes b ON b.key = e.dst WHERE a.repo_id = b.repo_id GROUP BY ALL")
def repo_stats_edges(spark, d):
    return relational.by_relation(graph(spark, d).nodes, graph(spark, d).outgoing)


@query("SELECT CASE WHEN regexp_extract(filepath, '(\\.[^./]*)$', 1) = '' THEN '(no extension)' ELSE regexp_extract(filepath, '(\\.[^./]*)$', 1) END AS extension, count(*) AS n FROM g_nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def repo_stats_ext(spark, d):
    return relational.by_extension(graph(spark, d).nodes)


@query("SELECT repo_id, CAST(sum(end_line - start_line + 1) AS BIGINT) AS total_lines FROM g_nodes GROUP BY 1")
def repo_lines(spark, d):
    return relational.lines(graph(spark, d).nodes)


@query("SELECT n.repo_id, count(DISTINCT n.key) AS node_count, count(DISTINCT CASE WHEN e.dst IS NOT NULL THEN n.key || '>' || e.dst || e.relation END) AS edge_count, max(CASE WHEN n.key % 7 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(n.key) END) AS last_indexed FROM g_nodes n LEFT JOIN g_edges e ON e.src = n.key GROUP BY 1")
def repo_list(spark, d):
    n = graph(spark, d).nodes.withColumn("last_indexed", F.expr("CASE WHEN key % 7 = 0 THEN timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(key AS INT)) END"))
    return relational.repositories(n, graph(spark, d).outgoing)


_REPOS = "(SELECT 'r' || n_nationkey AS repo_id, CASE n_nationkey WHEN 0 THEN '2024-05-01 10:00:00' WHEN 1 THEN 'not a date' WHEN 2 THEN '2024-05-02 10:00:00' END AS last_indexed FROM nation)"


def _repos(spark, d):
    return table(spark, d, "nation").selectExpr("concat('r', n_nationkey) AS repo_id", "CASE n_nationkey WHEN 0 THEN '2024-05-01 10:00:00' WHEN 1 THEN 'not a date' WHEN 2 THEN '2024-05-02 10:00:00' END AS last_indexed")


@query(f"""SELECT r.repo_id, (SELECT count(*) FROM g_nodes n WHERE n.repo_id = r.repo_id) AS node_count, (SELECT count(*) FROM g_edges e JOIN g_nodes a ON a.key = e.src JOIN g_nodes b ON b.key = e.dst WHERE a.repo_id = r.repo_id AND b.repo_id = r.repo_id) AS edge_count,
TRY_CAST(last_indexed AS TIMESTAMP) AS last_indexed FROM {_REPOS} r""")
def repo_overview(spark, d):
    return catalog.overview(graph(spark, d).nodes, graph(spark, d).outgoing, _repos(spark, d))


@query("SELECT kind, CAST(count_if(repo_id = 'r0') AS BIGINT) AS r0, CAST(count_if(repo_id = 'r1') AS BIGINT) AS r1 FROM g_nodes WHERE repo_id IN ('r0', 'r1') GROUP BY kind")
def repo_compare(spark, d):
    return many(relational.compare(graph(spark, d).nodes, ["r0", "r1"]), "r0", "r1")


_RUNS = "SELECT event_type <> 'error' AND CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 AS resolved, event_type = 'view' AS skipped, event_type = 'error' AS failed, value AS cost, value / 10 AS seconds FROM events"
_EVAL = "SELECT count(*) AS n, count_if(NOT skipped AND resolved) / count_if(NOT skipped) AS resolve_rate, round(avg(cost), 6) AS avg_cost, round(avg(seconds), 6) AS avg_seconds, count_if(failed) / count(*) AS error_rate FROM runs"


def _runs(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_type")
    return table(spark, d, "events").select(((e != "error") & (k % 2 == 0)).alias("resolved"), (e == "view").alias("skipped"), (e == "error").alias("failed"), F.col("value").alias("cost"), (F.col("value") / 10).alias("seconds"))


@query(f"WITH runs AS ({_RUNS}) {_EVAL}", views=False)
def eval_metrics(spark, d):
    return relational.evaluation(_runs(spark, d))


@query(f"WITH runs AS ({_RUNS}), e AS ({_EVAL}) SELECT name, round(resolve_rate - rate, 6) AS delta FROM e, (VALUES ('sonnet_baseline', 0.56::DOUBLE), ('prior', 0.64::DOUBLE), ('opus_sota', 0.627::DOUBLE)) t(name, rate)", views=False)
def baseline_delta(spark, d):
    one = relational.evaluation(_runs(spark, d)).select("resolve_rate")
    rates = F.explode(F.create_map(*(F.lit(x) for kv in {"sonnet_baseline": 0.56, "prior": 0.64, "opus_sota": 0.627}.items() for x in kv))).alias("name", "rate")
    return one.select("resolve_rate", rates).select("name", F.round(F.col("resolve_rate") - F.col("rate"), 6).alias("delta"))


# -- filters and searches


@query("SELECT id, kind, name, filepath, start_line, end_line FROM g_nodes WHERE repo_id = 'r1' AND kind = 'class' AND contains(filepath, 'brand1') AND contains(name, '_1') ORDER BY id LIMIT 100")
def node_filter(spark, d):
    return relational.find_nodes(graph(spark, d).nodes, "r1", "class", "brand1", "_1")


@query("SELECT e.src, e.dst, e.relation, a.repo_id FROM g_edges e JOIN g_nodes a ON a.key = e.src JOIN g_nodes b ON b.key = e.dst WHERE a.repo_id = b.repo_id")
def edge_filter(spark, d):
    return relational.repo_edges(graph(spark, d).nodes, graph(spark, d).outgoing)


@query(f"SELECT e.src, e.dst, e.relation, a.repo_id FROM g_edges e JOIN g_nodes a ON a.key = e.src JOIN g_nodes b ON b.key = e.dst WHERE a.repo_id = 'r2' AND b.repo_id = 'r2' AND e.src = {ROOT} ORDER BY ALL LIMIT 100")
def symbol_edges(spark, d):
    return relational.find_edges(graph(spark, d).nodes, graph(spark, d).outgoing, "r2", ROOT)


@query("SELECT id, name, coalesce(docstring, source_text[1:200]) AS snippet, 0.5::DOUBLE AS score FROM g_nodes WHERE contains(lower(name), 'ring') OR contains(lower(coalesce(docstring, '')), 'ring') OR contains(lower(filepath), 'ring') ORDER BY id LIMIT 20")
def keyword_search(spark, d):
    return relational.keyword_search(graph(spark, d).nodes, "RING")


@query("SELECT id, name FROM g_nodes WHERE contains(lower(coalesce(docstring, '')), 'blue') OR contains(lower(name), 'blue') OR contains(lower(coalesce(docstring, '')), 'bolt') OR contains(lower(name), 'bolt') ORDER BY id LIMIT 20")
def word_or_search(spark, d):
    return relational.word_search(graph(spark, d).nodes, "a blue bolt is")


@query("""SELECT kind, count(*) AS n_total, count_if(CASE WHEN kind = 'class' THEN true WHEN kind IN ('function', 'method') THEN len(string_split(regexp_replace(source_text, '\\n$', ''), chr(10))) >= 10 ELSE false END)::BIGINT AS n_documented FROM g_nodes GROUP BY kind""")
def smart_docs_filter(spark, d):
    n = graph(spark, d).nodes
    return n.groupBy("kind").agg(F.count("*").alias("n_total"), F.sum(F.when(relational.worth_documenting(F.col("kind"), F.col("source_text")), 1).otherwise(0)).alias("n_documented"))


@query("SELECT key, concat_ws(chr(10), kind || ': ' || name, signature, docstring, array_to_string(string_split(source_text, ' ')[1:512], ' ')) AS text FROM g_nodes")
def embedding_text(spark, d):
    return graph(spark, d).nodes.select("key", context.embedding_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring"), context.first_tokens(F.col("source_text"), 512)).alias("text"))


_EPISODES = """+ j AS (SELECT *, coalesce(nullif(docstring, ''), summary, '') AS doc FROM g_nodes LEFT JOIN g_desc ON node_id = key),
l AS (SELECT repo_id, filepath, string_agg(CASE WHEN kind IN ('class', 'function', 'method') THEN coalesce(nullif(signature, ''), kind || ' ' || name) || CASE WHEN doc <> '' THEN chr(10) || '  # ' || doc[1:150] ELSE '' END || chr(10) END, chr(10) ORDER BY start_line, key) AS body FROM j GROUP BY ALL),
t AS (SELECT repo_id, filepath, 'FILE: ' || filepath || chr(10) || coalesce(chr(10) || body, '') AS transcript, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(repo_id || ':file:' || translate(filepath, '/.', '__'))) AS h FROM l)
"""


@query(_EPISODES + """SELECT repo_id, filepath, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[CAST(('0x' || h[17:17])::INT AS INT) % 4 + 1] || h[18:20] || '-' || h[21:32] AS episode_id, 'Code file: ' || filepath AS summary, transcript FROM t WHERE length(transcript) >= 50""")
def episode_transcripts(spark, d):
    return bridge.episodes(graph(spark, d).nodes, tables.descriptions(spark, d))


@query("""+ j AS (SELECT *, concat_ws(' — ', nullif(signature, ''), coalesce(nullif(summary, ''), nullif(docstring[1:200], ''))) AS v FROM g_nodes LEFT JOIN g_desc ON node_id = key WHERE kind IN ('class', 'function', 'method', 'module'))
SELECT key, (kind || '.' || name)[1:80] AS attribute, (CASE WHEN v = '' THEN kind || ' in ' || filepath ELSE v END)[1:400] AS value, 'index:' || repo_id || ':' || filepath AS session_id FROM j""")
def symbol_facts(spark, d):
    return bridge.symbol_facts(graph(spark, d).nodes, tables.descriptions(spark, d))


@query("""+ j AS (SELECT relation, a.name AS a, b.name AS b, row_number() OVER (PARTITION BY relation, a.name ORDER BY b.name, dst, src) AS rn FROM g_edges JOIN g_nodes a ON a.key = src JOIN g_nodes b ON b.key = dst WHERE relation IN ('calls', 'imports', 'inherits'))
SELECT relation || '_dependency' AS attribute, (a || ' → ' || b)[1:200] AS value FROM j WHERE rn <= 3""")
def dependency_facts(spark, d):
    return bridge.dependency_facts(graph(spark, d).nodes, graph(spark, d).outgoing)


# -- vectors, ranks, budgets

_Q = [round(((i * 37) % 64 - 32) / 64, 4) for i in range(64)]
_COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({} AS DOUBLE[])), 5)"


@query(f"SELECT vec_id, label, {_COS.format(_Q)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10", views=False)
def vector_topk(spark, d):
    return relational.nearest(table(spark, d, "embeddings"), _Q)


@query(f"SELECT vec_id, label, {_COS.format(_Q)} AS score FROM embeddings WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT 10", views=False)
def vector_topk_filtered(spark, d):
    return relational.nearest(table(spark, d, "embeddings"), _Q, condition="label in (1, 2)")


_INDEXES: dict[tuple, vector_index.VectorIndex] = {}


def _index(spark, d):
    """The vectors' index, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, d, *stamp(spark, f"{d}/embeddings.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = vector_index.vector_index(table(spark, d, "embeddings"), "embedding", "vec_id")
    return _INDEXES[key]


@query(f"SELECT vec_id, label, {_COS.format(_Q)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10", views=False)
def vector_index_topk(spark, d):
    """vector_topk by the index, exactly."""
    return _index(spark, d).search(_Q, exact=True).select("vec_id", "label", "score")


@query(f"SELECT vec_id, label, {_COS.format(_Q)} AS score FROM embeddings WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT 10", views=False)
def vector_index_filtered(spark, d):
    return _index(spark, d).search(_Q, condition="label in (1, 2)", exact=True).select("vec_id", "label", "score")


_PAIRS = "SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0"


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({_PAIRS}) QUALIFY rank <= 10", views=False)
def vector_index_all(spark, d):
    """The ten nearest of all vectors to each whose number 50 divides, exactly."""
    return _index(spark, d).search_all(_asked(spark, d), exact=True).drop("list")


@query()
def vector_index_probed(spark, d):
    """The same from the nearest lists alone, as many as the index was tuned to; the tests measure its recall."""
    return _index(spark, d).search_all(_asked(spark, d)).drop("list")


@query("SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 42) q WHERE round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) > 0.5", views=False)
def vector_threshold(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 42").select(F.col("embedding").alias("q"))  # one row
    return e.join(F.broadcast(q)).select("vec_id", "label", F.round(relational.cosine(F.col("embedding"), F.col("q")), 5).alias("score")).where("score > 0.5")


@query(f"""SELECT vec_id, round(0.6::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 0.5::DOUBLE ELSE {_COS.format(_Q)} END + 0.4::DOUBLE * CASE WHEN vec_id % 2 = 0 THEN label / 10 ELSE 0.5::DOUBLE END, 5) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 25""", views=False)
def hybrid_rank(spark, d):
    e = table(spark, d, "embeddings").withColumn("s", F.when(F.col("vec_id") % 3 != 0, F.round(relational.cosine(F.col("embedding"), F.array(*map(F.lit, _Q))), 5))).withColumn("i", F.when(F.col("vec_id") % 2 == 0, F.col("label") / 10))
    return e.select("vec_id", F.round(relational.hybrid(F.col("s"), F.lit(None).cast("double"), F.col("i")), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(25)


@query(f"""WITH s AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey)) AS f FROM lineitem GROUP BY 1), q AS (SELECT f AS qf FROM s WHERE id = (SELECT min(l_orderkey) FROM lineitem))
SELECT vec_id AS id, round(0.4::DOUBLE * CASE WHEN len(list_distinct(list_concat(coalesce(f, []), qf))) > 0 THEN len(list_intersect(coalesce(f, []), qf)) / len(list_distinct(list_concat(coalesce(f, []), qf))) ELSE 0 END + 0.6::DOUBLE * {_COS.format(_Q)}, 5) AS score
FROM embeddings LEFT JOIN s ON s.id = vec_id, q ORDER BY score DESC, id LIMIT 3""", views=False)  # fmt: skip
def patch_similarity(spark, d):
    """Vectors are problems, the parts of the order of the same number their patches' files."""
    line = table(spark, d, "lineitem")
    files = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("files"))
    first = line.agg(F.min("l_orderkey").alias("m"))
    q = line.join(F.broadcast(first), line["l_orderkey"] == first["m"]).agg(F.collect_set("l_partkey").alias("qf"))  # one row
    patches = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(files, "id", "left")
    return relational.similar_patches(patches.join(F.broadcast(q)), _Q, "qf")


@query("SELECT doc_id, source, tokens, running FROM (SELECT doc_id, source, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS BIGINT) AS running FROM (SELECT doc_id, source, n_chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS tokens FROM documents)) WHERE running <= 800", views=False)
def token_budget(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", " ")).cast("long").alias("tokens"))
    return relational.within_budget(t, "tokens", ["n_chars", "doc_id"], 800, "source").select("doc_id", "source", "tokens", "running")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text", views=False)
def dedup_first_wins(spark, d):
    return relational.first_per_key(table(spark, d, "documents").select("text", "doc_id"), "text", "doc_id")


@query("SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM g_calls) WHERE rn <= 3")
def capped_dependencies(spark, d):
    return relational.first_n(graph(spark, d).outgoing.where("relation = 'calls'"), ["relation", "src"], ["dst"], 3).select("src", "dst")


# -- text


_LOG = f"WITH {TURNS}, log AS (SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn, trim(text)) AS log FROM m_turns WHERE role = 'assistant' GROUP BY conv_id),"
_SAID = " UNION ALL ".join(f"SELECT conv_id, '{c}' AS class, {k} AS k, unnest(regexp_extract_all(log, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS col, generate_subscripts(regexp_extract_all(log, '{p.replace(chr(39), chr(39) * 2)}', 1), 1) AS pos FROM log" for k, (c, p) in enumerate(analysis.PATTERNS))
_FOUND = f"{_LOG} f AS ({_SAID}), t AS (SELECT conv_id, class, k, pos, regexp_replace(trim(col), '[.,;]+$', '') AS text FROM f), x AS (SELECT conv_id, class, text[1:200] AS text FROM t WHERE length(text) >= 10 QUALIFY row_number() OVER (PARTITION BY conv_id, class, lower(text)[1:60] ORDER BY k, pos) = 1)"


@query(_FOUND + " SELECT * FROM x", views=False)
def journal_extract(spark, d):
    return analysis.extract(tables.turns(spark, d))


_CLASS = "CASE WHEN files <= 1 AND hits = 0 AND n < 100 THEN 'SIMPLE' WHEN files >= 4 OR hits >= 3 OR n >= 300 THEN 'COMPLEX' ELSE 'MODERATE' END"
_PROBLEMS = "SELECT doc_id, doc_id % 6 AS files, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in analysis.CROSS_FILE) + " AS hits, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS n FROM (SELECT item_id + 1000000000 AS doc_id, 'refactor the module, extends import' || text AS text FROM benchmark UNION ALL SELECT doc_id, text FROM documents)"


def _problems(spark, d):
    b = table(spark, d, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), F.concat(F.lit("refactor the module, extends import"), "text").alias("text"))
    return b.union(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", analysis.complexity(F.col("text"), F.col("doc_id") % 6).alias("class"))


@query(f"SELECT doc_id, {_CLASS} AS class FROM ({_PROBLEMS})", views=False)
def complexity_class(spark, d):
    return _problems(spark, d)


_ROUTES = ", ".join(f"('{c}', '{x}', '{t}', '{s}', {m}::DOUBLE)" for c, x, t, s, m in analysis.ROUTES)


@query(f"WITH c AS (SELECT doc_id, {_CLASS} AS class FROM ({_PROBLEMS})) SELECT class, depth, tier, skipped, cost, count(*) AS n FROM c JOIN (VALUES {_ROUTES}) t(class, depth, tier, skipped, cost) USING (class) GROUP BY ALL", views=False)
def routing(spark, d):
    return analysis.routed(_problems(spark, d)).groupBy("class", "depth", "tier", "skipped", "cost").agg(F.count("*").alias("n"))


@query(f"WITH c AS (SELECT doc_id, {_CLASS} AS was FROM ({_PROBLEMS})), u AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN was WHEN was = 'SIMPLE' THEN 'MODERATE' ELSE 'COMPLEX' END AS class FROM c) SELECT doc_id, class, tier FROM u JOIN (VALUES {_ROUTES}) t(class, depth, tier, skipped, cost) USING (class)", views=False)
def routing_escalated(spark, d):
    return analysis.routed(_problems(spark, d).withColumn("failed", F.col("doc_id") % 2 == 0), "failed").select("doc_id", "class", "tier")


_PATCH = "'--- a/x' || chr(10) || '+++ b/src/' || lower(p_type) || '.py' || chr(10) || '@@ -1 +1 @@ def part_' || p_partkey || '(x):' || chr(10) || '-old' || chr(10) || '+import os' || chr(10) || '@@ -9 +9 @@ class Part' || (p_partkey % 7) || chr(10) || '+    pass'"


@query(rf"""WITH p AS (SELECT p_partkey AS id, {_PATCH} AS t FROM part), x AS (SELECT id, 'src/' || regexp_extract(t, 'b/src/(.*)\.py', 1) || '.py' AS files, list_distinct(regexp_extract_all(t, '@@.*@@\s*(?:def|class)\s+(\w+)', 1)) AS s FROM p)
SELECT id, files, array_to_string(list_sort(s), ',') AS symbols, sha256(files || '|' || array_to_string(list_sort(s), ',') || '|bugfix') AS signature FROM x""", views=False)  # fmt: skip
def patch_index(spark, d):
    text = F.concat(F.lit("--- a/x\n+++ b/src/"), F.lower("p_type"), F.lit(".py\n@@ -1 +1 @@ def part_"), "p_partkey", F.lit("(x):\n-old\n+import os\n@@ -9 +9 @@ class Part"), F.col("p_partkey") % 7, F.lit("\n+    pass"))
    found = analysis.patch_index(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("patch")), "id", "patch")
    return found.select("id", F.array_join("files", ",").alias("files"), F.array_join(F.array_sort("symbols"), ",").alias("symbols"), "signature")


_TEST = """'+++ b/tests/t.py' || chr(10) || '+from app.part' || (p_partkey % 9) || ' import load, Part' || chr(10) || '+import util.text' || chr(10) || '+class T(TestCase):' || chr(10) || '+    def test_it(self):' || chr(10) || '+        self.assertEqual(load(' || p_size || '), Part(None))' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '+        assert check(x) == []' ELSE '-        assert gone(x)' END || chr(10)"""


@query(rf"""WITH p AS (SELECT p_partkey AS id, {_TEST} AS t FROM part), s AS (SELECT id, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: x[2:]), chr(10)) AS s FROM p),
x AS (SELECT id, list_concat(regexp_extract_all(s, 'from\s+([\w.]+)\s+import\s+[\w, *]+', 1), regexp_extract_all(s, '(?m)^import\s+([\w.]+)', 1)) AS f,
list_filter(list_distinct(list_concat(list_filter(regexp_extract_all(s, '(?:self\.)?(\w+)\s*\(', 1), lambda n: NOT starts_with(n, 'test_')), regexp_extract_all(s, '\b([A-Z]\w+)\s*\(', 1))), lambda n: n NOT IN ({", ".join(f"'{n}'" for n in analysis.FRAMEWORK)})) AS c,
list_concat(regexp_extract_all(s, '(self\.assert\w+\([^)]*\))', 1), list_transform(regexp_extract_all(s, '(?m)^(\s*assert\s+.+)$', 1), lambda n: trim(n))) AS a, s FROM s)
SELECT id, array_to_string(list_transform(f, lambda n: replace(n, '.', '/') || '.py'), ',') AS tested_files, array_to_string(list_sort(c), ',') AS symbols, array_to_string(a, ';') AS assertions,
array_to_string(list_filter([CASE WHEN regexp_matches(s, '(?:None|null|nil)\b') THEN 'None/null check' END, CASE WHEN regexp_matches(s, '(?:\[\]|\(\)|\{{\}}|\.empty|len\([^)]*\)\s*==\s*0)') THEN 'Empty collection' END, CASE WHEN regexp_matches(s, '(?:\b0\b|\b1\b|\b-1\b|MAX|MIN|boundary)') THEN 'Boundary value' END, CASE WHEN regexp_matches(s, '(?:assertRaises|with\s+self\.assertRaises|pytest\.raises)') THEN 'Exception handling' END], lambda n: n IS NOT NULL), ',') AS edge_cases,
array_to_string(list_sort(list_intersect(c, ['load', 'Part', 'text'])), ',') AS direct FROM x""", views=False)  # fmt: skip
def test_patch_signals(spark, d):
    patch = F.expr(_TEST.replace("chr(10)", "'\n'"))
    found = analysis.test_signals(table(spark, d, "part").select(F.col("p_partkey").alias("id"), patch.alias("patch")), "id", "patch")
    return found.select("id", *(F.array_join(c, ";" if c == "assertions" else ",").alias(c) for c in ("tested_files", "symbols", "assertions", "edge_cases", "direct")))


# -- merges

_OLD = "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg, 1 AS version FROM customer WHERE c_custkey % 3 <> 0)"
_NEW = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN upper(c_name) END AS name, c_acctbal + 1 AS bal, CASE WHEN c_custkey % 7 <> 0 THEN 'NEW' END AS seg, 2 AS version FROM customer WHERE c_custkey % 2 = 0)"


def _old_new(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS bal", "c_mktsegment AS seg", "1 AS version")
    new = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 5 <> 0 THEN upper(c_name) END AS name", "c_acctbal + 1 AS bal", "CASE WHEN c_custkey % 7 <> 0 THEN 'NEW' END AS seg", "2 AS version")
    return old, new


_FULL = f"FROM {_OLD} a FULL JOIN {_NEW} b ON a.id = b.id"


@query(f"SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.name ELSE a.name END AS name, CASE WHEN b.id IS NOT NULL THEN b.bal ELSE a.bal END AS bal, CASE WHEN b.id IS NOT NULL THEN b.seg ELSE a.seg END AS seg, CAST(CASE WHEN b.id IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS version {_FULL}", views=False)
def upsert_nodes(spark, d):
    return relational.upsert(*_old_new(spark, d), ["id"], "version")


@query(ORACLES["upsert_nodes"], views=False)
def upsert_stored(spark, d):
    """upsert_nodes in a stored table, of which the merge rewrites the buckets with new rows."""
    old, new = _old_new(spark, d)
    store = Store(spark, f"{shared_dir(spark)}/skeinwork/store-{uuid.uuid4().hex}")
    with store.change() as change:
        change.put("customer", old, ["id"])
    drop_at_exit(spark, store.path)
    with store.change() as change:
        change.merge("customer", new, ["id"], "version")
    return store.read("customer")


@query(f"SELECT coalesce(b.id, a.id) AS id, coalesce(b.name, a.name) AS name, coalesce(b.bal, a.bal) AS bal, coalesce(b.seg, a.seg) AS seg, CAST(coalesce(b.version, a.version) AS INTEGER) AS version {_FULL}", views=False)
def upsert_coalesce(spark, d):
    return relational.coalesce_merge(*_old_new(spark, d), "id")


@query(f"SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(b.bal, a.bal) AS bal, coalesce(a.seg, b.seg) AS seg, CAST(coalesce(b.version, a.version) AS INTEGER) AS version {_FULL}", views=False)
def preference_merge(spark, d):
    return relational.merge_keeping(*_old_new(spark, d), ["id"], ["bal", "version"])


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderkey % 5 AS v, ['x', o_orderpriority] AS l FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, lower(o_orderstatus) AS s, o_orderkey % 7 AS v, ['a', o_orderpriority] AS l FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL OR b.v > a.v THEN b.s ELSE a.s END AS s, greatest(a.v, b.v) AS v, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))), ',') AS l FROM a FULL JOIN b ON a.id = b.id""", views=False)  # fmt: skip
def decision_merge(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 5).alias("v"), F.array(F.lit("x"), "o_orderpriority").alias("l"))
    b = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lower("o_orderstatus").alias("s"), (F.col("o_orderkey") % 7).alias("v"), F.array(F.lit("a"), "o_orderpriority").alias("l"))
    return relational.list_merge(a, b, "id", ["l"], "v").withColumn("l", F.array_join("l", ","))


# -- contexts

_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@query("""SELECT key, concat_ws(chr(10), '[' || kind || ']', 'Name: ' || name, 'File: ' || filepath, CASE WHEN kind = 'import' AND source_text <> '' THEN 'Code:' || chr(10) || source_text END, CASE WHEN summary <> '' THEN 'Summary: ' || summary END) AS text
FROM g_nodes LEFT JOIN g_desc ON key = node_id""")
def context_text(spark, d):
    n = graph(spark, d).nodes
    j = n.join(tables.descriptions(spark, d).select(F.col("node_id").alias("key"), "summary"), "key", "left")
    source = F.when(F.col("kind") == "import", F.col("source_text"))
    return j.select("key", context.rendered(F.col("kind"), F.col("id"), F.col("name"), F.col("filepath"), source, F.col("summary")).alias("text"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(10), '. '), '. '), lambda s: trim(s, {_BLANK})), lambda s: s <> '')[1:10], '|') AS facts FROM documents", views=False)
def key_facts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(context.key_facts(F.col("text")), "|").alias("facts"))


@query("""SELECT doc_id, CASE WHEN len(string_split(text, ' ')) <= 40 THEN text WHEN contains(cut, '.') AND length(cut) - instr(reverse(cut), '.') > length(cut) // 2 THEN cut[1 : length(cut) - instr(reverse(cut), '.') + 1] ELSE cut END AS text
FROM (SELECT doc_id, text, array_to_string(string_split(text, ' ')[1:40], ' ') AS cut FROM documents)""", views=False)
def truncated_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", context.truncated(F.col("text"), 40).alias("text"))


@query("""SELECT source, substring(string_agg(text, chr(10) ORDER BY score DESC, id), 1, 2000) AS summary, count(*) AS n, CAST(avg(confidence) AS DOUBLE) AS confidence FROM
(SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY score DESC, id) AS running FROM (SELECT source, doc_id AS id, doc_id % 97 AS score, len(string_split(text, ' ')) AS tokens, text, (doc_id % 4) / 4.0 AS confidence FROM documents)) WHERE running <= 2000 GROUP BY source""", views=False)
def context_summaries(spark, d):
    t = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("score"), F.size(F.split("text", " ")).alias("tokens"), "text", ((F.col("doc_id") % 4) / 4.0).alias("confidence"))
    return context.summaries(t, "source", 2000)


@query("SELECT src, dst, a.name || ' (' || relation || ') → ' || b.name AS story FROM g_calls JOIN g_nodes a ON a.key = src JOIN g_nodes b ON b.key = dst")
def path_narratives(spark, d):
    n = graph(spark, d).nodes.select("key", "name")
    j = graph(spark, d).outgoing.where("relation = 'calls'").join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst")
    return j.select("src", "dst", context.narrative(F.array("a", "b"), F.array("relation")).alias("story"))


@query("""SELECT module, CAST(abs(list_reduce(list_transform(string_split(module, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: c + ((h * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 - h, CAST(0 AS BIGINT))) % 360 AS BIGINT) AS hue
FROM (SELECT DISTINCT regexp_replace(filepath, '/[^/]*$', '') AS module FROM g_nodes)""")
def module_hues(spark, d):
    m = graph(spark, d).nodes.select(traversal.module_of(F.col("filepath")).alias("module")).distinct()
    return m.withColumn("hue", context.hue(F.col("module")))


@query(f"SELECT doc_id, coalesce(patch <> '' AND trim(patch, {_BLANK}) = trim(text, {_BLANK}), false) AS resolved FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' || text || chr(10) WHEN 2 THEN lang END AS patch FROM documents)", views=False)
def patch_resolved(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "text", "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('  ', text, '\\n') WHEN 2 THEN lang END AS patch")
    return t.select("doc_id", context.resolved(F.col("patch"), F.col("text")).alias("resolved"))


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY ALL)
SELECT user_id, day, failed, coalesce(failed >= lag(failed) OVER (PARTITION BY user_id ORDER BY day), false) OR row_number() OVER (PARTITION BY user_id ORDER BY day) > 3 AS stop FROM r""", views=False)
def refinement_stops(spark, d):
    r = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("failed"))
    return context.stagnant(r, "user_id", "day", "failed")


@query("SELECT node_id, summary, data_flow FROM g_desc LEFT JOIN g_doc ON node_id = component_id")
def descriptions_with_details(spark, d):
    c = tables.component_docs(spark, d).withColumnRenamed("component_id", "node_id")
    return tables.descriptions(spark, d).join(c, "node_id", "left").select("node_id", "summary", "data_flow")


@query(_COVERED)
def test_coverage(spark, d):
    return docs.tests_of(graph(spark, d).nodes, graph(spark, d).outgoing)


@query("SELECT key FROM g_nodes ANTI JOIN g_desc ON key = node_id")
def resume_pending(spark, d):
    done = tables.descriptions(spark, d).select(F.col("node_id").alias("key"))
    return memory.remaining(graph(spark, d).nodes.select("key"), done, "key")


@query("SELECT src, dst, relation FROM g_edges e WHERE NOT EXISTS (FROM g_nodes n WHERE n.repo_id = 'r1' AND n.key IN (e.src, e.dst))")
def delete_cascade(spark, d):
    gone = graph(spark, d).nodes.where("repo_id = 'r1'").select("key")
    return memory.without(graph(spark, d).outgoing, gone, "src", "dst").select("src", "dst", "relation")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN lang ELSE text[1:120] END WHEN 1 THEN source WHEN 2 THEN text[1:80] || ' → ' || lang WHEN 3 THEN lang || ' = ' || source ELSE source END AS line FROM documents""", views=False)
def memory_summaries(spark, d):
    kind = F.get(F.array(*map(F.lit, ("session", "decision", "attempt", "preference", "convention"))), (F.col("doc_id") % 5).cast("int"))
    row = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("summary"), F.col("text").alias("problem"), F.col("source").alias("title"), F.col("lang").alias("result"), F.col("lang").alias("key"), F.col("source").alias("value"))
    return table(spark, d, "documents").select("doc_id", memory.summary(kind, row).alias("line"))


@query(r"SELECT page_id, regexp_matches(link, '^https://github\.com/[^/\s]+/[^/\s]+/?$') AS valid FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://github.com/a/r' || page_id WHEN 1 THEN url ELSE 'http://github.com/a/b' END AS link FROM pages)", views=False)
def repository_urls(spark, d):
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://github.com/a/r"), "page_id")).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("http://github.com/a/b")
    return table(spark, d, "pages").select("page_id", memory.valid_url(link).alias("valid"))


# -- exports


@query("SELECT id, kind, name, filepath, start_line, end_line, coalesce(docstring, '')[1:100] AS docstring FROM g_nodes")
def export_csv_rows(spark, d):
    return relational.csv_rows(graph(spark, d).nodes)


@query("""+ n AS (SELECT * FROM g_nodes WHERE repo_id = 'r1'), l AS (SELECT 0 AS part, unnest(['digraph G {', '  rankdir=LR;', '  node [shape=box];']) AS line
UNION ALL SELECT 1, '  "' || id || '" [label="' || replace(name, '"', '\\"') || '", style=filled, fillcolor="' || CASE kind WHEN 'class' THEN 'lightblue' WHEN 'function' THEN 'lightgreen' WHEN 'method' THEN 'lightgreen' WHEN 'module' THEN 'lightyellow' WHEN 'import' THEN 'lightgray' ELSE 'white' END || '"];' FROM n
UNION ALL SELECT 2, '  "' || a.id || '" -> "' || b.id || '" [label="' || relation || '"];' FROM g_edges JOIN n a ON a.key = src JOIN n b ON b.key = dst UNION ALL SELECT 3, '}') SELECT * FROM l""")  # fmt: skip
def export_dot_lines(spark, d):
    n = graph(spark, d).nodes.where("repo_id = 'r1'")
    return relational.dot_lines(n, graph(spark, d).outgoing)


@query("""+ e AS (SELECT a.key, b.id AS target, e.relation FROM g_edges e JOIN g_nodes a ON a.key = e.src JOIN g_nodes b ON b.key = e.dst WHERE a.repo_id = b.repo_id),
l AS (SELECT key, list({'target': target, 'relation': relation} ORDER BY target, relation) AS edges FROM e GROUP BY key)
SELECT key, id, CAST(to_json({'id': id, 'kind': kind, 'name': name, 'filepath': filepath, 'edges': coalesce(edges, [])}) AS VARCHAR) AS json FROM g_nodes LEFT JOIN l USING (key)""")
def export_json_rows(spark, d):
    return catalog.json_graph(graph(spark, d).nodes, graph(spark, d).outgoing)


# -- events


@query("""WITH m AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM m GROUP BY user_id, s""", views=False)  # fmt: skip
def sessions_30min(spark, d):
    return analysis.sessions(table(spark, d, "events"))


@query("""WITH m AS (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_id FROM events)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, count(*) AS n_failures, count(*) >= 3 AS tripped FROM m WHERE event_type = 'error' GROUP BY user_id, run_id""", views=False)  # fmt: skip
def breaker_runs(spark, d):
    return analysis.failure_runs(table(spark, d, "events"))


@query("""WITH p AS (SELECT user_id, count(*) AS processed, epoch_us(max(ts)) AS b, epoch_us(min(ts)) AS a FROM events GROUP BY user_id)
SELECT user_id, processed, round(100.0::DOUBLE * processed / 100, 4) AS percent, CASE WHEN processed < 100 THEN round((100 - processed) * ((b - a) / 1e6::DOUBLE) / processed, 2) ELSE 0.0::DOUBLE END AS eta FROM p""", views=False)  # fmt: skip
def progress_eta(spark, d):
    return analysis.progress(table(spark, d, "events"), 100)


_RECORDS = """WITH p AS (SELECT p_partkey AS k, 'src/m' || p_partkey || '.py' AS f FROM part), i AS (SELECT *, 'repo:' || f || ':' AS i, i || 'class:A' || k % 13 AS c, i || 'module:m' || k AS m FROM p), j AS (SELECT *, unnest(range(k % 3 + 1)) AS j FROM i),
n AS (SELECT k, 'node' AS rec_type, m AS a, 'm' || k AS b FROM i UNION ALL SELECT k, 'node', i || 'import:lib' || k % 11, 'lib' || k % 11 FROM i UNION ALL SELECT k, 'node', c, 'A' || k % 13 FROM i UNION ALL SELECT k, 'node', i || 'method:f' || j, 'f' || j FROM j UNION ALL SELECT k, 'node', i || 'variable:v' || k % 5, 'v' || k % 5 FROM i),
e AS (SELECT k, 'edge', m, c FROM i UNION ALL SELECT k, 'edge', c, i || 'method:f' || j FROM j UNION ALL SELECT k, 'edge', c, i || 'class:B' || k % 7 FROM i UNION ALL SELECT k, 'edge', i || 'method:f' || j, i || 'function:g' || k % 17 FROM j UNION ALL SELECT k, 'edge', m, unnest([i || 'import:lib' || k % 11, i || 'import:lib' || k % 11]) FROM i UNION ALL SELECT k, 'edge', m, i || 'variable:v' || k % 5 FROM i)
SELECT rec_type, a, b FROM (SELECT * FROM n UNION ALL SELECT * FROM e)"""
_SOURCE = r"""concat('import lib', k % 11, '\nv', k % 5, ' = 1\nclass A', k % 13, '(B', k % 7, '):\n',
concat_ws('', transform(sequence(0, k % 3), j -> concat('    def f', j, '(self, x=1):\n        self.y = 2\n        return g', k % 17, '(x)\n'))))"""


@query(_RECORDS, views=False)
def parser_records(spark, d):
    """Records of a source for each part, of one to three methods: nodes with their names, edges with their ends."""
    from skeinwork.functions.parsers import parse_files

    p = table(spark, d, "part").selectExpr("p_partkey AS k").select(F.concat(F.lit("src/m"), "k", F.lit(".py")).alias("filepath"), F.lit("python").alias("language"), F.expr(_SOURCE).alias("source"))
    found = parse_files(p, "repo")
    edge = F.col("rec_type") == "edge"
    return found.select("rec_type", F.when(edge, F.col("source_id")).otherwise(F.col("id")).alias("a"), F.when(edge, F.col("target_id")).otherwise(F.col("name")).alias("b"))


import skeinwork.plans.memory_queries  # noqa: E402, F401
import skeinwork.plans.service_queries  # noqa: E402, F401
