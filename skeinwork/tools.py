"""One façade over the operators: a tool's name and its arguments give a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.parsers import Registry, parse_repository
from skeinwork.operators import analysis, catalog, docs, journal, memory, relational, search, traversal
from skeinwork.sources import files, tables


@dataclass
class Graph:
    """The tables that tools read. memory: by type (session, preference, decision, attempt, convention), with data and summary for searches."""

    nodes: DataFrame
    edges: DataFrame
    desc: DataFrame
    docs: DataFrame
    arch: DataFrame
    embeddings: DataFrame | None = None
    memory: dict[str, DataFrame] = field(default_factory=dict)
    embed: Callable[[str], list[float]] | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Graph:
        from skeinwork.plans.memory_queries import _tables

        vectors = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
        return cls(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), tables.descriptions(spark, sf_dir), tables.component_docs(spark, sf_dir), tables.architecture(spark, sf_dir), vectors, _tables(spark, sf_dir))


def raw_query(graph: Graph, text: str, args: dict | None = None) -> DataFrame:
    """SQL over the views nodes, edges, descriptions, details and architecture, with named parameters."""
    spark = graph.nodes.sparkSession
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("descriptions", graph.desc), ("details", graph.docs), ("architecture", graph.arch)):
        df.createOrReplaceTempView(name)
    return spark.sql(text, args or {})


def index_repository(spark: SparkSession, root: str, repo_id: str, languages: tuple[str, ...] = (), known: DataFrame | None = None, registry: Registry | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and hashes (file_path, file_hash) of a source tree. known: hashes of an earlier run; then only files that are new or changed are parsed."""
    found = files.source_files(spark, root, languages)
    hashes = found.select(F.col("filepath").alias("file_path"), F.col("sha256").alias("file_hash"))
    if known is not None:
        status = relational.diff(hashes, known, "file_path", "file_hash").where("status in ('new', 'changed')")
        found = found.join(status.select(F.col("file_path").alias("filepath")), "filepath", "left_semi")
    nodes, edges = parse_repository(found, repo_id, registry)
    return nodes, edges, hashes


def _impact(g: Graph, changed_files: list, max_depth: int = 3) -> DataFrame:
    return traversal.blast_radius(g.edges, g.nodes.where(F.col("filepath").isin(changed_files)), max_depth)


def _remember(g: Graph, node_type: str, data: DataFrame, author: str = "") -> DataFrame:
    if node_type not in memory.SCOPES:
        raise ValueError(f"no memory of type {node_type!r}")
    rows = data.withColumn("author", F.coalesce("author", F.lit(""))) if "author" in data.columns else data.withColumn("author", F.lit(""))
    known = g.memory[node_type].select(*[c for c in g.memory[node_type].columns if c in rows.columns])
    return memory.remembered(known, rows, author, team=False)


def _decisions(g: Graph, module_or_component: str = "", repo_id: str = "", include_reverted: bool = False, limit: int = 20) -> DataFrame:
    d = g.memory["decision"]
    return memory.for_module(d, module_or_component).limit(limit) if module_or_component else memory.decisions(d, repo_id, limit, include_reverted)


def _context(g: Graph, repo_id: str, author: str = "", log: str = "") -> DataFrame:
    m = g.memory
    return memory.context_block(m["decision"], m["attempt"], m["preference"], log, repo_id, author)


#: Tool: (required arguments with their types, function).
TOOLS: dict[str, tuple[dict[str, type], Callable[..., DataFrame]]] = {
    "architecture_context": ({"query": str, "repo_id": str}, lambda g, query, repo_id: docs.context(g.nodes, g.edges, g.desc, g.docs, g.arch, query, repo_id)),
    "trace": ({"source": str, "repo_id": str}, lambda g, source, repo_id, target_level="architecture": docs.trace(g.nodes, g.desc, g.docs, g.arch, source, repo_id, target_level)),
    "impact_analysis": ({"changed_files": list}, _impact),
    "search": ({"query": str, "repo_id": str}, lambda g, query, repo_id, search_type="semantic", top_k=10: search.search(g.nodes, g.embeddings, query, repo_id, search_type, top_k, g.embed)),
    "keyword_search": ({"query": str}, lambda g, query, limit=20: relational.keyword_search(g.nodes, query, limit)),
    "callers": ({"key": int}, lambda g, key, depth=1: traversal.callers(g.nodes, g.edges, key, depth)),
    "callees": ({"key": int}, lambda g, key, depth=1: traversal.callees(g.nodes, g.edges, key, depth)),
    "symbol_impact": ({"key": int}, lambda g, key: traversal.impact(g.nodes, g.edges, g.nodes.where(F.col("key") == key))),
    "symbol_trace": ({"key": int}, lambda g, key: docs.traceability(g.nodes.where(F.col("key") == key), g.edges, g.desc, g.docs, g.arch)),
    "nodes": ({}, lambda g, **filters: relational.find_nodes(g.nodes, **filters)),
    "edges": ({"repo_id": str}, lambda g, repo_id, source=None, limit=100: relational.find_edges(g.nodes, g.edges, repo_id, source, limit)),
    "statistics": ({}, lambda g: relational.by_kind(g.nodes)),
    "repositories": ({}, lambda g: relational.repositories(g.nodes, g.edges)),
    "compare": ({"repo_ids": list}, lambda g, repo_ids: relational.compare(g.nodes, repo_ids)),
    "export_csv": ({"repo_id": str}, lambda g, repo_id: relational.csv_rows(g.nodes.where(F.col("repo_id") == repo_id))),
    "export_json": ({"repo_id": str}, lambda g, repo_id: catalog.json_graph(g.nodes.where(F.col("repo_id") == repo_id), g.edges)),
    "export_dot": ({"repo_id": str}, lambda g, repo_id: relational.dot_lines(g.nodes.where(F.col("repo_id") == repo_id), g.edges)),
    "query": ({"text": str}, raw_query),
    "remember": ({"node_type": str, "data": DataFrame}, _remember),
    "history": ({"file_or_symbol": str}, lambda g, file_or_symbol, limit=10: memory.found(g.memory, file_or_symbol, limit=limit)),
    "decisions": ({}, _decisions),
    "attempts": ({"problem_query": str}, lambda g, problem_query, result_filter="", limit=10: memory.similar_attempts(g.memory, problem_query, result_filter, limit)),
    "memory_search": ({"query": str}, lambda g, query, repo_id="", scope="", limit=20: memory.found(g.memory, query, repo_id, scope, limit)),
    "sync": ({"node_type": str, "theirs": DataFrame}, lambda g, node_type, theirs: relational.list_merge(g.memory[node_type].select(*theirs.columns), theirs, "id", [c for c, t in theirs.dtypes if t.startswith("array")], "updated_at")),
    "journal_append": ({"turns": DataFrame}, lambda g, turns: turns.select("session_id", "ts", journal.turn_entry(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("role"), F.col("content")).alias("entry"))),
    "journal_compact": ({"logs": DataFrame, "turns": DataFrame}, lambda g, logs, turns, force=False: journal.compacted(logs, "conv_id", "text", journal.promotion_counts(turns), 0 if force else journal.THRESHOLD)),
    "get_context": ({"repo_id": str}, _context),
    "session_end": ({"turns": DataFrame}, lambda g, turns: analysis.extract(turns)),
}
for alias, name in (("traceability", "trace"), ("impact", "impact_analysis"), ("architecture", "architecture_context")):
    TOOLS[alias] = TOOLS[name]

_JSON = {str: "string", int: "integer", list: "array", DataFrame: "object"}


def schemas() -> dict[str, dict]:
    """For every tool the JSON schema of its required arguments."""
    return {name: {"type": "object", "properties": {k: {"type": _JSON[t]} for k, t in required.items()}, "required": list(required)} for name, (required, _) in TOOLS.items()}


def dispatch(graph: Graph, tool: str, arguments: dict) -> DataFrame:
    """Run a tool. Unknown tools, missing arguments and arguments of another type are refused."""
    if tool not in TOOLS:
        raise KeyError(f"no tool {tool!r}")
    required, function = TOOLS[tool]
    for name, kind in required.items():
        if name not in arguments:
            raise ValueError(f"{tool} needs {name}")
        if not isinstance(arguments[name], kind):
            raise TypeError(f"{tool}: {name} must be {kind.__name__}")
    return function(graph, **arguments)


Agents = dict[str, Callable[[Graph, str, str], DataFrame]]
#: Agents of sub-tasks: what a task's first query is asked of. An impact task's query names files by a part of their path.
AGENTS: Agents = {
    "architecture": lambda g, query, repo_id: dispatch(g, "architecture_context", {"query": query, "repo_id": repo_id}),
    "trace": lambda g, query, repo_id: dispatch(g, "trace", {"source": query, "repo_id": repo_id}),
    "impact": lambda g, query, repo_id: traversal.blast_radius(g.edges, g.nodes.where(F.col("filepath").contains(query) & (F.col("repo_id") == repo_id))),
    "search": lambda g, query, repo_id: dispatch(g, "search", {"query": query, "repo_id": repo_id}),
}


def planned(problem: str, tasks: list[dict], nodes: DataFrame, symbols: list[str], most: int = 5) -> list[dict]:
    """A plan's tasks (task_id, description, search_queries, target_agent, priority, depends_on) that are supported by symbols, with searches for tested
    symbols; without any a search for the problem; of more than `most` those of the smallest priority."""
    from skeinwork.operators.context import supported, with_signals

    by_id = {t["task_id"]: t for t in tasks}
    kept = supported(nodes, [(t["task_id"], t["search_queries"], t["target_agent"]) for t in tasks])
    out = []
    for task_id, queries, agent in with_signals(kept, symbols):
        out.append(by_id.get(task_id) or {"task_id": task_id, "description": f"Search for {queries[0]}", "search_queries": queries, "target_agent": agent, "priority": 0, "depends_on": []})
    if not out:
        out = [{"task_id": "subtask-fallback", "description": f"Search for: {problem[:200]}", "search_queries": [problem[:200]], "target_agent": "search", "priority": 1, "depends_on": []}]
    return sorted(out, key=lambda t: t["priority"])[:most] if len(out) > most else out


PROMPT = "List three to five things to find in the code for this problem, as a JSON array of objects with description, search_query, agent (architecture, trace, impact or search) and depends_on (places in the array).\n\nProblem: {problem}"


def decomposed(problem: str, chat: Callable[[str], str] | None, nodes: DataFrame, symbols: list[str] = ()) -> list[dict]:
    """A plan for a problem from a model's answer, checked and completed by planned(); without a model or an answer it's a search for the problem."""
    from skeinwork.providers import json_items, retried

    try:
        items = json_items(retried(lambda: chat(PROMPT.format(problem=problem[:1000])))) if chat else []
    except Exception:  # noqa: BLE001
        items = []
    ids = [f"subtask-{k}" for k in range(len(items))]
    tasks = [
        {
            "task_id": ids[k], "description": str(x.get("description", "")), "search_queries": [q] if (q := str(x.get("search_query") or "")) else [], "target_agent": x.get("agent") if x.get("agent") in AGENTS else "search",
            "priority": k + 1, "depends_on": [ids[d] for d in x.get("depends_on") or [] if isinstance(d, int) and 0 <= d < len(ids) and d != k],
        }
        for k, x in enumerate(items)
    ]
    return planned(problem, tasks, nodes, list(symbols))


def executed(graph: Graph, tasks: list[dict], repo_id: str, agents: Agents | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results of a plan's tasks, group after group, and what went wrong with others: an unknown agent, or an error, which doesn't stop the rest."""
    agents, by_id = agents or AGENTS, {t["task_id"]: t for t in tasks}
    results, failures = {}, {}
    for group in traversal.plan_levels([(t["task_id"], t["depends_on"], t["priority"]) for t in tasks]):
        for task_id in group:
            task = by_id[task_id]
            agent = agents.get(task["target_agent"])
            if agent is None:
                failures[task_id] = f"no agent {task['target_agent']!r}"
                continue
            try:
                results[task_id] = agent(graph, (task["search_queries"] or [task["description"]])[0], repo_id)
            except Exception as error:  # noqa: BLE001
                failures[task_id] = str(error)
    return results, failures
