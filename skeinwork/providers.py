"""Models as functions over columns: embeddings and chat answers by a provider, with retries, and stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES, FIRST_WAIT, BATCH = 3, 2.0, 100


class Embedder(Protocol):
    """Gives vectors of `dimensions` numbers for texts."""

    dimensions: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    """Gives an answer to a prompt."""

    def __call__(self, prompt: str) -> str: ...


def retried(call: Callable[[], Any], retries: int = RETRIES, first: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What call() gives; after a failure it's called again, `retries` times in all, behind waits that double and vary by up to a second."""
    for attempt in range(retries):
        try:
            return call()
        except Exception:
            if attempt == retries - 1:
                raise
            sleep(first * 2**attempt + random.random())


class HashedWords:
    """A stand-in without a model: words and their pairs hashed to signed places, weighted by the logarithm of their counts, of length one."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words, counts = re.findall(r"\w+", (text or "").lower()), {}
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                counts[w] = counts.get(w, 0) + 1
            v = [0.0] * self.dimensions
            for w, n in counts.items():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += (1 if h >> 63 else -1) * math.log1p(n)
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size if size else 0.0 for x in v])
        return out


def embedded(rows: DataFrame, text: str, embedder: Embedder, column: str = "vector", batch: int = BATCH) -> DataFrame:
    """rows with the vectors of a text column, asked for `batch` at a time with retries; a vector of another length is an error."""

    @F.pandas_udf("array<double>")
    def run(texts):
        import pandas as pd

        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            some = [x or "" for x in texts.iloc[i : i + batch]]
            found = retried(lambda some=some: embedder(some))
            if len(found) != len(some) or any(len(v) != embedder.dimensions for v in found):
                raise ValueError(f"vectors must have length {embedder.dimensions}")
            out += found
        return pd.Series(out, dtype=object)

    return rows.withColumn(column, run(F.col(text).cast("string")))


def answered(prompt: Column, chat: Chat) -> Column:
    """The answers to a column of prompts; null where a provider fails for good."""

    @F.pandas_udf("string")
    def run(prompts):
        import pandas as pd

        def one(p: str | None) -> str | None:
            try:
                return None if p is None else retried(lambda: chat(p))
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(p) for p in prompts], dtype=object)

    return run(prompt)


def json_items(text: str | None) -> list[dict]:
    """The objects of a JSON array in an answer, which may have words around it; none if there is no array."""
    for found in (text or "", (re.search(r"\[.*\]", text or "", re.DOTALL) or [""])[0]):
        try:
            items = json.loads(found)
        except ValueError:
            continue
        return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    return []


class Rules:
    """A stand-in for a chat model that documents symbols: answers with JSON made of the prompt's own lines 'key: value'."""

    def __call__(self, prompt: str) -> str:
        known = dict(line.split(": ", 1) for line in prompt.split("\n") if ": " in line)
        name, kind = known.get("name", "it"), known.get("kind", "symbol")
        calls = [x for x in known.get("calls", "").split(",") if x]
        return json.dumps({
            "summary": known.get("docstring") or f"{kind} {name}", "responsibilities": [f"implements {name}"], "dependencies": calls,
            "algorithm_description": f"{name} in {known.get('lines', '?')} lines", "data_flow": f"{known.get('signature', name)} calls {', '.join(calls) or 'nothing'}", "error_handling": "raises" if "raise" in known.get("source", "") else "none", "edge_cases": [],
            "architectural_role": f"module of {known.get('symbols', '?')} symbols", "design_patterns": [], "integration_points": calls, "quality_attributes": [],
        })


DESCRIPTION = "node_id string, summary string, responsibilities array<string>, dependencies array<string>"
DETAIL = "component_id string, algorithm_description string, data_flow string, error_handling string, edge_cases array<string>"
MODULE = "module_path string, architectural_role string, design_patterns array<string>, integration_points array<string>, quality_attributes array<string>"


def documented(prompts: DataFrame, schema: str, chat: Chat) -> DataFrame:
    """Rows of a documentation layer from prompts (id, prompt): answers are JSON objects of the schema's fields behind the id; an answer that isn't gives no row."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [pa.list_(pa.string()) if c.endswith("array<string>") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, prompt in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                try:
                    answer = json.loads(retried(lambda p=prompt: chat(p)))
                    rows.append({names[0]: i, **{n: [str(x) for x in answer.get(n) or []] if k != pa.string() else str(answer.get(n) or "") for n, k in zip(names[1:], kinds[1:])}})
                except Exception:  # noqa: BLE001
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds))))

    return prompts.select(F.col("id").cast("string"), F.col("prompt").cast("string")).mapInArrow(run, schema)


def symbol_prompts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A prompt for each symbol that is worth documenting: its fields as lines, and the names that it calls (50 at most)."""
    from skeinwork.operators.relational import first_n, worth_documenting

    names = nodes.select(F.col("key").alias("dst"), F.col("name").alias("callee"))
    calls = first_n(edges.where("relation = 'calls'").join(names, "dst"), ["src"], ["callee"], 50).groupBy(F.col("src").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("calls"))
    some = nodes.where(worth_documenting(F.col("kind"), F.col("source_text"))).join(calls, "key", "left")
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    return some.select("id", F.concat_ws("\n", line("name", F.col("name")), line("kind", F.col("kind")), line("signature", F.col("signature")), line("docstring", flat(F.col("docstring"))), line("calls", F.col("calls")), line("source", F.substring(flat(F.col("source_text")), 1, 2000))).alias("prompt"))


def detail_prompts(desc: DataFrame, nodes: DataFrame) -> DataFrame:
    """A prompt for each described symbol (node_id, summary): what the next layer details."""
    j = desc.join(nodes.select(F.col("key").alias("node_id"), "id", "name", "kind", "signature", "start_line", "end_line"), "node_id")
    lines = F.concat(F.lit("lines: "), (F.col("end_line") - F.col("start_line") + 1).cast("string"))
    return j.select("id", F.concat_ws("\n", F.concat(F.lit("name: "), "name"), F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("signature: "), "signature"), lines, F.concat(F.lit("summary: "), F.regexp_replace(F.substring("summary", 1, 2000), r"\s+", " "))).alias("prompt"))


def module_prompts(nodes: DataFrame, most: int = 50) -> DataFrame:
    """A prompt for each module (directory): how many symbols it has and the names of the first `most`."""
    from skeinwork.operators.relational import first_n
    from skeinwork.operators.traversal import module_of

    m = nodes.select(module_of(F.col("filepath")).alias("id"), "name")
    n = m.groupBy("id").agg(F.count("*").alias("n"))
    names = first_n(m, ["id"], ["name"], most).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return n.join(names, "id").select("id", F.concat_ws("\n", F.concat(F.lit("name: "), "id"), F.concat(F.lit("symbols: "), F.col("n").cast("string")), F.concat(F.lit("calls: "), "names")).alias("prompt"))


def patch_patterns(patches: DataFrame, embedder: Embedder) -> DataFrame:
    """Solved problems (instance_id, patch, problem_statement; the last by `at` of each id) as patterns: files, symbols, signature and the problem's vector."""
    from skeinwork.operators.analysis import patch_index

    newest = patches.groupBy("instance_id").agg(F.max_by(F.struct("patch", "problem_statement"), "at").alias("x")).select("instance_id", "x.*")
    return embedded(patch_index(newest, "instance_id", "patch").join(newest.select("instance_id", "problem_statement"), "instance_id"), "problem_statement", embedder)


def token_count(text: Column, ranks: str, pattern: str) -> Column:
    """Tokens of texts by a byte-pair vocabulary: ranks is the path of its file, pattern what cuts texts into words. Special tokens are ordinary text."""

    @F.pandas_udf("long")
    def run(texts):
        import pandas as pd

        encode = _encoding(ranks, pattern).encode_ordinary
        return pd.Series([None if x is None else len(encode(x)) for x in texts], dtype="Int64")

    return run(text)


def truncated(text: Column, most: int, ranks: str, pattern: str) -> Column:
    """A text of more than `most` tokens is cut there, at its last full stop if that is in the second half of what is left."""

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        e = _encoding(ranks, pattern)

        def one(x: str | None) -> str | None:
            ids = e.encode_ordinary(x or "")
            if x is None or len(ids) <= most:
                return x
            cut = e.decode(ids[:most])
            dot = cut.rfind(".")
            return cut[: dot + 1] if dot > len(cut) // 2 else cut

        return pd.Series([one(x) for x in texts], dtype=object)

    return run(text)


_encodings: dict[tuple[str, str], Any] = {}


def _encoding(ranks: str, pattern: str):
    if (ranks, pattern) not in _encodings:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
    return _encodings[ranks, pattern]
