"""Near-duplicates by the Jaccard similarity of five-word shingles: SimHash and Golay keys, joined by minhash keys, verified inside the keys, then by whole sets.

Texts whose sets of shingles have a similarity of LEAST or more are linked; components of linked texts are found:

1. Texts of one set are a class, named by a hash of the set. Only classes enter the next steps.
2. Candidates are linked inside keys. Classes whose sets' SimHash fingerprints are within two bits are linked by Golay keys, as in simhash. Beside these a class has BANDS
   keys of ROWS minima each of the set's permutations: a pair at similarity s shares one of these with probability 1 - (1 - s ** ROWS) ** BANDS, 0.999997 at
   0.8 and more above it. Golay keys alone can't do it: at 0.8 a fingerprint's bits differ with probability 0.15, ten of 64. Members of a band's key are
   linked if their sketches (a byte of each minimum) are near: a member that is within NEAR of no representative becomes one, and a member is linked with all that are within
   2 * NEAR, so by the triangle inequality two members within NEAR, as pairs at 0.8 are but for one in a million, are linked. Members that only share a key stay apart. A key of
   more than CAP members links them all: no task holds more, and no link is lost.
3. Components of these links are candidates. A component is cut into parts of about PART classes, and every two parts come together in a task, which compares
   classes that share a key by their whole sets until they are in one component. So every pair of candidates that shares a key is compared or already joined, a
   task never holds more than two parts, and pairs are never rows.
4. Components of the true links are found as in simhash.

Defined cases: words are white-space bytes apart, A-Z in lower case; fewer words than a shingle are one shingle; null and wordless texts
are one class, linked to no other; rows with a null doc_id are told apart by their text; repeated rows are one class; an empty table gives no rows;
texts of any length are read whole; columns other than doc_id and text, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import Work, spread_join, text_slices, utf8, written
from skeinwork.llm.simhash import SEED, _mixed, components, golay_keys, links, majority

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 32, 5
#: Classes of a candidate component that are compared in one task with as many others.
PART = 128
#: Members of a key that a task holds; the share of a sketch's bytes in which two members that are near may differ.
CAP, NEAR = 4096, 0.35

_random = np.random.default_rng(SEED)
FLIPS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
FACTORS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
WEIGHTS = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
del _random

TEXT = "coalesce(CAST(text AS STRING), '')"
#: What finds a row's text again: its doc_id, or a hash of the text.
ID = f"coalesce(CAST(doc_id AS BIGINT), xxhash64({TEXT}))"


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of hashes of a UTF-8 text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and white space alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    found = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxh64_intdigest, found, repeat(SEED)), dtype=np.uint64, count=n))


def class_of(grams: np.ndarray) -> int:
    """A set's name, as a signed long."""
    from xxhash import xxh64_intdigest

    found = xxh64_intdigest(grams.tobytes(), SEED)
    return found - (1 << 64) if found >> 63 else found


def fuzzy_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The Golay keys of each set's fingerprint; none of the empty set."""
    full = [i for i, s in enumerate(sets) if len(s)]
    keys, of = golay_keys(np.array([majority(sets[i]) for i in full], dtype=np.uint64).view(np.int64))
    keys = _mixed(keys.view(np.uint64) + np.uint64(SEED))
    order = np.argsort(of, kind="stable")
    out = [np.zeros(0, dtype=np.int64)] * len(sets)
    for i, some in zip(full, np.split(keys[order], np.cumsum(np.bincount(of, minlength=len(full)))[:-1])):
        out[i] = some
    return out


def minima(grams: np.ndarray) -> np.ndarray:
    """The least image of a set under each permutation."""
    low, least = (grams >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 1024):
        mixed = (low[None, i : i + 1024] ^ FLIPS[:, None]) * FACTORS[:, None]
        np.minimum(least, (mixed ^ mixed >> np.uint32(15)).min(axis=1), out=least)
    return least


def keys_of(grams: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """The band keys of a set; none of the empty set."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    least = minima(grams) if least is None else least
    bands = (least.reshape(BANDS, ROWS).astype(np.uint64) * WEIGHTS[None, :]).sum(axis=1, dtype=np.uint64)
    return _mixed(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets that aren't empty."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < LEAST * len(b):
        return len(a) / len(b)  # at most this
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """id, doc_id, cls, fp, keys and sketch of every row; no keys of the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in text_slices(batch, 2):
                sets = [shingles(x) for x in raw]
                least = [minima(s) for s in sets]
                fps = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
                keys = [keys_of(s, m) for s, m in zip(sets, least)]
                columns = [pa.array(map(class_of, sets), pa.int64()), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array([m.astype(np.uint8).tobytes() for m in least], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "doc_id", "cls", "fp", "keys", "sketch"])

    rows = docs.select(F.expr(ID).alias("id"), F.expr("CAST(doc_id AS BIGINT)").alias("doc_id"), F.expr(TEXT).alias("text"))
    return rows.mapInArrow(run, "id long, doc_id long, cls long, fp long, keys array<long>, sketch binary")


def true_links(cls: list[int], sets: list[np.ndarray], parts: list[int], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges between classes of different parts (of any, if there is but one) that share a key and are as similar as asked: enough of them for the components of all such."""
    root, one = list(range(len(cls))), len(set(parts)) < 2

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    members: dict[int, list[int]] = {}
    for i, (fuzzy, s) in enumerate(zip(fuzzy_keys(sets), sets)):
        for k in {*fuzzy.tolist(), *keys_of(s).tolist()}:
            members.setdefault(k, []).append(i)
    out, seen = [], set()
    for of in members.values():
        groups: dict[int, list[int]] = {}
        for i in of:
            for r in list(groups):
                if find(r) != find(i):
                    for j in groups[r]:
                        if (one or parts[i] != parts[j]) and (pair := (min(i, j), max(i, j))) not in seen:
                            seen.add(pair)
                            if similarity(sets[i], sets[j]) >= least:
                                root[find(i)] = find(j)
                                out.append((cls[i], cls[j]))
                                break
            # groups that have become one are held as one, so its members aren't met again
            mine, me = [i], find(i)
            for r in [r for r in groups if find(r) == me]:
                mine += groups.pop(r)
            groups[me] = mine
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (task, cls, part, text) sorted by task: true links."""
    task, held = None, {}

    def close() -> pa.RecordBatch:
        found = true_links(list(held), [s for _, s in held.values()], [p for p, _ in held.values()])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            for t, cls, p, raw in zip(*(part.column(k).to_pylist() for k in range(3)), utf8(part.column(3))):
                if t != task:
                    yield close()
                    task, held = t, {}
                if cls not in held and class_of(grams := shingles(raw)) == cls:  # ids may repeat
                    held[cls] = (p, grams)
    yield close()


def _dealt(candidates: DataFrame, size: int = PART) -> DataFrame:
    """task, cls and part of candidates (cls, comp): a class is in a task for every pair of its component's parts that its own is in."""
    n = candidates.groupBy("comp").count().select("comp", F.ceil(F.col("count") / size).cast("long").alias("parts"))
    rows = spread_join(candidates, n, "comp", "cls").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.xxhash64("comp", F.least("part", q), F.greatest("part", q)))
    return rows.select(F.explode(others).alias("task"), "cls", "part")


def near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (key, cls, sketch) sorted by key: links between members whose sketches are near, enough of them for the components of all such."""
    key, a, b = None, [], []
    reps, names, root = np.zeros((0, BANDS * ROWS), np.uint8), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for batch in batches:
        for k, cls, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                key, names, root = k, [], []
            mine = np.frombuffer(sketch, np.uint8)
            off = np.count_nonzero(reps[: len(names)] != mine, axis=1)
            near = np.flatnonzero(off <= 2 * NEAR * len(mine)).tolist()
            if near:
                a.append(cls), b.append(names[near[0]])
                for i in near[1:]:
                    x, y = find(near[0]), find(i)
                    if x != y:
                        root[y] = x
                        a.append(cls), b.append(names[i])
            if not len(off) or off.min() > NEAR * len(mine):
                if len(names) == len(reps):
                    reps = np.concatenate([reps, np.zeros((max(16, len(reps)), BANDS * ROWS), np.uint8)])
                reps[len(names)] = mine
                root.append(find(near[0]) if near else len(names))
                names.append(cls)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []


def candidate_links(classes: DataFrame, work: Work, cap: int = CAP) -> DataFrame:
    """Links (a, b) between classes (cls, fp, keys, sketch) that may be as similar as asked: near fingerprints by Golay keys, near sketches inside the bands' keys."""
    some = classes.where(F.size("keys") > 0)
    named = work.put(some.groupBy("fp").agg(F.min("cls").alias("name")), "jaccard-fingerprints")
    same = spread_join(some.select("fp", "cls"), named, "fp", "cls").where("cls <> name").select(F.col("cls").alias("a"), F.col("name").alias("b"))
    fuzzy = work.put(links(named.select("fp"), work), "jaccard-golay")
    for end in ("a", "b"):
        fuzzy = spread_join(fuzzy, named.toDF(end, "_name"), end, "a" if end == "b" else "b").drop(end).withColumnRenamed("_name", end)
        fuzzy = work.put(fuzzy.select("a", "b"), "jaccard-golay")
    bands = some.select(F.explode("keys").alias("key"), "cls")
    shared = bands.groupBy("key").agg(F.min("cls").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = work.put(spread_join(bands, shared, "key", "cls"), "jaccard-members")
    large = members.where((F.col("n") > cap) & (F.col("cls") != F.col("least"))).select(F.col("cls").alias("a"), F.col("least").alias("b"))
    small = members.where(F.col("n") <= cap).select("key", "cls").join(some.select("cls", "sketch").hint("merge"), "cls").select("key", "cls", "sketch")
    near = small.repartition("key").sortWithinPartitions("key").mapInArrow(near_members, "a long, b long")
    return same.union(fuzzy).union(large).union(near).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """id, doc_id, cls and head (the component's smallest linked class) of every row."""
    marked = written(sketches(docs), "jaccard-sketches")
    with Work(docs.sparkSession) as work:
        classes = work.put(marked.groupBy("cls").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "jaccard-classes")
        near = components(work.put(candidate_links(classes, work), "jaccard-candidate-links"))
        candidates = work.put(near.select(F.col("a").alias("cls"), F.col("b").alias("comp")).union(near.select("b", "b").distinct()), "jaccard-candidates")
        wanted = spread_join(_dealt(candidates), marked.groupBy("cls").agg(F.min("id").alias("rep")), "cls", "task")
        # a sort-merge join at every size: the candidates grow with the documents and mustn't be broadcast
        texts = docs.select(F.expr(ID).alias("rep"), F.expr(TEXT).alias("text")).join(wanted.hint("merge"), "rep").select("task", "cls", "part", "text")
        found = work.put(texts.repartition("task").sortWithinPartitions("task").mapInArrow(_verified, "a long, b long"), "jaccard-links")
        label = components(found).select(F.col("a").alias("cls"), F.col("b").alias("head"))
    rows = marked.select("id", "doc_id", "cls")
    return spread_join(rows, label, "cls", "id", "left").select("id", "doc_id", "cls", F.coalesce("head", "cls").alias("head"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest doc_id.

    Components without a known id keep one row each; of repeated rows with a kept id and one class, one stays.
    """
    found = written(near_duplicates(docs), "jaccard-components")
    # known ids before others, the smallest first
    order = F.struct(F.col("doc_id").isNull(), F.col("id"), F.col("cls"))
    kept = found.groupBy("head").agg(F.min(order).alias("x")).select(F.col("x.id").alias("id"), F.col("x.cls").alias("cls"))
    kept = written(kept, "jaccard-kept")
    rows = docs.select(F.struct("*").alias("row"), F.expr(ID).alias("id"), F.expr(TEXT).alias("text"))
    if found.groupBy("id").count().where("count > 1").isEmpty():
        return rows.drop("text").join(kept.select("id").hint("merge"), "id", "left_semi").select("row.*")

    # ids repeat: rows are told apart by their class too
    @F.pandas_udf("long")
    def marks(texts):
        import pandas as pd

        return pd.Series([class_of(shingles(x.encode())) for x in texts], dtype="int64")

    return rows.withColumn("cls", marks("text")).join(kept.hint("merge"), ["id", "cls"], "left_semi").dropDuplicates(["id", "cls"]).select("row.*")
