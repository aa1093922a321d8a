"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints that differ in at most two of 64 bits are linked, and components of linked fingerprints are found,
without listing the pairs of a group:

1. 64 bits are cut into segments A (22), B (21), C (21). Two errors leave, in at least one of the orders A-B, B-C,
   C-A, a first segment without an error followed by a second with one at most.
2. The second segment, padded to 23 bits, is decoded by the perfect [23,12,7] Golay code. A word and its neighbours at one
   bit decode to one codeword (word within 2 of it) or six (word at 3), so each order gives one to six keys: the
   first segment's bits and a codeword's 12-bit index. Words that differ in one bit share a key.
3. Keys are shuffled once. Members of a key that really are within two bits are joined by a spanning forest of them, so
   a key with m members gives fewer than m edges. A key of more than `cap` members is handed on whole: its
   members are keyed anew with every pair of possible error positions masked, where a key holds four at most.
4. Components come from alternating large-star and small-star steps over the edges, each written to the shared folder.

Only distinct fingerprints enter steps 2 to 4; copies are a class with the smallest doc_id as its label.

Defined cases: null and wordless texts have fingerprint zero and are linked as any other; fewer words than a shingle are
one shingle; repeated rows are all returned; rows with a null doc_id are returned and take the component's
smallest known id, null where there is none; an empty table gives no rows; texts of any length are read whole; columns other than doc_id and
text, whatever their names, are ignored by the links and kept by deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import Work, docs_of, read_table, spread_join, text_slices, written

SEED = 42
SHINGLE = 3
ERRORS = 2
#: Members of a key that are compared with each other in memory.
CAP = 4096
#: Edges whose components one task may find (they take some 50 MB).
ONE_TASK = 200_000
#: (shift, width) of the segments A, B, C.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011


# -- fingerprints


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and white space alone
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in text_slices(batch):
                fps = np.array([fingerprint(x, width, seed) for x in raw], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs_of(docs).mapInArrow(run, "doc_id long, fp long")


# -- keys


def syndrome_leaders() -> np.ndarray:
    """For each of 2^11 syndromes the one error pattern of weight three at most."""
    one = [_remainder(1 << i) for i in range(23)]
    leaders = np.zeros(1 << 11, dtype=np.uint32)
    for i in range(23):
        leaders[one[i]] = 1 << i
        for j in range(i):
            leaders[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                leaders[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    return leaders


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Decodes arrays of 23-bit words to codeword indices."""

    def __init__(self):
        self.leaders = syndrome_leaders()
        self.high = np.array([_remainder(m << 11) for m in range(1 << 12)], dtype=np.uint32)

    def index(self, words: np.ndarray) -> np.ndarray:
        words = words.astype(np.uint32)
        syndrome = self.high[words >> 11] ^ (words & 0x7FF)
        return (words ^ self.leaders[syndrome]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """For each word the indices to which it and its neighbours at one of `width` bits decode, as rows; -1 fills rows up."""
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
        found = np.sort(self.index(words.astype(np.uint32)[:, None] ^ flips[None, :]).astype(np.int64), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def segment(fps: np.ndarray, k: int) -> np.ndarray:
    shift, width = SEGMENTS[k % 3]
    return (fps.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of signed fingerprints, and the index of the fingerprint that each is of."""
    keys, of = [], []
    for k in range(3):
        near = golay().near(segment(fps, k + 1), SEGMENTS[(k + 1) % 3][1])
        row, col = np.nonzero(near >= 0)
        keys.append(np.int64(k) << np.int64(40) | segment(fps, k).astype(np.int64)[row] << np.int64(12) | near[row, col])
        of.append(row)
    return np.concatenate(keys), np.concatenate(of)


def masked_keys(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For members of one Golay key: keys under which those that differ in two possible error positions at most meet.

    Inside a key of order k the first segment has no errors, the second has one at most.
    """
    for k in range(3):
        mine = fps[keys >> 40 == k]
        if len(mine):
            (s1, w1), (s2, w2) = SEGMENTS[(k + 1) % 3], SEGMENTS[(k + 2) % 3]
            one, rest = range(s1, s1 + w1), range(s2, s2 + w2)
            for i, j in [*((i, j) for i in one for j in rest), *((i, j) for i in rest for j in rest if i < j)]:
                masked = mine.view(np.uint64) & np.uint64(~(1 << i | 1 << j) & (1 << 64) - 1)
                yield _mixed(masked + np.uint64(i * 64 + j + 1) * np.uint64(0x9E3779B97F4A7C15)), mine


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, as signed longs. A collision costs a comparison, never a link."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).view(np.int64)


# -- links


def forest(fps: np.ndarray, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the distinct fingerprints that are within `errors` bits."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, u = [], fps.view(np.uint64)
    for start in range(0, len(u), 256):
        block = u[start : start + 256]
        near = np.bitwise_count(block[:, None] ^ u[None, start:]) <= errors
        for i, j in zip(*np.nonzero(near)):
            if i < j:
                a, b = find(start + int(i)), find(start + int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(fps[start + i]), int(fps[start + j])))
    return out


LINKS = "a long, b long, over long"


def _linked(cap: int, errors: int):
    """Over (key, fp) sorted by key: edges (a, b), and (key, fp) of keys with more than cap members as (over, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, count, spilled = None, [], 0, False
        a: list[int] = []
        b: list[int | None] = []
        over: list[int | None] = []

        def edges(fps: np.ndarray) -> None:
            for x, y in forest(fps, errors):
                a.append(x), b.append(y), over.append(None)

        def hand_on(fps: np.ndarray) -> None:
            a.extend(fps.tolist()), b.extend(repeat(None, len(fps))), over.extend(repeat(key, len(fps)))

        def close() -> None:
            if not spilled and count > 1:
                edges(np.unique(np.concatenate(held)))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "over": pa.array(over, pa.int64())})
            a.clear(), b.clear(), over.clear()
            return made

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if keys[lo] != key:
                    close()
                    key, held, count, spilled = int(keys[lo]), [], 0, False
                part = fps[lo:hi]
                count += hi - lo
                if not spilled and count > cap:
                    spilled = True
                    for x in held:
                        hand_on(x)
                    held = []
                if spilled:
                    hand_on(part)
                else:
                    held.append(part.copy())
            if len(a) > 50_000:
                yield out()
        close()
        yield out()

    return run


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(i, 4096).to_numpy()
                keys, of = golay_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[of])], names=["key", "fp"])

    return distinct.mapInArrow(run, "key long, fp long")


def _keyed_again(over: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                for keys, fps in masked_keys(batch.column(0).slice(i, 4096).to_numpy(), batch.column(1).slice(i, 4096).to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], names=["key", "fp"])

    return over.mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, work: Work, cap: int = CAP, errors: int = ERRORS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links. distinct: fp."""
    found = work.put(_keyed(distinct).repartition("key").sortWithinPartitions("key").mapInArrow(_linked(cap, errors), LINKS), "simhash-links")
    edges, over = found.where("over is null").select("a", "b"), found.where("over is not null")
    if over.isEmpty():
        return edges
    again = _keyed_again(over.select(F.col("over").alias("key"), F.col("a").alias("fp")))
    # a masked key has four fingerprints at most, each once for every large key that it was in
    rest = again.distinct().repartition("key").sortWithinPartitions("key").mapInArrow(_linked(1 << 30, errors), LINKS)
    return edges.union(rest.select("a", "b"))


# -- components


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return spread_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(down, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What components() gives, in the memory of one task."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (r := root.setdefault(i, i)) != i:
            root[i] = i = root[r]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = [(i, find(i)) for i in list(root)]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found if x[0] != x[1]], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b): every linked node a but the smallest of its component, with that smallest node b. edges should be on disk or cheap.

    Up to `one_task` edges are united in one task, more by rounds over all; the result is the same.
    """
    edges, state = edges.where("a <> b"), None
    if edges.limit(one_task + 1).count() <= one_task:
        return written(edges.coalesce(1).mapInArrow(_united, "a long, b long"), "simhash-components")
    with Work(edges.sparkSession) as work:
        while True:
            large = work.put(_large_star(edges), "simhash-stars")
            edges = work.put(_small_star(large), "simhash-stars")
            work.drop_first(len(work.paths) - 1)
            state, before = _state(edges), state
            if state == before:
                return written(edges, "simhash-components")


def near_duplicates(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, fp, component_id and head (the component's smallest linked fingerprint) of every row."""
    marked = written(fingerprints(docs), "simhash-fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    with Work(docs.sparkSession) as work:
        stars = components(links(classes.select("fp"), work, cap))
        label = stars.select(F.col("a").alias("fp"), F.col("b").alias("head"))
        headed = work.put(classes.join(label.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("head", "fp").alias("head")), "simhash-heads")
        least = headed.groupBy("head").agg(F.min("first").alias("component_id"))
        named = written(spread_join(headed, least, "head", "fp").select("fp", "component_id", "head"), "simhash-classes")
    return spread_join(marked, named, "fp", "doc_id").select("doc_id", "fp", "component_id", "head")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest doc_id.

    Components without a known id keep one row each; of repeated rows with a kept id and one fingerprint, one stays.
    """
    found = near_duplicates(docs)
    named = F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id"))
    unnamed = F.col("component_id").isNull() & (F.col("fp") == F.col("head"))
    kept = written(found.where(named | unnamed).groupBy("doc_id", "fp").agg(F.count("*").alias("n")), "simhash-kept")
    plain = kept.where("n > 1 or doc_id is null").isEmpty() and kept.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = kept.select(F.col("doc_id").alias("id"), F.col("fp").alias("mark"))
    if plain:
        # a sort-merge join at every size: what is kept grows with the documents and mustn't be broadcast
        return rows.join(wanted.select("id").hint("merge"), "id", "left_semi").select("row.*")

    # ids repeat or are unknown: rows are told apart by their fingerprint too
    @F.pandas_udf("long")
    def marks(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(x.encode()) for x in texts], dtype=np.uint64).view(np.int64))

    told = rows.withColumn("mark", marks("text")).alias("t")
    w = wanted.alias("w").hint("merge")
    some = told.join(w, F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.mark") == F.col("w.mark")), "left_semi")
    return some.dropDuplicates(["id", "mark"]).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
