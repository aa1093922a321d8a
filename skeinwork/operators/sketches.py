"""Impact of all symbols at once: risks from callers that are counted until a risk is at its most, and sketches of who reaches a symbol, united along calls, instead of a closure of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.traversal import risk_label
from skeinwork.session import cut
from skeinwork.sources.stored import buckets

#: log2 of a sketch's registers: 4,096 registers have a standard error of 1.6 %.
REGISTERS = 12
#: Nodes of which a sketch keeps a list, so their count is exact; nodes of a list that is united by registers instead.
LISTED, SHORT = 512, 64
#: Nodes of a block at least and at most, about, and parts that small graphs are dealt over.
LEAST_BLOCK, BLOCK, PARTS = 2048, 1 << 15, 16
#: Blocks that a node leads to, on average, from which on nodes are dealt by what is near along edges; one of how many nodes tells that; rounds in which labels spread.
FAR, TOLD_BY, ROUNDS = 4, 64, 4
#: Pairs (node, reached by) that a task collects before it looks for copies, and list entries and registers of a message, about.
PAIRS, CHUNK = 1 << 21, 1 << 17

#: Callers within two or three calls from which on a risk is at its most: each adds 2 of 100 at least.
ENOUGH = 50
#: Kinds of messages to block b: where it is led to from block other; sketches from there; its nodes that lead to other; what is known of its nodes. They are read by stage.
_INTO, _SKETCHES, _LEADS, _TOLD = range(4)
_MESSAGE = "b int, stage int, other int, kind int, data binary"
_CODEC = pa.Codec("zstd", 1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: bytes of the same place in a number lie together and are compressed together."""
    heads, datas = [len(arrays)], []
    for x in arrays:
        datas += [_CODEC.compress(plane.tobytes(), asbytes=True) for plane in np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T]
        heads += [len(x), x.itemsize, *map(len, datas[-x.itemsize :])]
    return b"".join([np.array(heads, np.uint32).tobytes(), *datas])


def _unpacked(data: pa.Buffer) -> list[np.ndarray]:
    heads, found, i, ends = np.frombuffer(data, np.uint32, len(data) // 4), [], 1, []
    for _ in range(heads[0]):
        n, size = int(heads[i]), int(heads[i + 1])
        ends.append((n, [int(x) for x in heads[i + 2 : i + 2 + size]]))
        i += 2 + size
    at = 4 * i
    for n, sizes in ends:
        planes = np.empty((n, len(sizes)), np.uint8)
        for k, size in enumerate(sizes):
            planes[:, k] = np.frombuffer(_CODEC.decompress(data.slice(at, size), n), np.uint8)
            at += size
        found.append(planes.reshape(-1).view(f"u{len(sizes)}"))
    return found


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2^32; np.cumsum gives the numbers back."""
    x = x.astype(np.uint32)
    return np.diff(x, prepend=np.uint32(0))


def _summed(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint32)


def _hashed(codes: np.ndarray) -> np.ndarray:
    """32 bits for each node, different for all nodes: the last step of murmur3 is a bijection."""
    h = codes.astype(np.uint32)
    h ^= h >> np.uint32(16)
    for shift, times in ((13, 0x85EBCA6B), (16, 0xC2B2AE35)):
        h *= np.uint32(times)
        h ^= h >> np.uint32(shift)
    return h


def _ranks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One more than the zeros that a hash begins with, but for its register's bits."""
    return (33 - bits - np.frexp((hashes >> np.uint32(bits)).astype(np.float64))[1]).astype(np.uint8)


def estimates(rows: np.ndarray, bits: int) -> np.ndarray:
    """How many nodes registers (a row for each sketch) hold, by Ertl's improved estimator, which has no bias in any range."""
    m, top = 1 << bits, 32 - bits
    at = rows.astype(np.int64) + (np.arange(len(rows)) * (top + 2))[:, None]
    counts = np.bincount(at.reshape(-1), minlength=len(rows) * (top + 2)).reshape(len(rows), top + 2).T.astype(float)
    x = 1 - counts[top + 1] / m
    y, z = np.ones_like(x), 1 - x
    for _ in range(64):
        x, y = np.sqrt(x), y / 2
        z = z - (1 - x) ** 2 * y
    z = m * z / 3
    for k in range(top, 0, -1):
        z = (z + counts[k]) / 2
    x, y = counts[0] / m, np.ones_like(x)
    s = x.copy()
    for _ in range(64):
        x = x * x
        s = s + x * y
        y = y * 2
    return m * m / (2 * np.log(2)) / (z + m * np.where(counts[0] < m, s, np.inf))


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run, one after the other."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class _Block:
    """Sketches of the nodes of a block, as what reaches them comes in: a list of nodes, or registers for those that are over LISTED. starts: the number of every block's first node."""

    def __init__(self, b: int, bits: int, starts: np.ndarray):
        self.b, self.bits, self.m, self.starts = b, bits, 1 << bits, starts
        n = int(starts[b + 1] - starts[b])
        self.rows, self.over, self.told = np.zeros((n, self.m), np.uint8), np.zeros(n, bool), np.zeros((0, n))
        self.pairs, self.waiting, self.kept, self.done = [], 0, np.zeros(0, np.uint64), False
        self.collect(np.arange(n), starts[b] + np.arange(n))

    def registers(self, at: np.ndarray, hashes: np.ndarray) -> None:
        np.maximum.at(self.rows.reshape(-1), at.astype(np.int64) * self.m + (hashes & np.uint32(self.m - 1)), _ranks(hashes, self.bits))

    def collect(self, at: np.ndarray, codes: np.ndarray) -> None:
        self.pairs.append((at.astype(np.uint64) << np.uint64(32)) | codes.astype(np.uint64))
        self.waiting += len(at)
        if self.waiting > max(PAIRS, len(self.kept)):
            self.settle()

    def settle(self) -> None:
        """Copies go; lists that have become too long go into registers."""
        found = np.concatenate([self.kept, *self.pairs])
        self.pairs, self.waiting = [], 0
        found.sort()  # np.unique's hash table is slower by far
        found = found[np.r_[True, found[1:] != found[:-1]]]
        at = (found >> np.uint64(32)).astype(np.int64)
        self.over |= np.bincount(at, minlength=len(self.over)) > LISTED + 1  # a node's list has itself
        gone = self.over[at]
        self.registers(at[gone], _hashed(found[gone]))
        self.kept = found[~gone]

    def into(self, other: int, data: pa.Buffer, first: bool) -> None:
        """Where the block is led to from another. In the first step a node's sketch is itself."""
        src, dst = _unpacked(data)
        self.src, self.dst = _summed(src), dst
        if first:
            for i in range(0, len(src), PAIRS):
                self.collect(dst[i : i + PAIRS], self.starts[other] + self.src[i : i + PAIRS])

    def take(self, data: pa.Buffer) -> None:
        """Sketches of some nodes of the block whose edges came last."""
        p, over, lengths, codes, places, ranks = _unpacked(data)
        p, over, lengths, codes, places = _summed(p), over.astype(bool), lengths.astype(np.int64), _summed(codes), _summed(places)
        lo, hi = np.searchsorted(self.src, p[0]), np.searchsorted(self.src, p[-1], "right")
        src, dst = np.searchsorted(p, self.src[lo:hi]), self.dst[lo:hi]
        long = over | (lengths > SHORT)
        slot = np.cumsum(long) - 1
        met = np.zeros((int(long.sum()), self.m), np.uint8)
        met[slot[over][places >> np.uint32(self.bits)], places & np.uint32(self.m - 1)] = ranks
        at = np.repeat(np.arange(len(p)), lengths)
        some = long[at]
        hashes = _hashed(codes[some])
        np.maximum.at(met.reshape(-1), slot[at[some]] * self.m + (hashes & np.uint32(self.m - 1)), _ranks(hashes, self.bits))
        begins = np.searchsorted(src, np.arange(len(p) + 1))
        for i in np.flatnonzero(long):
            to = dst[begins[i] : begins[i + 1]]
            self.rows[to] = np.maximum(self.rows[to], met[slot[i]])
        self.over[dst[over[src]]] = True
        # as many registers that aren't zero are as many nodes at least
        near = np.unique(dst[long[src] & ~self.over[dst]])
        for i in range(0, len(near), 1024):
            each = near[i : i + 1024]
            self.over[each[np.count_nonzero(self.rows[each], axis=1) > LISTED + 1]] = True
        listed = ~over[src] & ~(long[src] & self.over[dst])
        src, dst, first = src[listed], dst[listed], np.cumsum(lengths) - lengths
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[src]) // PAIRS, prepend=0))
        for lo, hi in zip([0, *cuts], [*cuts, len(src)]):
            each = lengths[src[lo:hi]]
            self.collect(np.repeat(dst[lo:hi], each), codes[_spread(first[src[lo:hi]], each)])

    def end(self) -> None:
        self.settle()
        n = len(self.over)
        at = (self.kept >> np.uint64(32)).astype(np.int64)
        self.codes, self.lengths = self.kept.astype(np.uint32), np.bincount(at, minlength=n)
        self.begins = np.cumsum(self.lengths) - self.lengths
        size, over = self.lengths.astype(float), np.flatnonzero(self.over)
        for i in range(0, len(over), 256):
            size[over[i : i + 256]] = estimates(self.rows[over[i : i + 256]], self.bits)
        self.told, self.entries, self.done = np.vstack([self.told, size - 1]), np.minimum(size, self.m).astype(np.int64), True

    def give(self, other: int, data: pa.Buffer) -> Iterator[pa.RecordBatch]:
        """What the nodes that lead to another block have, for that block."""
        p = _summed(_unpacked(data)[0])
        cuts = np.flatnonzero(np.diff(np.cumsum(self.entries[p]) // CHUNK, prepend=0))
        for lo, hi in zip([0, *cuts], [*cuts, len(p)]):
            if hi > lo:
                some = p[lo:hi]
                over, lengths = self.over[some], self.lengths[some]
                rows = self.rows[some[over]].reshape(-1)
                places = np.flatnonzero(rows)
                yield _message(other, 0, self.b, _SKETCHES, _packed(_steps(some), over.view(np.uint8), lengths.astype(np.uint32), _steps(self.codes[_spread(self.begins[some], lengths)]), _steps(places), rows[places]))


def _message(b: int, stage: int, other: int, kind: int, data: bytes) -> pa.RecordBatch:
    ints = [pa.array([x], pa.int32()) for x in (b, stage, other, kind)]
    return pa.RecordBatch.from_arrays([*ints, pa.array([data], pa.binary())], names=["b", "stage", "other", "kind", "data"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (s, t), which come by t's block and s: one message to either block of a pair."""
    mask, at, waiting = (1 << 33) - 1, None, []

    def told() -> Iterator[pa.RecordBatch]:
        s, t = (np.concatenate(x) & mask for x in zip(*waiting))
        both = np.sort((s.astype(np.uint64) << np.uint64(32)) | t.astype(np.uint64))
        both = both[np.r_[True, both[1:] != both[:-1]]]
        src = both >> np.uint64(32)
        yield _message(at[0], 0, at[1], _INTO, _packed(_steps(src), both.astype(np.uint32)))
        yield _message(at[1], 1, at[0], _LEADS, _packed(_steps(src[np.r_[True, src[1:] != src[:-1]]])))

    for batch in batches:
        s, t = batch.column("s").to_numpy(), batch.column("t").to_numpy()
        cuts = np.flatnonzero((np.diff(s >> 33) != 0) | (np.diff(t >> 33) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(s)]):
            if hi == lo:
                continue
            pair = int(t[lo]) >> 33, int(s[lo]) >> 33
            if waiting and pair != at:
                yield from told()
                waiting = []
            at = pair
            waiting.append((s[lo:hi], t[lo:hi]))
    if waiting:
        yield from told()


def _united(bits: int, starts: np.ndarray, first: bool, last: bool):
    """A step for the blocks of a task, whose messages come by stage, the other block and kind."""

    def told(block: _Block) -> pa.RecordBatch:
        if not block.done:
            block.end()
        if not last:
            return _message(block.b, 0, -1, _TOLD, block.told.tobytes())
        n = block.told.shape[1]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(block.told.T.reshape(-1)), len(block.told)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array((block.b << 33) + np.arange(n)), lists], names=["id", "told"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            b, _, other, kind = (batch.column(i).to_pylist() for i in range(4))
            for i, data in enumerate(batch.column("data")):
                if block is None or block.b != b[i]:
                    if block:
                        yield told(block)
                    block = _Block(b[i], bits, starts)
                if kind[i] == _TOLD:
                    block.told = np.frombuffer(data.as_buffer()).reshape(-1, len(block.over))
                elif kind[i] == _INTO:
                    block.into(other[i], data.as_buffer(), first)
                elif kind[i] == _SKETCHES:
                    block.take(data.as_buffer())
                else:
                    if not block.done:
                        block.end()
                    yield from block.give(other[i], data.as_buffer())
        if block:
            yield told(block)

    return run


def _numbered(nodes: DataFrame, blocks: int, *by: str) -> DataFrame:
    """key, and id: block and place. Blocks are ranges."""
    return nodes.repartitionByRange(blocks, *by).sortWithinPartitions(*by).select("key", F.monotonically_increasing_id().alias("id"))


def _labelled(nodes: DataFrame, e: DataFrame, parts: int) -> DataFrame:
    """key, and label: the least key that comes to a node in ROUNDS steps, along edges and against them in turn. Nodes that belong together have few labels."""
    labels = nodes.select("key", F.col("key").alias("label"))
    for i in range(ROUNDS):
        a, b = ("src", "dst") if i % 2 == 0 else ("dst", "src")
        come = (e if i % 2 == 0 else e.repartition(parts, a)).join(labels.withColumnRenamed("key", a), a).groupBy(F.col(b).alias("key")).agg(F.min("label").alias("low"))
        labels = cut(labels.join(come, "key", "left").select("key", F.least("label", "low").alias("label")))
    return labels


def reach_counts(edges: DataFrame, depth: int = 3, registers: int = REGISTERS) -> DataFrame:
    """key, and within_1 ... within_depth: about how many other nodes reach every node within so many steps of edges (src, dst). Counts up to LISTED are exact.

    Nodes are dealt into blocks by ranges of their keys or, where these lead to many blocks, of labels that are spread along edges. In a round a node's sketch goes once to each block in which it has an edge, not once for each edge, and is united there with
    the sketches of the nodes that it leads to; so what is moved is bounded by nodes times the blocks that they lead to, which are few where there are parts of the graph with few edges between them.
    Sketches of many nodes go as one message: lists as differences of node numbers, registers as the places and ranks of those that aren't zero. Edges go to the block that they lead to,
    as one message for a pair of blocks; the block that they come from knows which of its nodes lead there. A task holds the registers of one block at a time.
    """
    e = edges.select("src", "dst").where("src <> dst")
    block = lambda c: F.shiftright(c, 33).cast("int")
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("key")).distinct())
    n, parts = nodes.count(), buckets(e.count())
    blocks = max(1, -(-n // min(BLOCK, max(LEAST_BLOCK, n // PARTS))))
    ids = cut(_numbered(nodes, blocks, "key"))
    if blocks > FAR:
        some = e.where(F.pmod(F.xxhash64("src"), F.lit(TOLD_BY)) == 0).join(ids.toDF("dst", "t"), "dst")
        far = some.groupBy("src").agg(F.countDistinct(block("t")).alias("n")).agg(F.avg("n")).first()[0]
        if (far or 0) > FAR:
            ids = cut(_numbered(_labelled(nodes, e, parts), blocks, "label", "key"))
    sizes = np.zeros(blocks, np.int64)
    for b, size in ids.groupBy(block("id")).count().collect():
        sizes[b] = size
    starts = np.concatenate([[0], np.cumsum(sizes)])
    placed = e.join(ids.toDF("src", "s"), "src").select("s", "dst").repartition(parts, "dst").join(ids.toDF("dst", "t"), "dst").select("s", "t")
    leads = cut(placed.repartitionById(blocks, block("t")).sortWithinPartitions(block("t"), "s").mapInArrow(_dealt, _MESSAGE))
    sent = None
    for level in range(1, depth + 1):
        last = level == depth
        met = leads.where(F.col("kind") == _INTO) if last else leads
        met = (met if sent is None else met.union(sent)).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "stage", "other", "kind")
        sent = met.mapInArrow(_united(registers, starts, level == 1, last), "id long, told array<double>" if last else _MESSAGE)
    return ids.join(sent, "id").select("key", *(F.round(F.get("told", F.lit(k))).cast("long").alias(f"within_{k + 1}") for k in range(depth)))


def _callees(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("src").alias("key")).agg(F.countDistinct("dst").alias("direct_callees_count"))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)


def impact_of_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every symbol (key): direct_callers_count, total_callers_count (callers within one, two and three calls, the nearer ones counted again), direct_callees_count,
    risk_score and risk_label, as traversal.impact() has them for the symbols that it is asked about. Totals are estimates beyond some hundreds, all else is exact."""
    up = reach_counts(edges.where("relation = 'calls'")).select("key", (F.col("within_1") + F.col("within_2") + F.col("within_3")).alias("total_callers_count"))
    out = risk_of_all(nodes, edges).join(up, "key", "left")
    return out.select("key", "direct_callers_count", _zero("total_callers_count"), "direct_callees_count", "risk_score", "risk_label")


def risk_of_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every symbol (key): direct_callers_count, direct_callees_count, risk_score and risk_label, all exact.

    A risk is at its most from 100 points on: 16 for a caller, 4 for one at two calls and 2 for one at three. So callers are followed only for symbols below that, which have six callers and
    24 within two calls at most, and only through symbols of ENOUGH callers or less: one of more brings so many callers that the risk is at its most.
    """
    calls = edges.where("relation = 'calls'")
    e = calls.select("src", "dst").where("src <> dst").distinct()
    into = cut(e.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("direct_callers_count")))
    points = into.select(F.col("key").alias("root"), (16 * F.col("direct_callers_count")).alias("points")).where("points < 100")
    at, known = points.select("root", F.col("root").alias("node")), None
    for each, level in ((0, 1), (4, 2), (2, 3)):
        met = at.join(into.withColumnRenamed("key", "node"), "node")
        full = met.where(F.col("direct_callers_count") > ENOUGH).select("root").distinct()
        step = met.join(full, "root", "left_anti").select("root", "node").join(e.toDF("next", "node"), "node").where("root <> next").select("root", F.col("next").alias("node")).distinct()
        new = cut(step if known is None else step.join(known, ["root", "node"], "left_anti"))
        found = new.groupBy("root").agg((F.count("*") * each).alias("more"))
        points = points.join(full.withColumn("full", F.lit(True)), "root", "left").join(found, "root", "left")
        points = cut(points.select("root", F.when(F.col("full"), 100).otherwise(F.col("points") + F.coalesce("more", F.lit(0))).alias("points")))
        at = new.join(points.where("points < 100"), "root", "left_semi")
        known = at if known is None else known.union(at)
    out = nodes.select("key").join(into, "key", "left").join(_callees(calls), "key", "left").join(points.withColumnRenamed("root", "key"), "key", "left")
    risk = F.when(F.coalesce("direct_callers_count", F.lit(0)) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.coalesce("points", F.lit(100)) / 100.0), 2))
    out = out.select("key", _zero("direct_callers_count"), _zero("direct_callees_count"), risk.alias("risk_score"))
    return out.withColumn("risk_label", risk_label(F.col("risk_score")))
