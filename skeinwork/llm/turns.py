"""Positions of turns in their conversations, and sums along them, without a task that holds a conversation.

Rows are dealt by ranges of (conversation, order), so a conversation that is longer than a range lies in several tasks. Each task counts on its own; what
a conversation brings from one range into the next is one small row for each range, added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skeinwork.llm.common import Work

#: Prefixes are hashed as polynomials in BASE modulo MODULUS, so hashes of pieces can be put together.
MODULUS, BASE = (1 << 127) - 1, 0x5DEECE66D_9E3779B97F4A7C15 | 1
#: Positions of one task's share of a running sum.
BLOCK = 1024


def packed(x: int) -> bytes:
    return x.to_bytes(16, "big")


def unpacked(x: bytes) -> int:
    return int.from_bytes(x, "big")


def digest_of(*parts: Column) -> Column:
    """16 bytes that stand for a row of texts; lengths keep neighbours apart."""
    told = [x for p in parts for x in (F.char_length(p).cast("string"), F.lit(":"), p)]
    return F.unhex(F.substring(F.sha2(F.concat(*told).cast("binary"), 256), 1, 32))


def _counted(batches: Iterator[pa.RecordBatch], key: str, sums: tuple[str, ...], chain: str | None) -> Iterator[pa.RecordBatch]:
    """Adds _part, _n, the local running sums and the local chain hash to rows that are sorted by key and order."""
    part, last, n, totals, q = TaskContext.get().partitionId(), None, 0, [0] * len(sums), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([keys[0] != last], keys[1:] != keys[:-1])))
        run = np.zeros(len(keys), np.int64)  # index at which a row's run began; the first run may go on from before
        run[starts] = starts
        run = np.maximum.accumulate(run)
        going = np.arange(len(keys)) < (starts[0] if len(starts) else len(keys))
        rank = np.arange(len(keys)) - run + 1 + np.where(going, n, 0)
        out = list(batch.columns) + [pa.array(np.full(len(keys), part, np.int32)), pa.array(rank)]
        for i, name in enumerate(sums):
            running = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.where(run > 0, running[np.maximum(run, 1) - 1], 0)
            running = running - before + np.where(going, totals[i], 0)
            totals[i] = int(running[-1])
            out.append(pa.array(running))
        if chain is not None:
            hashes, fresh = [], {*starts.tolist()}
            for i, v in enumerate(batch.column(chain).to_pylist()):
                q = ((0 if i in fresh else q) * BASE + unpacked(v)) % MODULUS
                hashes.append(packed(q))
            out.append(pa.array(hashes, pa.binary()))
        last, n = keys[-1], int(rank[-1])
        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "_part", "_n", *(f"_{s}" for s in sums), *(["_q"] if chain else [])])


def numbered(df: DataFrame, key: str, order: list[str], work: Work, name: str, sums: tuple[str, ...] = (), chain: str | None = None) -> DataFrame:
    """df with `pos`, a row's place from 1 among the rows of its key (a long, not null) by `order`, nulls first, and `sum_x` for x in sums, its prefix sums.

    chain: a column of 16 bytes; _q, _cq and _n come with it, and the prefix's hash is _cq * BASE ** _n + _q. Rows that are alike in key and order should be
    alike in all, as their places are given as they come. The result is read from a table of `work`.
    """
    kinds = [T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType())] + [T.StructField(f"_{s}", T.LongType()) for s in sums]
    kinds += [T.StructField("_q", T.BinaryType())] if chain else []
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = work.put(dealt.mapInArrow(lambda b: _counted(b, key, sums, chain), T.StructType(df.schema.fields + kinds)), name)
    state = F.struct(key, "_n", *(f"_{s}" for s in sums), *(["_q"] if chain else []))
    ends = local.groupBy("_part").agg(F.min(key).alias("first"), F.max(state).alias("end")).orderBy("_part").collect()  # a row for each range
    carried, at = [], None
    for e in ends:
        new = [e.end["_n"], *(e.end[f"_{s}"] for s in sums), unpacked(e.end["_q"]) if chain else 0]
        if at is not None and at[0] == e.first:
            carried.append((e["_part"], e.first, *at[1][:-1], packed(at[1][-1])))
            if e.end[key] == e.first:
                new = [a + b for a, b in zip(at[1][:-1], new[:-1])] + [(at[1][-1] * pow(BASE, new[0], MODULUS) + new[-1]) % MODULUS]
        at = (e.end[key], new)
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("_before", T.LongType())] + [T.StructField(f"_before_{s}", T.LongType()) for s in sums] + [T.StructField("_cq", T.BinaryType())])
    carry = F.broadcast(df.sparkSession.createDataFrame(carried, schema))  # no more rows than ranges
    out = local.join(carry, ["_part", key], "left")
    got = {"pos": F.col("_n") + F.coalesce("_before", F.lit(0))} | {f"sum_{s}": F.col(f"_{s}") + F.coalesce(f"_before_{s}", F.lit(0)) for s in sums}
    return out.withColumns(got).select(*df.columns, *got, *(["_n", "_q", "_cq"] if chain else []))


def suffix_sums(df: DataFrame, key: str, at: str, names: list[str]) -> DataFrame:
    """df with each named column replaced by its sum over the rows of its key from `at` (a place, unique in its key) to the end; a task sums a block, then blocks are added up."""
    d = df.withColumn("_block", F.floor(F.col(at) / BLOCK).cast("long"))
    inner = W.partitionBy(key, "_block").orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(key, "_block").agg(*(F.sum(n).alias(f"_{n}") for n in names))
    later = totals.select(key, "_block", *(F.coalesce(F.sum(f"_{n}").over(outer), F.lit(0)).alias(f"_{n}") for n in names)).where(" OR ".join(f"_{n} <> 0" for n in names))
    summed = d.withColumns({n: F.sum(n).over(inner) for n in names}).join(later, [key, "_block"], "left")
    return summed.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in names}).select(*df.columns)
