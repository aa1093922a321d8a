"""The trie of all conversations' prefixes, as chains of nodes that one conversation owns.

A node is a distinct sequence of first turns; its owner is the smallest conversation that begins with it. Who owns a node owns every longer prefix of its own,
so a conversation's first owned depth is found by a binary search: in each round all conversations' probes are joined to the minima, the table that has the
smallest conversation of each prefix digest. The nodes from there to a conversation's end are its chain; a chain hangs on the node before it, in
the chain of another. What a subtree adds up to is a sum over chains, which is taken along parents of parents (so the rounds are logarithmic in the
tree's height), and then a sum from a chain's end to each of its nodes.

saved_tokens needs no second pass: the sum of n_convs times bytes over a subtree is that of its members' bytes from its top on.

Defined cases: null roles and texts are empty; turns that tie are ordered by a digest of role and text; rows with a null conv_id belong to no conversation
and are left out; repeated rows are turns of their own; an empty table gives no rows; other columns, whatever their names, are ignored. No task
or row holds a conversation, and no text is moved: rows carry digests of 16 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import Work, only, read_table, spread_join, written
from skeinwork.llm.turns import BASE, MODULUS, digest_of, numbered, packed, suffix_sums, unpacked

#: Turns that a rebuilt conversation takes from the first of its five at most.
HEAD = 8
#: Rows of a bucket, about; conversation numbers that a piece of a list holds at most.
BUCKET_ROWS, PIECE = 2_000_000, 65_536

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, bytes of text."""
    c = only(conversations, ("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType())).where("conv_id IS NOT NULL")
    c = c.withColumns({n: F.coalesce(n, F.lit("")) for n in ("role", "text")})
    return c.select("conv_id", "turn", digest_of(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


_PREFIX = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("prefix", T.BinaryType()), T.StructField("bytes", T.LongType()), T.StructField("total", T.LongType())])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation: the prefixes that it takes from its base, and what turns a hash and a sum of its own turns into those of the rebuilt one."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            q = total = 0
            nodes = [(0, packed(0), 0, 0)]
            for t in (r["base"] or [])[: r["h"]]:
                q, total = (q * BASE + unpacked(t["digest"])) % MODULUS, total + t["bytes"]
                nodes.append((len(nodes), packed(q), t["bytes"], total))
            own = before = 0
            for t in (r["own"] or [])[: r["h"]]:
                own, before = (own * BASE + unpacked(t["digest"])) % MODULUS, before + t["bytes"]
            out.append((r["conv_id"], [dict(zip(("depth", "prefix", "bytes", "total"), x)) for x in nodes], len(nodes) - 1, packed((q - own) % MODULUS), total - before))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(_NODE)), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.int64())], ["conv_id", "nodes", "taken", "shift", "shift_total"])


_NODE = pa.struct([("depth", pa.int64()), ("prefix", pa.binary()), ("bytes", pa.int64()), ("total", pa.int64())])
_HEADS = "conv_id long, nodes array<struct<depth: long, prefix: binary, bytes: long, total: long>>, taken long, shift binary, shift_total long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, depth, prefix, bytes, total of a conversation's own turns in the rebuilt one."""
    for b in batches:
        rows = zip(*(b.column(n).to_pylist() for n in ("conv_id", "pos", "bytes", "sum_bytes", "_n", "_q", "_cq", "h", "taken", "shift", "shift_total")))
        out = []
        for conv, pos, size, total, n, q, before, h, taken, shift, shift_total in rows:
            own = (unpacked(before) * pow(BASE, n, MODULUS) + unpacked(q)) % MODULUS if before else unpacked(q)
            out.append((conv, taken + pos - h, packed((unpacked(shift) * pow(BASE, pos - h, MODULUS) + own) % MODULUS), size, total + shift_total))
        if out:
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _PREFIX.names)


def rebuilt(turns: DataFrame, work: Work) -> DataFrame:
    """conv_id, depth, prefix (digest of the first `depth` turns), bytes of the last of them and of all, for every conversation built anew: depth 0 and on.

    turns: conv_id, turn, digest, bytes. A conversation c takes the first h turns of c - c % 5, h = crc32(c) % (HEAD + 1), and its own after the h-th.
    """
    rows = numbered(turns, "conv_id", ["turn", "digest"], work, "trie-turns", ("bytes",), "digest")
    first = F.array_sort(F.collect_list(F.when(F.col("pos") <= HEAD, F.struct("pos", "digest", "bytes"))))  # HEAD turns at most
    convs = work.put(rows.groupBy("conv_id").agg(first.alias("own")), "trie-heads")
    c = F.col("conv_id")
    base = convs.select(F.col("conv_id").alias("_base"), F.col("own").alias("base"))
    asked = convs.withColumns({"_base": c - c % 5, "h": F.crc32(c.cast("string")) % (HEAD + 1)}).join(base, "_base", "left")
    kept = asked.select("conv_id", "h", "own", "base")
    heads = work.put(kept.select("conv_id", "h", "own", "base").mapInArrow(_heads, _HEADS), "trie-bases").withColumn("h", F.crc32(c.cast("string")) % (HEAD + 1))
    shared = heads.select("conv_id", F.inline("nodes"))
    own = spread_join(rows, heads.select("conv_id", "h", "taken", "shift", "shift_total"), "conv_id", "pos").where("pos > h")
    return shared.unionByName(own.mapInArrow(_prefixes, _PREFIX))


def first_owned(prefixes: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, n and first, the least depth at which a conversation is the smallest of its prefix (n + 1: none), by a binary search.

    prefixes (conv_id, depth, prefix) and minima (owner, depth, least) are bucketed alike, so a round moves a row for each conversation. Keys of the joins are unique.
    """
    longest = convs.agg(F.max("n")).first()[0]
    state = convs.select("conv_id", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"))
    for _ in range(0 if longest is None else (longest + 1).bit_length()):
        probe = state.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long"))
        seen = probe.join(prefixes.select("conv_id", "depth", "prefix").hint("merge"), ["conv_id", "depth"], "left")
        seen = seen.join(minima.select(F.col("owner").alias("conv_id"), "depth", F.col("prefix").alias("least")).hint("merge"), ["conv_id", "depth"], "left")
        owned, open_ = F.coalesce(F.col("prefix") == F.col("least"), F.lit(False)), F.col("lo") < F.col("hi")
        state = seen.select("conv_id", "n", F.when(open_ & ~owned, F.col("depth") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
    return state.select("conv_id", "n", F.col("lo").alias("first"))


_SUMS = ["n_convs", "n_leaves", "member_bytes", "node_bytes"]


def chain_totals(chains: DataFrame, work: Work) -> DataFrame:
    """chains (conv_id, parent, the columns of _SUMS) with each column summed over a chain and all that hang below it, bottom-up.

    Round k adds to every chain the sums of those 2 ** k chains below it, and doubles how far a chain looks up.
    """
    sums, up = chains.select("conv_id", *_SUMS), chains.where("parent IS NOT NULL").select("conv_id", F.col("parent").alias("top"))
    while not up.isEmpty():
        below = sums.join(up, "conv_id").groupBy(F.col("top").alias("conv_id")).agg(*(F.sum(n).alias(f"_{n}") for n in _SUMS))
        sums = work.put(sums.join(below, "conv_id", "left").select("conv_id", *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in _SUMS)), "trie-sums")
        up = work.put(spread_join(up, up.select(F.col("conv_id").alias("top"), F.col("top").alias("next")), "top", "conv_id").select("conv_id", F.col("next").alias("top")), "trie-up")
    return sums


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) to pieces of comma-joined members."""
    at, first, ids, out = None, 0, [], []
    for b in batches:
        for c, d, m in zip(*(x.to_pylist() for x in b.columns)):
            if (c, d) != at or len(ids) == PIECE:
                if ids:
                    out.append((*at, first, ",".join(ids)))
                at, first, ids = (c, d), m, []
            ids.append(str(m))
        if out:
            yield _batch(out, ("conv_id", "depth", "first", "ids"))
            out = []
    if ids:
        yield _batch([(*at, first, ",".join(ids))], ("conv_id", "depth", "first", "ids"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 for each node; a piece is held at a time."""
    at, h, out = None, None, []
    for b in batches:
        for c, d, _, ids in zip(*(x.to_pylist() for x in b.columns)):
            if (c, d) != at:
                if at is not None:
                    out.append((*at, h.hexdigest()))
                at, h = (c, d), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield _batch(out, ("conv_id", "depth", "ends_sha256"))
            out = []
    if at is not None:
        yield _batch([(*at, h.hexdigest())], ("conv_id", "depth", "ends_sha256"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns], list(names))


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of ends (conv_id, depth, member): members ascending, comma-joined. Members are joined in ranges first, so a common end's list comes as pieces."""
    dealt = ends.select("conv_id", "depth", "member").repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    pieces = dealt.mapInArrow(_pieces, "conv_id long, depth long, first long, ids string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def trie(prefixes: DataFrame, work: Work) -> DataFrame:
    """The nodes of prefixes (conv_id, depth, prefix, bytes, total; a row for each depth from 0 to a conversation's last).

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefixes = work.put(prefixes, "trie-prefixes")
    rows = prefixes.count()
    n = max(1, -(-rows // BUCKET_ROWS))
    found = prefixes.groupBy("depth", "prefix").agg(F.min("conv_id").alias("owner"))
    minima = work.buckets(found, ["owner", "depth"], n, "trie-minima")
    prefixes = work.buckets(prefixes, ["conv_id", "depth"], n, "trie-by-conversation")
    convs = work.put(prefixes.groupBy("conv_id").agg(F.max("depth").alias("n"), F.max("total").alias("total")), "trie-conversations")
    first = work.put(first_owned(prefixes, minima, convs).join(convs.drop("n"), "conv_id"), "trie-first")

    # the node that a conversation hangs on: the last one that it doesn't own
    before = first.select("conv_id", "n", "first", F.col("total").alias("all_bytes"), (F.col("first") - 1).alias("depth"))
    hung = before.join(prefixes.select("conv_id", "depth", "prefix", "total"), ["conv_id", "depth"], "left")  # the root's owner hangs on none
    keyed = hung.withColumn("key", F.concat(F.hex(F.col("depth")), F.lit(":"), F.hex("prefix")))
    owners = minima.select(F.concat(F.hex(F.col("depth")), F.lit(":"), F.hex("prefix")).alias("key"), F.col("owner").alias("parent"))
    hung = work.put(spread_join(work.put(keyed, "trie-last-shared"), owners, "key", "conv_id", "left").drop("key", "prefix"), "trie-hung")

    owns, zero = F.col("first") <= F.col("n"), F.lit(0).cast("long")
    ended = hung.where(~owns).groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count("*").alias("n_ends"), F.sum("all_bytes").alias("end_bytes"))
    chains = hung.where(owns).select("conv_id", "n", "first", "parent", F.col("depth").alias("on_depth"), "all_bytes", F.coalesce("total", zero).alias("head_bytes"))
    on_end = chains.select(F.col("parent").alias("conv_id"), F.col("on_depth").alias("n")).distinct().withColumn("goes_on", F.lit(True))
    of_chain = ended.groupBy("conv_id").agg(F.sum("n_ends").alias("n_ends"), F.sum("end_bytes").alias("end_bytes"))
    own = chains.join(on_end, ["conv_id", "n"], "left").join(of_chain, "conv_id", "left")
    own = own.select(
        "conv_id", "n", "first", "parent", "on_depth", "all_bytes", F.col("goes_on").isNull().cast("long").alias("leaf"),
        (1 + F.coalesce("n_ends", zero)).alias("n_convs"), F.col("goes_on").isNull().cast("long").alias("n_leaves"),
        (F.col("all_bytes") + F.coalesce("end_bytes", zero)).alias("member_bytes"), (F.col("all_bytes") - F.col("head_bytes")).alias("node_bytes"),
    )
    own = work.put(own, "trie-chains")
    totals = chain_totals(own, work)

    # what hangs on each node, then sums from a chain's end
    hanging = own.where("parent IS NOT NULL").select("conv_id", "parent", "on_depth").join(totals, "conv_id")
    hanging = hanging.groupBy(F.col("parent").alias("conv_id"), F.col("on_depth").alias("depth")).agg(F.count("*").alias("n_chains"), *(F.sum(c).alias(f"below_{c}") for c in _SUMS))
    nodes = spread_join(prefixes, own.select("conv_id", "n", "first", "parent", "all_bytes", "leaf"), "conv_id", "depth").where("depth >= first")
    nodes = nodes.join(hanging, ["conv_id", "depth"], "left").join(ended, ["conv_id", "depth"], "left")
    last, some = F.col("depth") == F.col("n"), lambda c: F.coalesce(c, zero)
    nodes = nodes.select(
        "conv_id", "depth", "bytes", "total", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        (some("n_chains") + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"),
        (some("below_n_convs") + some("n_ends") + last.cast("long")).alias("n_convs"),
        (some("below_n_leaves") + F.when(last, F.col("leaf")).otherwise(0)).alias("n_leaves"),
        (some("below_member_bytes") + some("end_bytes") + F.when(last, F.col("all_bytes")).otherwise(0)).alias("member_bytes"),
        (some("below_node_bytes") + F.col("bytes")).alias("node_bytes"),
    )
    summed = suffix_sums(work.put(nodes, "trie-nodes"), "conv_id", "depth", _SUMS)
    ends = hung.select(F.when(owns, F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))
    out = summed.join(end_digests(ends), ["conv_id", "depth"], "left")
    saved = F.col("member_bytes") - F.col("n_convs") * (F.col("total") - F.col("bytes")) - F.col("node_bytes")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each built anew from the first turns of its five and its own."""
    with Work(spark) as work:
        turns = turn_digests(read_table(spark, sf_dir, "conversations"))
        return written(trie(rebuilt(turns, work), work), "trie")
