"""Token-id files: zstandard frames over a shared dictionary, with an offset index for short-document access.

A store is a folder with two Parquet tables, so that any store Spark can reach can hold it and
Spark's commit protocol covers lost executors:

``dictionary``  one row: the dictionary's bytes and their SHA-256.
``blocks``      one row per block. Shards are ranges of doc_id, blocks follow each other in a shard, documents
                ascend by doc_id in a block (null ids first; repeated ids by the text's hash). Columns: shard, block,
                first_token (tokens of the shard before the block), n_tokens, min_doc_id, max_doc_id, doc_ids, blob.

A blob is ``magic(6) width(u8) sha256(32) n_docs(u32) offsets(u64 * (n_docs+1)) n_tokens(u64 * n_docs) frames``. Each
document is a frame of its own, so one document is read by its offsets without touching the others.

Defined cases: a null text is an empty one and holds the end id alone; an empty table gives an empty store; a
document larger than a block gets a block of its own; repeated rows are kept, each with its own frame.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import Memo, docs_of, read_table, text_slices, work_path

MAGIC = b"SKTK1\0"
END_ID = 2
#: The dictionary is trained on about this many documents, chosen by the hash of their id, of which those beyond SAMPLE_DOC_BYTES are left out.
SAMPLE_DOCS = 1000
SAMPLE_DOC_BYTES = 64 << 10
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 65_536
LEVEL = 3
#: Bytes of text whose distinct words are looked up together.
SLICE_BYTES = 8 << 20

BLOCKS = "shard int, block int, first_token long, n_tokens long, min_doc_id long, max_doc_id long, doc_ids array<long>, blob binary"


#: Words that go to the library as one text.
TOGETHER = 64
#: Words of Latin letters and signs with one line feed in them, which a byte-level pre-tokenizer always makes a piece of its own.
SIGNS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}.,;:!?$#&%*|<>()]+"
TWO_LINES = rf"\A{SIGNS}\n{SIGNS}\z"


class WordTable:
    """Words and their ids as arrays: words is an Arrow column, the ids of word i are flat[starts[i] : starts[i] + sizes[i]].

    Beyond `most` words, those that weren't asked for again since the last time go.
    """

    def __init__(self, dtype: np.dtype, most: int):
        self.most, self.words = most, pa.array([], pa.string())
        self.flat, self.starts, self.sizes, self.again = np.empty(0, dtype), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)

    def rows(self, words: pa.Array) -> np.ndarray:
        """Each word's row; -1: not held."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        self.again[at[at >= 0]] = True
        return at

    def add(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes]).astype(np.int32)
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes]).astype(np.int32)
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def trim(self) -> None:
        if len(self.words) > self.most:
            kept = np.flatnonzero(self.again)[-self.most // 2 :]
            self.words, self.flat = self.words.take(pa.array(kept)), taken(self.flat, self.starts[kept], self.sizes[kept])[0]
            self.sizes = self.sizes[kept]
            self.starts, self.again = np.cumsum(self.sizes, dtype=np.int32) - self.sizes, np.zeros(len(kept), bool)


def taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that begin at starts, one after the other, and where each ends, with 0 first."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, dtype=np.int32, out=ends[1:])
    at = np.repeat(starts - ends[:-1], sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], ends


class WordEncoder:
    """The tokenizers library behind a memo.

    A byte-level pre-tokenizer always starts a piece at a single space before a character that isn't white space.
    So a text is cut there into words, whose ids are kept in a table. Words that it lacks go to the library, many in one text with
    line feeds between them, which are pieces of their own; words with a line feed go one by one, but for those of TWO_LINES.
    Texts that hold an added token's string go to the library whole, as do all texts if the pre-tokenizer is another.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.feed_id = self.library.encode("\n", add_special_tokens=False).ids
        plain = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and len(self.feed_id) == 1
        self.cuts = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.table, self.heads = WordTable(self.dtype, 400_000), Memo(50_000)
        self.spaced = re.compile(r" \s| $")
        self.cut = re.compile(r" (?=\S)")

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str], feeds: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with a space before it and `feeds` line feeds in it, and how many each has."""
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        lists = [e.ids for e in self.library.encode_batch_fast([" " + "\n ".join(g) + "\n" for g in groups], add_special_tokens=False)]
        stops = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids = np.fromiter(chain.from_iterable(lists), self.dtype, int(stops[-1]) if lists else 0)
        at = np.flatnonzero(ids == self.feed_id[0])
        found = np.diff(np.searchsorted(at, stops), prepend=0)
        if np.array_equal(found, [len(g) * (feeds + 1) for g in groups]):
            ends = at[feeds :: feeds + 1]
            return np.delete(ids, ends), (np.diff(ends, prepend=-1) - 1).astype(np.int32)
        # some line feed isn't a piece of its own: the groups that have it go to the library word by word
        if len(groups) == 1:
            return self.alone(words)
        parts = [self.joined(g, feeds) for g in groups]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As joined(), word by word."""
        raw = self.raw([" " + w for w in words])
        return np.frombuffer(b"".join(raw), self.dtype), np.fromiter(map(len, raw), np.int32, len(raw)) // self.dtype.itemsize

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word start and how many they are, for different words, each with a space before it."""
        table = self.table
        rows = table.rows(words)
        gaps = np.flatnonzero(rows < 0)
        if len(gaps):
            new = words.take(pa.array(gaps))
            lined, two = (x.to_numpy(zero_copy_only=False) for x in (pc.match_substring(new, "\n"), pc.match_substring_regex(new, TWO_LINES)))
            for which, work in ((~lined, lambda w: self.joined(w, 0)), (two, lambda w: self.joined(w, 1)), (lined & ~two, self.alone)):
                some = np.flatnonzero(which)
                if len(some):
                    part = new.take(pa.array(some))
                    rows[gaps[some]] = len(table.words) + np.arange(len(some))
                    table.add(part, *work(part.to_pylist()))
        out = table.flat, table.starts[rows], table.sizes[rows]
        table.trim()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        if not self.cuts:
            return self.raw(texts)
        out, plain = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if self.added is not None and self.added.search(t):
                out[i] = self.raw([t])[0]
            elif t and self.spaced.search(t):
                head, *words = self.cut.split(t)
                out[i] = b"".join([self.raw([head])[0], *self.known(words)])
            elif t:
                plain.append(i)
        for i, ids in zip(plain, self.split([texts[i] for i in plain])):
            out[i] = ids
        return out

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of words, each with a space before it."""
        different = list(dict.fromkeys(words))
        flat, starts, sizes = self.look(pa.array(different, pa.string()))
        ids = {w: flat[a : a + n].tobytes() for w, a, n in zip(different, starts.tolist(), sizes.tolist())}
        return list(map(ids.__getitem__, words))

    def split(self, texts: list[str]) -> list[bytes]:
        """The ids of texts whose spaces are single: distinct words are looked up once, their ids put together as arrays."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts), " ")
        bounds, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False).copy()
        flat, starts, sizes = self.look(coded.dictionary)
        del lists, coded
        heads: dict[str, int] = {}  # a text's first word has no space before it
        of[bounds[:-1]] = [heads.setdefault(t.partition(" ")[0], len(sizes) + len(heads)) for t in texts]
        first = self.heads.look(list(heads), self.raw)
        more = np.fromiter(map(len, first), np.int32, len(first)) // self.dtype.itemsize
        starts = np.concatenate([starts, len(flat) + np.cumsum(more, dtype=np.int32) - more]).astype(np.int32)
        flat, sizes = np.concatenate([flat, np.frombuffer(b"".join(first), self.dtype)]), np.concatenate([sizes, more])
        ids, ends = taken(flat, starts[of], sizes[of])
        data = ids.tobytes()
        cuts = (ends[bounds].astype(np.int64) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _strings(raw: list[bytes]) -> list[str]:
    return [b.decode("utf-8", "replace") for b in raw]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the id arrays of about SAMPLE_DOCS documents, chosen by a hash of id and text; repeated rows count once. A sample too small to train on becomes the dictionary itself."""
    n = docs.count()
    if not n:
        return bytes(8)
    share = min(1.0, SAMPLE_DOCS / n)
    mark = F.xxhash64(F.lit("dictionary"), "doc_id", "text")
    chosen = docs.withColumn("mark", mark).where(F.pmod("mark", F.lit(1 << 30)) < int(share * (1 << 30)))

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for part, raw in text_slices(batch):
                rows = [(m, x + end) for m, x in zip(part.column(2).to_pylist(), enc(_strings(raw))) if len(x) < SAMPLE_DOC_BYTES]
                yield pa.RecordBatch.from_pydict({"mark": pa.array([m for m, _ in rows], pa.int64()), "ids": pa.array([x for _, x in rows], pa.binary())})

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        samples = sorted(x for b in batches for x in b.column(1).to_pylist())
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few or too short samples to train on
            found = b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\0")
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([found], pa.binary())})

    rows = chosen.mapInArrow(serialised, "mark long, ids binary").dropDuplicates(["mark"]).repartition(1).mapInArrow(trained, "dictionary binary").collect()
    return bytes(rows[0][0])


def compression_dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text and write a store to path. docs: doc_id and text; other columns are ignored."""
    spark, docs = docs.sparkSession, docs_of(docs)
    data = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(data).digest()
    spark.createDataFrame([(digest.hex(), bytearray(data))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=compression_dictionary(data))
        end = np.asarray([end_id], dtype=enc.dtype).tobytes()
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("min_doc_id", pa.int64()), ("max_doc_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])
        ids: list[int | None] = []
        frames: list[bytes] = []
        counts: list[int] = []
        block = first = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            offsets = [0, *accumulate(map(len, frames))]
            n = len(frames)
            blob = MAGIC + struct.pack("<B32sI", enc.dtype.itemsize, digest, n) + struct.pack(f"<{n + 1}Q{n}Q", *offsets, *counts) + b"".join(frames)
            known = [i for i in ids if i is not None]
            row = [[shard], [block], [first], [sum(counts)], [min(known, default=None)], [max(known, default=None)], [list(ids)], [blob]]
            block, first, held = block + 1, first + sum(counts), 0
            ids.clear(), frames.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part, raw in text_slices(batch, limit=SLICE_BYTES):
                for i, x in zip(part.column(0).to_pylist(), enc(_strings(raw))):
                    frame = z.compress(x + end)
                    if frames and (held + len(frame) > BLOCK_BYTES or len(frames) >= BLOCK_DOCS):
                        yield flush()
                    ids.append(i), frames.append(frame), counts.append(len(x) // enc.dtype.itemsize + 1)
                    held += len(frame)
        if frames:
            yield flush()

    # rows with the same id and text are told apart by their places, so that they needn't be in one partition
    dealt = docs.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange("doc_id", "tie", "place")
    dealt = dealt.sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")
    dealt.mapInArrow(packed, BLOCKS).write.parquet(f"{path}/blocks")


class Blob:
    """A block's bytes: header, index, and frames read on demand."""

    def __init__(self, blob: bytes, data: bytes):
        import zstandard

        if blob[:6] != MAGIC:
            raise ValueError("not a token block")
        width, digest, n = struct.unpack_from("<B32sI", blob, 6)
        if digest != hashlib.sha256(data).digest():
            raise ValueError("the block was written with another dictionary")
        at = 6 + struct.calcsize("<B32sI")
        self.dtype = np.dtype(f"<u{width}")
        self.offsets = struct.unpack_from(f"<{n + 1}Q", blob, at)
        self.counts = struct.unpack_from(f"<{n}Q", blob, at + 8 * (n + 1))
        self.at, self.blob = at + 8 * (2 * n + 1), memoryview(blob)
        self.z = zstandard.ZstdDecompressor(dict_data=compression_dictionary(data))

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the block's i-th document."""
        ids = np.frombuffer(self.z.decompress(self.blob[self.at + self.offsets[i] : self.at + self.offsets[i + 1]]), dtype=self.dtype)
        if len(ids) != self.counts[i]:
            raise ValueError("a frame doesn't hold the tokens that its index names")
        return ids


def store_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").collect()[0][1])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (tokens of all before it), n_tokens, ids array<int>."""
    return _read(spark, path, lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), "ids", "array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_store, with the CRC-32 of each document's ids (unsigned 32-bit little-endian) in place of the ids."""
    return _read(spark, path, lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32", "long")


def _read(spark: SparkSession, path: str, column, name: str, kind: str) -> DataFrame:
    data = store_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())  # a row per write task
    shards = sorted(totals)
    starts = dict(zip(shards, [0, *accumulate(totals[s] for s in shards)]))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, ids, blob = (batch.column(k)[row].as_py() for k in range(4))
                b = Blob(blob, data)
                for k in range(0, len(b), 1024):
                    some = range(k, min(len(b), k + 1024))
                    at = [starts[shard] + first + x for x in [0, *accumulate(b.counts[i] for i in some)][:-1]]
                    first += sum(b.counts[i] for i in some)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[k : k + 1024], pa.int64()), "start": pa.array(at, pa.int64()), "n_tokens": pa.array([b.counts[i] for i in some], pa.int64()), name: column([b.ids(i) for i in some])})

    return blocks.select("shard", "first_token", "doc_ids", "blob").mapInArrow(opened, f"doc_id long, start long, n_tokens long, {name} {kind}")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Short-document access: only blocks whose id range can hold a wanted id are read, and only the wanted frames are opened."""
    data, wanted = store_dictionary(spark, path), frozenset(doc_ids)
    near = F.lit(False)
    for i in sorted(wanted):
        near = near | F.lit(i).between(F.col("min_doc_id"), F.col("max_doc_id"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, blob = (batch.column(k)[row].as_py() for k in range(2))
                b = Blob(blob, data)
                hits = [k for k, i in enumerate(ids) if i in wanted]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[k] for k in hits], pa.int64()), "ids": pa.array([b.ids(k).astype(np.int32) for k in hits], pa.list_(pa.int32()))})

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(near).select("doc_ids", "blob").mapInArrow(opened, "doc_id long, ids array<int>")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to a store in the shared folder, and read them back from it."""
    import public_tokenizers

    path = work_path(spark, "token-ids")
    write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
