"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Encoding puts a space before the text, turns spaces into the marker U+2581 and looks for the segmentation of the best total
log score; of equal ones, for each end the one whose last piece begins first. A character that is in no piece costs the
lowest score less ten and is spelled by the ids of its UTF-8 bytes. Words (markers, then other characters) are segmented one by one,
with a bounded memo, which is exact as no piece crosses their boundaries.

The model files at hand hold ranks (a BPE's merges, the most frequent first), not log probabilities, and tokenizers aren't trained here. So a piece's log
score is that of its rank by the law of Zipf and Mandelbrot, 1 / (rank + SHIFT) over the sum of all. A model whose scores are log
probabilities is used as it is.

Decoding joins pieces, turns markers into spaces, spells byte ids, and drops the space that encoding put first.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text is spelled by
bytes, so decoding gives the text back for every text; bytes that don't form UTF-8 decode to U+FFFD; repeated rows are
each encoded; texts of any length are encoded whole; an empty table gives no rows; columns other than doc_id and text, whatever their
names, are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import Memo, docs_of, read_table, text_slices
from skeinwork.llm.pieces import MARK, WORD, Vocabulary

UNKNOWN_PENALTY = 10.0
SHIFT = 2.7


def log_scores(vocabulary: Vocabulary) -> dict[str, float]:
    """Natural logarithms of the pieces' probabilities."""
    given = vocabulary.score
    if max(given.values()) <= 0 and abs(np.exp(list(given.values())).sum() - 1) < 0.1:  # log probabilities already
        return dict(given)
    ranked = sorted(given, key=lambda p: (-given[p], vocabulary.id[p]))
    shares = 1 / (np.arange(1, len(ranked) + 1) + SHIFT)
    return dict(zip(ranked, np.log(shares / shares.sum()).tolist()))


class DoubleArray:
    """A trie over bytes: the child of s by byte b is t = base[s] + b if check[t] == s; value[t] is the key's number or -1."""

    def __init__(self, keys: Iterable[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        values: list[int] = [-1]
        for key, value in keys:
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][b]
            values[node] = value
        self.base, self.check, self.value = array("i", [0]), array("i", [0]), array("i", [-1])
        used = bytearray([1])
        place, free, queue = {0: 0}, 1, [0]
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            while free < len(used) and used[free]:
                free += 1
            at, tries = max(free - kids[0], 1), 0
            while any(at + b < len(used) and used[at + b] for b in kids):
                at, tries = at + 1, tries + 1
            if tries > 16:  # what is left free below is too scattered to look at again and again
                free = at + kids[0]
            grow = at + 256 - len(used)
            if grow > 0:
                used.extend(bytes(grow))
                self.base.extend([0] * grow)
                self.check.extend([-1] * grow)
                self.value.extend([-1] * grow)
            s = place[node]
            self.base[s] = at
            for b in kids:
                t = at + b
                used[t], self.check[t], self.value[t] = 1, s, values[children[node][b]]
                place[children[node][b]] = t
                queue.append(children[node][b])

    def prefixes(self, text: bytes, at: int = 0) -> list[tuple[int, int]]:
        """(end, number) of every key that text has at `at`."""
        out, s = [], 0
        base, check, value = self.base, self.check, self.value
        for i in range(at, len(text)):
            t = base[s] + text[i]
            if t >= len(check) or check[t] != s or t == 0:
                break
            s = t
            if value[s] >= 0:
                out.append((i + 1, value[s]))
        return out


class Encoder:
    """Encodes and decodes with a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.trie = DoubleArray((p.encode(), i) for p, i in vocabulary.id.items())
        self.scores = [0.0] * len(vocabulary.pieces)
        self.score = log_scores(vocabulary)
        for p, s in self.score.items():
            self.scores[vocabulary.id[p]] = s
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.dtype = np.dtype("<u2" if len(vocabulary.pieces) <= 1 << 16 else "<u4")
        self.memo = Memo()
        self.mark = MARK.encode()
        self.out = [None] * len(vocabulary.pieces)
        for p, i in vocabulary.id.items():
            self.out[i] = p.encode().replace(self.mark, b" ")
        for b, i in enumerate(vocabulary.byte_id):
            self.out[i] = bytes([b])

    def viterbi(self, text: bytes) -> list[int]:
        """The ids of the best segmentation of normalised text."""
        n, scores, unknown = len(text), self.scores, self.unknown
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        size = len(check)
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            b = text[i]
            single = i + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            s, lone = 0, False
            for j in range(i, n):
                t = base[s] + text[j]
                if t >= size or check[t] != s or not t:
                    break
                s, v = t, value[t]
                if v >= 0:
                    total, end = here + scores[v], j + 1
                    lone = lone or end == single
                    if best[end] is None or total > best[end]:
                        best[end], back[end] = total, (i, v)
            if not lone:
                end = min(single, n)
                total = here + unknown
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, (i, -1)
        ids, at = [], n
        while at:
            start, v = back[at]
            ids.extend([v] if v >= 0 else [self.vocabulary.byte_id[b] for b in reversed(text[start:at])])
            at = start
        return ids[::-1]

    def word(self, word: str) -> bytes:
        """The ids of a word: its spaces, then its other characters. U+2581 among these is spelled by bytes."""
        if MARK not in word:
            ids = self.viterbi(word.replace(" ", MARK).encode())
        else:
            spelled = [self.vocabulary.byte_id[b] for b in self.mark]
            head, *rest = word.split(MARK)
            ids = self.viterbi(head.replace(" ", MARK).encode())
            for part in rest:
                ids += spelled + self.viterbi(part.encode())
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of self.dtype."""
        cut = [WORD.findall(" " + t) if t else [] for t in texts]
        wanted = {w for words in cut for w in words}
        self.memo.room(wanted)
        for w in self.memo.missing(wanted):
            self.memo[w] = self.word(w)
        return [b"".join(map(self.memo.__getitem__, words)) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        out, some = self.out, []
        for i in ids:
            piece = out[i]
            if piece is not None:  # control and unknown ids have no text
                some.append(piece)
        joined = b"".join(some)
        return (joined[1:] if joined.startswith(b" ") else joined).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def piece_encoder(path: str) -> Encoder:
    """One encoder for each worker process and model file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids array<int> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = piece_encoder(model)
        for batch in batches:
            for part, raw in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(e.encode([x.decode("utf-8", "replace") for x in raw]), e.dtype)], names=["doc_id", "ids"])

    return docs_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _lists(raw: list[bytes], dtype: np.dtype) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // dtype.itemsize for x in raw])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype=dtype).astype(np.int32)))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = piece_encoder(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [e.decode(ids.as_py() or ()) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Every text encoded and decoded again: doc_id, n_pieces, n_bytes (ids that spell bytes), ids_crc32 (of unsigned 32-bit little-endian ids), same (whether decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = piece_encoder(model)
        spells = np.zeros(len(e.vocabulary.pieces), dtype=bool)
        spells[e.vocabulary.byte_id] = True
        for batch in batches:
            for part, raw in text_slices(batch):
                texts = [x.decode("utf-8", "replace") for x in raw]
                ids = [np.frombuffer(x, dtype=e.dtype) for x in e.encode(texts)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0),
                    "n_pieces": pa.array(map(len, ids), pa.int64()),
                    "n_bytes": pa.array([int(spells[x].sum()) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "same": pa.array([e.decode(x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_()),
                })

    return docs_of(docs).mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, same boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
