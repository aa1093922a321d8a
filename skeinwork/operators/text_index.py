"""An inverted index of trigrams: a search reads its terms' lists, intersects them, and looks at those rows alone.

Rows are in blocks of up to about BLOCK_ROWS rows or BLOCK_BYTES of text, numbered from zero in each. A trigram has a list for every block that holds it: numbers of two
bytes, or a bit for each row of the block if that is shorter. Only these lists are moved to their buckets, never a row for each trigram of a text. What an index gives is a
superset of the rows that hold a term, in any case; the searches that it is put before look at the rows themselves, so they find what they find in a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.sources.stored import MOST_BUCKETS, buckets, put

GRAM = 3
#: Rows and bytes of a block, about; characters that are cut into trigrams at a time; bytes of a bucket, about.
BLOCK_ROWS, BLOCK_BYTES, PIECE, BUCKET_BYTES = 1 << 15, 1 << 22, 1 << 21, 1 << 25


def grams_of(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def _listed(at: np.ndarray, rows: int) -> bytes:
    """Ascending numbers below rows: a byte that tells the form, then bits or the numbers."""
    width = 2 if rows <= 1 << 16 else 4
    if len(at) * width < rows / 8:
        return bytes([width]) + at.astype(f"<u{width}").tobytes()
    mask = np.zeros(rows, bool)
    mask[at] = True
    return b"\0" + np.packbits(mask, bitorder="little").tobytes()


def _mask(lists: list[bytes], rows: int) -> np.ndarray:
    """The numbers of several lists, as a mask over a block's rows."""
    mask = np.zeros(rows, bool)
    for x in lists:
        if x[0]:
            mask[np.frombuffer(x, f"<u{x[0]}", offset=1)] = True
        else:
            bits = np.unpackbits(np.frombuffer(x, np.uint8, offset=1), bitorder="little")[:rows].view(bool)
            mask[: len(bits)] |= bits
    return mask


def _lists(block: int, at: list[int], texts: list[str]) -> pa.RecordBatch:
    """Each trigram of some texts with the numbers of their rows; at ascends."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    small, n = (np.cumsum(seen) - 1)[codes], len(letters)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = own[: 1 - GRAM] == own[GRAM - 1 :]  # no trigram runs over from one text into the next
    gram = ((small[:-2] * n + small[1:-1]) * n + small[2:])[inside]
    which, row = None, own[: 1 - GRAM][inside]
    if n**GRAM * len(texts) >= 1 << 63:
        which, gram = np.unique(gram, return_inverse=True)
    pair = np.sort(gram * len(texts) + row)
    gram, row = np.divmod(pair[np.concatenate(([True], pair[1:] != pair[:-1]))], len(texts))
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    found = gram[starts] if which is None else which[gram[starts]]
    spelled = np.stack([letters[found // n**2], letters[found // n % n], letters[found % n]], 1).astype("<u4").tobytes().decode("utf-32-le")
    numbers, rows = np.array(at)[row], at[-1] + 1
    held = [_listed(numbers[a:b], rows) for a, b in zip(starts, [*starts[1:], len(row)])]
    return pa.RecordBatch.from_arrays([pa.array([spelled[i : i + GRAM] for i in range(0, len(spelled), GRAM)]), pa.array([block] * len(held), pa.int64()), pa.array(held, pa.binary())], ["gram", "_block", "held"])


def _cut(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Lists of the rows (block, number, texts) that come one after the other in a block; a block that is cut has several for a trigram."""
    block, at, texts, size = None, [], [], 0
    for batch in batches:
        for b, i, *columns in zip(*(c.to_pylist() for c in batch.columns)):
            for text in columns:
                for k in range(0, len(text) - GRAM + 1, piece):
                    if texts and (b != block or size >= piece or i < at[-1]):
                        yield _lists(block, at, texts)
                        at, texts, size = [], [], 0
                    block = b
                    at.append(i)
                    texts.append(text[k : k + piece + GRAM - 1] if len(text) > piece else text)
                    size += len(texts[-1])
    if texts:
        yield _lists(block, at, texts)


def _hits(asked: list[list[str]], every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From blocks with lists (gram, held): the rows that have all trigrams of every term, or of one, as bits of longs."""

    def of_blocks(batches):
        for batch in batches:
            blocks, words = [], []
            for block, lists in zip(*(c.to_pylist() for c in batch.columns)):
                by: dict[str, list[bytes]] = {}
                for x in lists:
                    by.setdefault(x["gram"], []).append(x["held"])
                rows = max(8 * len(x["held"]) if not x["held"][0] else int(np.frombuffer(x["held"], f"<u{x['held'][0]}", offset=1)[-1]) + 1 for x in lists)
                rows = -(-rows // 64) * 64
                masks = {g: _mask(x, rows) for g, x in by.items()}
                none = np.zeros(rows, bool)
                terms = [np.logical_and.reduce([masks.get(g, none) for g in grams]) for grams in asked]
                mask = (np.logical_and if every else np.logical_or).reduce(terms)
                if mask.any():
                    blocks.append(block)
                    words.append(np.packbits(mask, bitorder="little").view("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["_block", "words"])

    return of_blocks


@dataclass(frozen=True)
class TextIndex:
    """rows: what was indexed, with _block and _at (its number there), in buckets by block. postings: gram, _block and held (numbers), in buckets by gram."""

    rows: DataFrame
    postings: DataFrame

    def holding(self, *terms: str, every: bool = True) -> DataFrame:
        """Rows that may hold every term, or one of them. Terms of less than three characters rule nothing out."""
        asked = [grams_of(t) for t in terms]
        if not any(asked) or not every and not all(asked):
            return self.rows.drop("_block", "_at")
        asked = [a for a in asked if a]
        lists = self.postings.where(F.col("gram").isin(sorted({g for a in asked for g in a}))).groupBy("_block").agg(F.collect_list(F.struct("gram", "held")).alias("lists"))
        hits = lists.mapInArrow(_hits(asked, every), "_block long, words array<long>")
        bit = F.getbit(F.get("words", F.shiftright("_at", 6)), F.col("_at") % 64)
        return self.rows.join(hits, "_block").where(bit == 1).drop("_block", "_at", "words")


def text_index(rows: DataFrame, key: str, *columns: str) -> TextIndex:
    """An index of all rows by the texts of some columns, null ones empty. key: a column of different values, not null."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(sum(map(F.octet_length, text), F.lit(0)).cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    parts = min(MOST_BUCKETS, blocks, max(buckets(n), -(-size // BUCKET_BYTES)))
    stored = put(rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))), "_block", parts, number=("_at", key))
    # a term may lie in any one column; columns are indexed one by one, so none runs over from one into the next
    piece = PIECE
    lists = stored.select("_block", "_at", *(F.lower(t).alias(f"_{i}") for i, t in enumerate(text))).mapInArrow(lambda batches: _cut(batches, piece), "gram string, _block long, held binary")
    return TextIndex(stored, put(lists, "gram", min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))))
