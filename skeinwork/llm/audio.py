"""Media columns: chroma fingerprints of audio, and alignment of recordings by them.

A recording (WAV, 16-bit PCM) becomes pitch-class frames: spectra of overlapping windows, their energy summed by
semitone modulo the octave, each frame scaled to length one. Sixteen filters compare sums over rectangles of that image, read off
an integral image; each comparison is quantised to two bits in Gray code, and the sixteen are packed into a 32-bit
integer for each position. Positions whose window holds silence have none.

Queries are matched to every recording in blocks of about BLOCK_PRINTS integers, which make a sorted index: equal
integers vote for an offset between the two recordings, the offset with the most votes (of equal ones the smallest shift) is verified by
the share of differing bits over the overlap. Votes are counted VOTES at a time, so that an integer that is everywhere (a steady tone)
costs time, not memory. Only matches leave a task; nothing is joined or kept per pair otherwise.

Every row is a recording of its own, told apart by `row`, a number that it gets when its fingerprint is written.

Defined cases: null, broken or silent audio and audio shorter than a filter window has an empty fingerprint and no match; rows that repeat an id
are different recordings, which match each other and are joined by row, so nothing multiplies; null ids are no queries, and match as any
other; channels are averaged; an empty table gives no rows; recordings of any length are read whole; columns other than id and audio,
whatever their names, are ignored.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import drop_at_exit, read_table, work_path, written

FRAME, HOP = 1024, 256
LOWEST, HIGHEST = 100.0, 1900.0
#: Frames that the widest filter spans.
SPAN = 16
#: Quantiser steps of a filter's log ratio.
STEPS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Integers of a block of queries, and votes that are counted at a time.
BLOCK_PRINTS = 1 << 19
VOTES = 1 << 20
MIN_VOTES = 2
MIN_OVERLAP = 48
MAX_BIT_ERROR = 0.25
QUERY_EVERY = 50


# -- fingerprints


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, pitch classes, frames) of the sixteen filters, by rule."""
    heights, widths = (12, 6, 8, 4), (4, 8, 12, 16)
    return [(k % 4, (k * 5) % (13 - heights[k // 4]), heights[k // 4], widths[(k + k // 4) % 4]) for k in range(16)]


FILTERS = filters()


def pcm(audio: bytes | None) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1, and their rate; none where the bytes aren't 16-bit WAV."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            if w.getsampwidth() != 2:
                return np.empty(0), 1
            x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float64) / 32768
            return x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError, struct.error):
        return np.empty(0), 1


_maps: dict[int, np.ndarray] = {}


def pitch_map(rate: int) -> np.ndarray:
    """Weights that sum a spectrum's bins by pitch class."""
    if rate not in _maps:
        hertz = np.fft.rfftfreq(FRAME, 1 / rate)
        m = np.zeros((len(hertz), 12))
        used = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
        m[used, np.round(12 * np.log2(hertz[used] / 440)).astype(int) % 12] = 1
        _maps[rate] = m
    return _maps[rate]


WINDOW = np.hanning(FRAME)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch classes, each of length one; silent frames are zero."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    out = np.zeros((n, 12))
    for i in range(0, n, 512):
        k = min(512, n - i)
        frames = np.lib.stride_tricks.as_strided(samples[i * HOP :], (k, FRAME), (samples.strides[0] * HOP, samples.strides[0]), writeable=False)
        out[i : i + k] = np.abs(np.fft.rfft(frames * WINDOW, axis=1)) ** 2 @ pitch_map(rate)
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-4, out / np.maximum(size, 1e-12), 0.0)


def packed(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of an image of pitch-class frames and the positions that have them."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return (total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]) / ((t1 - t0) * (p1 - p0))

    out = np.zeros(n, dtype=np.uint32)
    for kind, low, height, width in FILTERS:
        half, mid, high, third = width // 2, low + height // 2, low + height, max(1, width // 4)
        if kind == 0:
            a, b = area(0, half, low, high), area(half, width, low, high)
            if height == 12:  # all pitch classes: when, not which
                a, b = area(0, half, 0, 6), area(half, width, 0, 6)
        elif kind == 1:
            a, b = area(0, width, low, mid), area(0, width, mid, high)
        elif kind == 2:
            a, b = area(third, width - third, low, mid), (area(0, third, low, mid) + area(width - third, width, low, mid)) / 2
        else:
            a, b = area(0, half, low, mid) + area(half, width, mid, high), area(0, half, mid, high) + area(half, width, low, mid)
        value = np.log((0.05 + a) / (0.05 + b))
        out = out << np.uint32(2) | GRAY[np.searchsorted(STEPS, value)]
    loud = np.concatenate([[0], np.cumsum(image.any(axis=1))])
    there = np.flatnonzero(loud[at + SPAN] - loud[at] == SPAN).astype(np.int32)
    return out[there], there


def fingerprint(audio: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The packed integers of a recording, and their positions in frames."""
    return packed(chroma(*pcm(audio)))


def fingerprints(media: DataFrame, id_column: str, audio: str) -> DataFrame:
    """id, prints array<long> (unsigned 32-bit) and places array<int> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [fingerprint(x.as_py()) for x in part.column(1)]
                yield _prints(part.column(0), found)

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(audio).cast("binary").alias("audio")).mapInArrow(run, PRINTS)


PRINTS = "id long, prints array<long>, places array<int>"


def _prints(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([p.astype(np.int64) for p, _ in found], pa.list_(pa.int64())), pa.array([q for _, q in found], pa.list_(pa.int32()))], names=["id", "prints", "places"])


# -- alignment


class Index:
    """Queries' integers, sorted, with the query and the position of each."""

    def __init__(self, ids: list[int], prints: list[np.ndarray], places: list[np.ndarray]):
        self.ids, self.prints, self.places = ids, prints, places
        n = [len(p) for p in prints]
        keys = np.concatenate([np.empty(0, np.uint32), *prints])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.query = np.repeat(np.arange(len(n)), n)[order]
        self.place = np.concatenate([np.empty(0, np.int32), *places])[order].astype(np.int64)
        # each query's integers by position, one query after another, for verification
        self.spans = np.array([int(q[-1]) + 1 if len(q) else 0 for q in places], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.spans)])
        at = np.concatenate([np.empty(0, np.int64), *(q + b for q, b in zip(places, self.starts.tolist()))]).astype(np.int64)
        self.flat, self.there = np.zeros(self.starts[-1], np.uint32), np.zeros(self.starts[-1], bool)
        self.flat[at], self.there[at] = keys, True

    def matches(self, prints: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(query, offset of the recording's positions to the query's, votes, overlap, bit error) for each query that matches."""
        lo, hi = np.searchsorted(self.keys, prints, "left"), np.searchsorted(self.keys, prints, "right")
        n = hi - lo
        met = np.flatnonzero(n)
        if not len(met):
            return []
        lo, n, places_met = lo[met], n[met], places[met].astype(np.int64)
        base = int(places.max()) + int(self.place.max()) + 1  # offsets are between -base and base
        votes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        begins = np.concatenate([[0], np.cumsum(n)])
        for first in range(0, int(begins[-1]), VOTES):
            vote = np.arange(first, min(first + VOTES, int(begins[-1])))
            i = np.searchsorted(begins, vote, "right") - 1
            at = lo[i] + vote - begins[i]
            found, c = np.unique(self.query[at] * (2 * base + 1) + (places_met[i] - self.place[at]) + base, return_counts=True)
            votes, where = np.unique(np.concatenate([votes, found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, c])).astype(np.int64)
        enough = counts >= MIN_VOTES
        query, offset = np.divmod(votes[enough], 2 * base + 1)
        offset, counts = offset - base, counts[enough]
        order = np.lexsort((offset, np.abs(offset), -counts, query))
        best = order[np.unique(query[order], return_index=True)[1]]
        out = []
        step = max(1, VOTES // len(prints))
        for i in range(0, len(best), step):
            some = best[i : i + step]
            q, d = query[some], offset[some]
            place = places.astype(np.int64)[None, :] - d[:, None]
            inside = (place >= 0) & (place < self.spans[q][:, None])
            at = np.where(inside, place + self.starts[q][:, None], 0)
            both = inside & self.there[at]
            overlap = both.sum(axis=1)
            error = (np.bitwise_count(self.flat[at] ^ prints[None, :]) * both).sum(axis=1) / (32 * np.maximum(overlap, 1))
            good = (overlap >= MIN_OVERLAP) & (error <= MAX_BIT_ERROR)
            out += zip(q[good].tolist(), d[good].tolist(), counts[some][good].tolist(), overlap[good].tolist(), error[good].tolist())
        return out


def bit_error(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, offset: int) -> tuple[int, float]:
    """Positions that a, moved by the offset, and b both have, and the share of bits that differ there."""
    moved = at_a.astype(np.int64) + offset  # both ascend
    j = np.searchsorted(at_b, moved)
    i = np.flatnonzero((j < len(at_b)) & (at_b[np.minimum(j, len(at_b) - 1)] == moved)) if len(at_b) else np.empty(0, np.int64)
    j = j[i]
    return len(i), float(np.bitwise_count(a[i] ^ b[j]).sum() / (32 * len(i))) if len(i) else 1.0


MATCHES = "query_row long, match_row long, match_id long, offset int, votes int, overlap int, bit_error double"


def align(prints: DataFrame, every: int = QUERY_EVERY, block: int = BLOCK_PRINTS) -> DataFrame:
    """Matches of each recording whose id is divisible by `every` with every other recording. prints: as from fingerprints() with `row`, on disk."""
    spark, path = prints.sparkSession, work_path(prints.sparkSession, "audio-matches")
    queries = prints.where(F.pmod("id", F.lit(every)) == 0)
    total = queries.agg(F.sum(F.size("prints"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block))  # hashing fills them unevenly
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()
        if not rows and b:
            continue
        index = Index([r["row"] for r in rows], [np.array(r["prints"], dtype=np.uint32) for r in rows], [np.array(r["places"], dtype=np.int32) for r in rows])
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ix, names = held.value, ("query_row", "match_row", "match_id", "offset", "votes", "overlap", "bit_error")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part, found = batch.slice(i, 1024), []
                    for k, p, q, row in zip(*(part.column(c) for c in range(4))):
                        row, k = row.as_py(), k.as_py()
                        for query, *what in ix.matches(p.values.to_numpy().astype(np.uint32), q.values.to_numpy()):
                            if ix.ids[query] != row:
                                found.append((ix.ids[query], row, k, *what))
                    cols = list(zip(*found)) or [[]] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=list(names))

        prints.select("id", "prints", "places", "row").mapInArrow(run, MATCHES).write.mode("append").parquet(path)
        held.destroy()
    drop_at_exit(spark, path)
    return spark.read.schema(MATCHES).parquet(path)


# -- the media column of the bundled tables

RATE, NOTE = 4000, 512
#: Semitones above A2 of seven levels.
SCALE = (0, 3, 5, 7, 10, 14, 19)


def render(values: list[float] | None, lead: int) -> bytes | None:
    """A vector as a tune in WAV: a note for each component, its pitch one of seven levels; first `lead` notes' time of silence."""
    v = np.array(values or [], dtype=float)
    if not len(v) or not np.isfinite(v).all():
        return None
    level = np.clip(np.round(v / max(v.std(), 1e-9) * 1.5) + 3, 0, 6).astype(int)
    hertz = 110 * 2 ** (np.array(SCALE)[level] / 12)
    phase = 2 * np.pi * np.cumsum(np.repeat(hertz, NOTE)) / RATE
    sound = np.concatenate([np.zeros(lead * NOTE), 0.5 * np.sin(phase) + 0.25 * np.sin(2 * phase)])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
        w.writeframes((sound * 32767).astype("<i2").tobytes())
    return out.getvalue()


def tunes(embeddings: DataFrame) -> DataFrame:
    """vec_id and audio, a media column made from every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(v.as_py(), (k or 0) % 4) for k, v in zip(ids, part.column(1))], pa.binary())], names=["vec_id", "audio"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, audio binary")


def numbered(prints: DataFrame) -> DataFrame:
    """prints on disk, with a number for each row."""
    return written(prints.withColumn("row", F.monotonically_increasing_id()), "audio-prints")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a recording, with its fingerprint's size and hash; a row for each match of those whose id is divisible by 50."""
    prints = numbered(fingerprints(tunes(read_table(spark, sf_dir, "embeddings")), "vec_id", "audio"))
    every = prints.select("row", F.col("id").alias("vec_id"), F.size("prints").alias("n_prints"), F.xxhash64("prints").alias("prints_hash"), (F.pmod("id", F.lit(QUERY_EVERY)) == 0).alias("is_query"))
    found = align(prints).drop("match_row")
    return every.join(found, every["row"] == found["query_row"], "left").drop("query_row", "row")
