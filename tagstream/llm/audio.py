"""Chroma fingerprints of audio columns, and alignment of recordings by them.

A recording is brought to mono at ``RATE``, cut into overlapping Hann windows,
and each window's power is summed into 12 pitch classes.  Frames are smoothed over
time and scaled to length 1.  Over the integral image of the 12 x time picture,
``FILTERS`` compare areas of a window of ``WIDTH`` frames that slides by one frame;
each comparison is quantised to 2 bits in Gray code, and 16 of them make one packed
32-bit integer.  Windows over silence are kept in the fingerprint, as 0, but not
looked up.

Alignment: integers of a query and a recording that are equal in three of their four
bytes vote for their offset.  At every offset with a vote the integers that overlap are
compared; among the offsets where at least ``MIN_OVERLAP`` do, and at most ``MAX_ERROR`` of
their bits differ, the one with most votes (ties: the one nearest 0, then the smaller)
is taken.  Keys of 24 bits are rare enough for most votes to be true ones.

Recordings with equal fingerprints are one class, named by its smallest id; only
classes are compared.  Queries come in blocks of at most ``QUERIES`` classes, which
are broadcast and met by all classes where those stand; only matches are handed
on.  No match is cut off.

Defined results: null media, broken files, files whose rate is not within ``RATES`` and
recordings shorter than one window of ``WIDTH`` frames have an empty fingerprint and match
nothing.  Files are decoded in blocks of ``DECODE`` samples.  Repeated rows fall
in one class.  Rows with a null id have a fingerprint but take no part in matches.

No table holds audio, so the query renders each embedding as a melody (``render``):
its tempo, rate and loudness are fixed, component i sets note i.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import Scratch, append_columns

RATE = 5512
FRAME = 2048
HOP = FRAME // 3
WIDTH = 16
LOWEST, HIGHEST = 55.0, 2600.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SILENCE = 1e-4  # power of a frame against full scale
NOTE = 0.1
RATES = (1000, 1_000_000)  # samples a second; a header that says otherwise is broken
DECODE = 1 << 20
QUERIES = 8192
MIN_OVERLAP = 20
MAX_ERROR = 0.15
HITS = 2_000_000
TOGETHER = 16  # recordings in memory at a time
FRAMES = 512  # frames transformed at a time
CODES = T.StructField("codes", T.ArrayType(T.IntegerType(), False))

#: (shape, first pitch class, pitch classes, frames, outer threshold): the inner threshold is 0.
FILTERS = (
    ("halves", 0, 4, 16, 0.16), ("halves", 4, 4, 16, 0.16), ("halves", 8, 4, 16, 0.16), ("halves", 0, 12, 8, 0.12),
    ("time", 0, 3, 16, 0.14), ("time", 3, 3, 16, 0.14), ("time", 6, 3, 16, 0.14), ("time", 9, 3, 16, 0.14),
    ("cross", 0, 6, 12, 0.14), ("cross", 6, 6, 12, 0.14), ("cross", 3, 6, 16, 0.14), ("centre", 0, 6, 15, 0.14),
    ("centre", 6, 6, 15, 0.14), ("middle", 0, 6, 12, 0.16), ("middle", 6, 6, 12, 0.16), ("middle", 0, 12, 16, 0.12),
)

Decoder = Callable[[object], "np.ndarray | None"]


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """The mean of the channels, in -1..1."""
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2") / np.float32(32768)
    elif width == 4:
        x = (np.frombuffer(raw, "<i4") / 2147483648.0).astype(np.float32)
    else:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, width)[:, -3:].astype(np.int32)
        x = ((wide[:, 2] << 24 | wide[:, 1] << 16 | wide[:, 0] << 8) >> 8) / np.float32(8388608)
    return x.reshape(-1, channels).mean(axis=1)


def decode_wav(data: bytes | None) -> np.ndarray | None:
    """Mono samples in -1..1 at ``RATE`` of a PCM WAV file; None if it is not one."""
    if not data:
        return None
    parts, first, before = [], 0, np.zeros(0, np.float32)  # samples so far, and the last of them
    try:
        with wave.open(io.BytesIO(data)) as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            if not RATES[0] <= rate <= RATES[1]:
                return None
            while len(x := mono(f.readframes(DECODE), width, channels)):
                if rate != RATE:
                    held = np.concatenate([before, x])
                    start = first - len(before)
                    k = np.arange(-(-start * RATE // rate) if start else 0, (first + len(x) - 1) * RATE // rate + 1)
                    at = k * (rate / RATE) - start
                    parts.append(np.interp(at[at >= 0] if not start else at[at > 0], np.arange(len(held)), held).astype(np.float32))
                else:
                    parts.append(x)
                first, before = first + len(x), x[-1:]
    except (wave.Error, EOFError, ValueError, ZeroDivisionError, struct.error):
        return None
    return np.concatenate([np.zeros(0, np.float32), *parts])


def render(vector: list[float] | None) -> np.ndarray | None:
    """A melody of 16-bit steps: component i, cut to -0.5..0.5 and rounded to one of 21 semitones, is note i; without a note a rest."""
    if vector is None:
        return None
    v = np.array([np.nan if x is None else x for x in vector], float)
    rest = ~np.isfinite(v)
    steps = np.rint(20 * (np.clip(np.where(rest, 0, v), -0.5, 0.5) + 0.5))
    pitch = np.repeat(440.0 * 2 ** (steps / 12), round(NOTE * RATE))
    loud = np.repeat(np.where(rest, 0.0, 0.5), round(NOTE * RATE))
    return np.rint(loud * np.sin(2 * np.pi * np.cumsum(pitch) / RATE) * 32767) / 32768


def _classes() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    used = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
    out[used, np.rint(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1
    return out


_BINS = _classes()
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(x: np.ndarray) -> np.ndarray:
    """Of recordings of one length (rows): frames by 12 pitch classes, smoothed over time, each of length 1 or, in silence, 0."""
    if x.shape[1] < FRAME:
        return np.zeros((len(x), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32), FRAME, axis=1)[:, ::HOP]
    step = max(1, FRAMES // len(x))
    power = np.concatenate([np.abs(np.fft.rfft(frames[:, at : at + step] * _HANN, axis=2)) ** 2 / (FRAME * FRAME) @ _BINS for at in range(0, frames.shape[1], step)], axis=1)
    n = power.shape[1] - len(SMOOTH) + 1
    if n < 1:
        return np.zeros((len(x), 0, 12))
    out = sum(w * power[:, k : n + k] for k, w in enumerate(SMOOTH / SMOOTH.sum()))
    size = np.sqrt((out * out).sum(axis=2, keepdims=True))
    return np.where(size > SILENCE, out / np.maximum(size, 1e-30), 0.0)


def codes(x: np.ndarray) -> np.ndarray:
    """The fingerprints of recordings of one length (rows): one 32-bit integer for each position of the window."""
    picture = chroma(x)
    n = picture.shape[1] - WIDTH + 1
    if n < 1:
        return np.zeros((len(x), 0), np.int32)
    whole = np.zeros((len(x), picture.shape[1] + 1, 13))
    whole[:, 1:, 1:] = picture.cumsum(axis=1).cumsum(axis=2)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return whole[:, t1 : t1 + n, c1] - whole[:, t0 : t0 + n, c1] - whole[:, t1 : t1 + n, c0] + whole[:, t0 : t0 + n, c0]

    packed = np.zeros((len(x), n), np.uint32)
    for shape, c, high, wide, limit in FILTERS:
        t, h = wide // 2, high // 2
        if shape == "halves":
            a, b = area(0, wide, c, c + h), area(0, wide, c + h, c + high)
        elif shape == "time":
            a, b = area(0, t, c, c + high), area(t, wide, c, c + high)
        elif shape == "cross":
            a = area(0, t, c, c + h) + area(t, wide, c + h, c + high)
            b = area(t, wide, c, c + h) + area(0, t, c + h, c + high)
        elif shape == "centre":
            a, b = area(wide // 3, 2 * wide // 3, c, c + high), (area(0, wide // 3, c, c + high) + area(2 * wide // 3, wide, c, c + high)) / 2
        else:
            a, b = area(0, wide, c + high // 3, c + 2 * high // 3), (area(0, wide, c, c + high // 3) + area(0, wide, c + 2 * high // 3, c + high)) / 2
        value = np.log1p(a) - np.log1p(b)
        level = (value > -limit).astype(np.uint32) + (value > 0) + (value > limit)
        packed = packed << np.uint32(2) | (level ^ level >> np.uint32(1))
    packed[area(0, WIDTH, 0, 12) == 0] = 0
    return packed.view(np.int32)


def codes_of(recordings: list[np.ndarray | None]) -> list[np.ndarray]:
    """The fingerprint of each recording, those of one length some at a time; none of a missing one."""
    out = [np.zeros(0, np.int32)] * len(recordings)
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(recordings):
        if x is not None:
            by_length.setdefault(len(x), []).append(i)
    for which in by_length.values():
        for at in range(0, len(which), TOGETHER):
            some = which[at : at + TOGETHER]
            for i, made in zip(some, codes(np.stack([recordings[i] for i in some]))):
                out[i] = made
    return out


def fingerprint(media: DataFrame, media_col: str, decoder: Decoder = decode_wav) -> DataFrame:
    """``media`` with ``codes``; ``decoder`` gives the samples of a value of the column."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(CODES.dataType)

    def make():
        def kernel(column: pa.Array) -> list[pa.Array]:
            made = [c for at in range(0, len(column), TOGETHER) for c in codes_of([decoder(v.as_py()) for v in column.slice(at, TOGETHER)])]
            bounds = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *made])))
            return [lists.cast(kind)]

        return kernel

    return append_columns(media, [media_col], T.StructType([CODES]), make)


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return values, np.concatenate([[0], np.cumsum([len(v) for v in column])]).astype(np.int64)


def keys_of(values: np.ndarray) -> np.ndarray:
    """Each integer without one of its four bytes: four keys below 2 ** 26 side by side, which say which is left out."""
    bits = values.view(np.uint32)
    low = [(bits >> np.uint32(8 * k + 8) << np.uint32(8 * k) if k < 3 else np.uint32(0)) | bits & np.uint32((1 << 8 * k) - 1) for k in range(4)]
    return np.stack([x | np.uint32(k << 24) for k, x in enumerate(low)], axis=1).astype(np.int32).ravel()


class Index:
    """Queries' fingerprints, looked up by the keys of their integers."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> None:
        self.ids, self.values, self.bounds = ids, values, bounds
        keys, at = keys_of(values), np.repeat(np.arange(len(values), dtype=np.int32), 4)
        by = np.argsort(keys, kind="stable")
        by = by[values[at[by]] != 0]
        self.keys, self.at = keys[by], at[by]

    def matches(self, ids: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(query id, id, offset, votes, overlap, bit errors) of the recordings given, some at a time."""
        keys = keys_of(values)
        by = np.argsort(keys, kind="stable")  # lookups in order stay in the cache
        lo, hits = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        lo[by] = np.searchsorted(self.keys, keys[by])
        hits[by] = np.searchsorted(self.keys, keys[by], side="right") - lo[by]
        hits[np.repeat(values == 0, 4)] = 0
        total = np.concatenate([[0], np.cumsum(hits)])[4 * bounds]
        first = 0
        while first < len(ids):  # recordings in runs of bounded hits
            end = max(first + 1, int(np.searchsorted(total, total[first] + HITS, side="right")) - 1)
            a, b = 4 * bounds[first], 4 * bounds[end]
            count = hits[a:b]
            if count.any():
                at = self.at[np.arange(int(count.sum())) + np.repeat(lo[a:b] - np.cumsum(count) + count, count)]
                spot = np.repeat(np.arange(a, b), count) // 4
                mine = np.searchsorted(bounds, spot, side="right") - 1
                owner = np.searchsorted(self.bounds, at, side="right") - 1
                yield self.settle(ids, values, bounds, mine, owner, spot - bounds[mine] - at + self.bounds[owner])
            first = end

    def settle(self, ids: np.ndarray, values: np.ndarray, bounds: np.ndarray, mine: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best offset of each pair that has one."""
        low = int(offset.min())
        wide = int(offset.max()) - low + 1
        key, votes = np.unique((mine * len(self.ids) + owner) * wide + (offset - low), return_counts=True)
        offset, mine, owner = key % wide + low, key // wide // len(self.ids), key // wide % len(self.ids)
        a = np.maximum(0, -offset)
        overlap = np.minimum(self.bounds[owner + 1] - self.bounds[owner], bounds[mine + 1] - bounds[mine] - offset) - a
        use = np.flatnonzero((overlap >= MIN_OVERLAP) & (ids[mine] != self.ids[owner]))
        offset, mine, owner, votes, a, overlap = (v[use] for v in (offset, mine, owner, votes, a, overlap))
        wrong = np.zeros(len(use), np.int64)
        ends = np.cumsum(overlap)
        at = 0
        while at < len(use):  # some comparisons at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, side="right")))
            n = overlap[at:to]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            x = self.values[np.repeat(self.bounds[owner[at:to]] + a[at:to], n) + step]
            y = values[np.repeat(bounds[mine[at:to]] + a[at:to] + offset[at:to], n) + step]
            wrong[at:to] = np.add.reduceat(np.bitwise_count((x ^ y).view(np.uint32)), np.cumsum(n) - n, dtype=np.int64)
            at = to
        good = np.flatnonzero(wrong <= MAX_ERROR * 32 * overlap)
        good = good[np.lexsort((offset[good], np.abs(offset[good]), -votes[good], owner[good], mine[good]))]
        best = np.ones(len(good), bool)
        best[1:] = (mine[good][1:] != mine[good][:-1]) | (owner[good][1:] != owner[good][:-1])
        good = good[best]
        return self.ids[owner[good]], ids[mine[good]], offset[good], votes[good], overlap[good], wrong[good]


def align(prints: DataFrame, is_query: Column, id_col: str = "id") -> DataFrame:
    """All of ``prints`` (id_col, codes) as rows (kind ``member``, id, its class, how many integers) and, for each
    class with a query, rows (kind ``match``, its name, the class that matches, offset, votes, overlap, bit errors)."""
    spark = prints.sparkSession
    scratch = Scratch(spark, "audio")
    rows = scratch.keep(prints.select(F.col(id_col).cast("long").alias("id"), "codes", F.coalesce(is_query, F.lit(False)).alias("asked")))
    real = rows.where("id IS NOT NULL AND size(codes) > 0")
    groups = scratch.keep(real.groupBy("codes").agg(F.min("id").alias("class_id"), F.max("asked").alias("asked")))
    queries = groups.where("asked")
    parts = max(1, -(-queries.count() // QUERIES))
    found = []
    for part in range(parts):
        block = queries.where(F.pmod(F.xxhash64("class_id"), F.lit(parts)) == part).select("class_id", "codes").toArrow()  # about QUERIES rows
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast(Index(block.column(0).to_numpy(), *ragged(block.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for got in shared.value.matches(batch.column(0).to_numpy(), *ragged(batch.column(1))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["id", "class_id", "offset", "votes", "overlap", "bit_errors"])

        got = groups.select("class_id", "codes").mapInArrow(run, "id long, class_id long, offset long, votes long, overlap long, bit_errors long")
        found.append(got if parts == 1 else scratch.keep(got))
        if parts > 1:
            shared.destroy()
    member = rows.join(groups.select("codes", "class_id"), "codes", "left").select(F.lit("member").alias("kind"), "id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.size("codes").cast("long").alias("n_codes"))
    out = [member, *(f.withColumn("kind", F.lit("match")) for f in found)]
    none = [F.lit(None).cast("long").alias(c) for c in ("n_codes", "offset", "votes", "overlap", "bit_errors")]
    whole = ["kind", "id", "class_id", "n_codes", "offset", "votes", "overlap", "bit_errors"]
    return reduce(DataFrame.unionByName, [f.select(*f.columns, *[n for n, c in zip(none, whole[3:]) if c not in f.columns]).select(*whole) for f in out])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a recording; queries are those whose vec_id is divisible by 20, against all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    prints = fingerprint(vectors, "embedding", render).select("vec_id", "codes")
    return align(prints, F.col("vec_id") % 20 == 0, "vec_id")
