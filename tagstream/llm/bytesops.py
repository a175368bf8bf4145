"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Texts stay in their UTF-8 buffers: a chunk of rows is one ``uint8`` array and
row offsets, and words, hashes and n-grams are arrays over that buffer.  A
chunk holds whole rows only; its size is bounded by ``CHUNK_BYTES`` or by one
single row where that row is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 60_000  # row numbers of a chunk fit 16 bits, which numpy sorts by radix

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first bytes of a little-endian word
LONG = 64  # bytes; longer spans are hashed one by one


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in runs of whole rows of about ``limit`` bytes."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n, start + CHUNK_ROWS)
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def lowered_table(separators: bytes) -> np.ndarray:
    """A 256-entry byte map: A-Z to a-z, separators to 0, all else unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of word bytes; a run ends where its row ends."""
    n = len(is_word)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = is_word[0], is_word[n - 1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:n])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    glued = np.unique(inner[is_word[inner] & is_word[inner - 1]])  # a word at a row's end touches one at the next row's start
    at = np.flatnonzero(edge)
    if len(glued):
        at = np.sort(np.concatenate([at, glued, glued]))
    starts, ends = at[0::2], at[1::2]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever the span stands.

    Eight bytes at a time are folded in and mixed, so no regular pattern of bytes cancels
    out; spans of one length up to 8 never share a hash.  Spans over ``LONG`` go through BLAKE2b.
    """
    size = ends - starts
    out = mix64(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes at each place
    left, at, rows = size, starts, np.flatnonzero((size > 0) & (size <= LONG))
    left, at = left[rows], at[rows]
    while len(rows):
        out[rows] = mix64(out[rows] ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        rows, left, at = rows[more], left[more] - 8, at[more] + 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def bounded_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
