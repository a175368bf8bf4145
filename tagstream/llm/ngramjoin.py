"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected classes.

A text's set holds its distinct shingles of ``words`` words (ASCII A-Z in lower
case, words parted by space and 0x09-0x0D; fewer words: the whole sequence as one
shingle).  Two texts link when ``100 * |x & y| >= percent * |x | y|``.

Method.  Shingles have one global order: by the count of their slot in a table
that counts every shingle of every text, rare first, then by hash.  A text with n
shingles that must share o = ceil(percent * n / 100) of them with any partner
keeps a prefix of n - o + k shingles; two texts that link share at least
min(k, k') shingles of the prefixes cut to that length.  k is chosen for each
text by its estimated cost: entries read, plus verifications, which a longer
prefix with more required matches makes fewer.

Hot groups.  Texts with the same set are one node (the smallest id).  The nodes
at one prefix shingle are first compared with the smallest of them only; what
links there is one component.  Afterwards only pairs of different components
are left: at shingles with up to ``SMALL`` nodes they are listed, counted and cut
by the required matches; at larger ones, blocks of nodes meet in one task each.
There, the texts that also hold one common smaller large shingle, the most usual
one among the first and the last before it, are not compared with each other: they
meet at that one.  So each pair that shares large shingles meets at the smallest of
them at the latest, however few small ones it shares.  All candidates pass a bound first: each text has a bitmap
of the parities of its shingles' slots, about one slot for each shingle (a longer
one is folded to compare it); two bitmaps differ in no more bits than the sets in
shingles, so n + n' less that number is at least twice what is shared.  What the bound leaves is verified on whole sets; no pair is lost.

Words and shingles are told apart by 64-bit hashes that mix every eight bytes (BLAKE2b for
long words), so no pattern of bytes makes two of them equal; by chance two given shingles
do with probability 2 ** -64, and a false or a lost link takes several such pairs.

Entries of prefix shingles are dealt to tasks packed and sorted there, except those of
shingles whose slot counts more than ``HOT``, which Spark combines before the shuffle.

The components are found by alternating large-star and small-star steps on
tables in the shared folder.  To the driver come only the slot counts and bit
tables, of fixed size.

Defined results: a text without words (null, empty) has an empty set and links
with nothing.  Rows with a null id get their count and a null component.  Rows
that repeat an id are one node, linked if any of its texts links.  An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .frames import Scratch, release

WORDS = 5
PERCENT = 80
SLOT_BITS = 20  # slots that count shingles
BIT_BITS = 25  # bits that tell which ids are wanted
SIFTED = 1 << (BIT_BITS - 2)  # ids up to which the bits are of use
BLOCK_BITS = 10  # rows in which either table travels
MOST_MATCHES = 4
VERIFY_COST = 8.0  # a verification against one entry read
HOT = 1 << 16  # entries at one shingle that a task may sort; beyond, they are combined before the shuffle
DEAL = 400_000  # entries packed at a time
PART_BYTES = 64 << 20  # packed entries for one task
SMALL = 128
BLOCK = 512
CHUNK = 1 << 19  # bytes of text taken at a time
PARITY_BITS = (512, 1 << 16)  # of a bitmap: about one for each shingle, within these bounds
_LOW = B.lowered_table(bytes([32, 9, 10, 11, 12, 13]))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the row bounds within them."""
    rows = len(offsets) - 1
    low = _LOW[data]
    start, end, row = B.word_spans(low > 0, offsets)
    h = B.span_hashes(low, start, end)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(bounds)
    made, owner = [], []
    if len(h) >= words:
        total = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            total += h[k : len(h) - words + 1 + k] * np.uint64(_ODD[k % 8] + 2 * (k // 8))
        whole = row[: len(total)] == row[words - 1 :]
        made.append(B.mix64(total[whole]))
        owner.append(row[: len(total)][whole])
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        total = count[few].astype(np.uint64) * np.uint64(_ODD[7])
        for k in range(words - 1):
            has = count[few] > k
            total[has] += h[bounds[few[has]] + k] * np.uint64(_ODD[k % 8] + 2 * (k // 8))
        made.append(B.mix64(total))
        owner.append(few)
    if not made:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h, row = np.concatenate(made), np.concatenate(owner)
    by = np.argsort(h)
    by = by[np.argsort(row[by].astype(np.uint16), kind="stable")]
    h, row = h[by], row[by]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[first], row[first]
    return h, np.searchsorted(row, np.arange(rows + 1))


def in_blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table as rows (block, width, bytes): blocks of zeros left out, values as narrow as they allow."""
    size = max(1, len(table) >> BLOCK_BITS)
    blocks, widths, parts = [], [], []
    for k in range(len(table) // size):
        part = table[k * size : (k + 1) * size]
        if part.any():
            kind = np.min_scalar_type(int(part.max()))
            blocks.append(k)
            widths.append(kind.itemsize)
            parts.append(part.astype(kind).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(widths, pa.int32()), pa.array(parts, pa.binary())], names=["block", "width", "data"])


TABLE = "block int, width int, data binary"
_KINDS = {k().itemsize: k for k in (np.uint8, np.uint16, np.uint32, np.uint64)}


def gathered(parts: DataFrame, size: int, merge: np.ufunc) -> np.ndarray:
    """The tables of all tasks merged into one of ``size``: block by block on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(data.as_buffer(), _KINDS[width]).astype(np.uint64)
                held[block] = merge(held[block], part) if block in held else part
        for block, part in held.items():
            kind = np.min_scalar_type(int(part.max()))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["block", "width", "data"])

    out = np.zeros(size, np.uint64)
    span = max(1, size >> BLOCK_BITS)
    for r in parts.repartition("block").mapInArrow(run, TABLE).collect():  # 2 ** BLOCK_BITS rows
        out[r["block"] * span : (r["block"] + 1) * span] = np.frombuffer(r["data"], _KINDS[r["width"]])
    return out


def slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all texts fall into each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, n = np.zeros(1 << SLOT_BITS, np.uint32), [], 0
        for batch in batches:
            for _, _, data, off in B.chunks(*B.string_buffers(batch.column(0)), CHUNK):
                h, _ = shingles(data, off, words)
                waiting.append((h >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
                n += len(h)
                if n > len(table):
                    table += np.bincount(np.concatenate(waiting), minlength=len(table)).astype(np.uint32)
                    waiting, n = [], 0
        if waiting:
            table += np.bincount(np.concatenate(waiting), minlength=len(table)).astype(np.uint32)
        yield from in_blocks(table)
        del table, waiting
        release()

    return gathered(texts.mapInArrow(run, TABLE), 1 << SLOT_BITS, np.add)


def spread(ids: np.ndarray) -> np.ndarray:
    return (B.mix64(ids.astype(np.uint64)) >> np.uint64(64 - BIT_BITS)).astype(np.int64)


def wanted_bits(ids: DataFrame) -> np.ndarray:
    """A bit for each id of a one-column frame: others may share it, which costs work but changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BIT_BITS, bool)
        for batch in batches:
            table[spread(batch.column(0).to_numpy())] = True
        yield from in_blocks(np.packbits(table))

    return gathered(ids.mapInArrow(run, TABLE), 1 << (BIT_BITS - 3), np.bitwise_or).astype(np.uint8)


def parities(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each row a bitmap: whether an odd number of its shingles falls into each slot, the low bits of the hash."""
    n = np.diff(bounds)
    size = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), *PARITY_BITS)
    out = np.empty(len(n), object)
    for bits in np.unique(size):
        of = np.flatnonzero(size == bits)
        step = max(1, (1 << 19) // int(bits))
        for at in range(0, len(of), step):
            rows = of[at : at + step]
            picked = np.concatenate([h[bounds[r] : bounds[r + 1]] for r in rows])
            slot = np.repeat(np.arange(len(rows)), n[rows]) * bits + (picked & np.uint64(bits - 1)).astype(np.int64)
            odd = (np.bincount(slot, minlength=len(rows) * bits) & 1).astype(bool).reshape(len(rows), bits)
            out[rows] = [r.tobytes() for r in np.packbits(odd, axis=1)]
    return pa.array(out, pa.binary())


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of fewer slots: those that fall together are added modulo 2."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, width), axis=1)


def differing(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, the longer one folded."""
    out = np.zeros(len(left), np.int64)
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for x, y in {*zip(a.tolist(), b.tolist())}:
        rows = np.flatnonzero((a == x) & (b == y))
        width = min(x, y)
        p = folded(np.frombuffer(b"".join(left[r] for r in rows), np.uint8).reshape(len(rows), x), width)
        q = folded(np.frombuffer(b"".join(right[r] for r in rows), np.uint8).reshape(len(rows), y), width)
        out[rows] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return out


def may_link(differ: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets of ``size`` together that differ in at least so many shingles can link."""
    return 100 * (size - differ) >= percent * (size + differ)  # shared <= (size - differ) / 2, and either side is size - shared


def prefixes(docs: DataFrame, held: Broadcast, usual: float, words: int, percent: int) -> DataFrame:
    """(id, n, a, b, one, matches, tokens, parity): set size, 128-bit signature of the set, length of the prefix for
    one match, required matches k, the prefix for k matches in the global order, and the bitmap of parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = held.value
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, off in B.chunks(*B.string_buffers(batch.column(1)), CHUNK):
                h, bounds = shingles(data, off, words)
                n = np.diff(bounds)
                mixed = B.mix64(h + np.uint64(_ODD[5]))
                total = np.concatenate([[np.uint64(0)], np.cumsum(h)]), np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
                a, b = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
                maps = parities(h, bounds)
                f = seen[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                row = np.repeat(np.arange(len(n)), n)
                by = np.argsort(f, kind="stable")  # rows stand in ascending hash, so ties stay so
                by = by[np.argsort(row[by].astype(np.uint16), kind="stable")]
                h, f = h[by], f[by]
                share = -(-percent * n // 100)  # shared with any partner at least
                one = np.where(n > 0, n - share + 1, 0)
                cost = np.concatenate([[0.0], np.cumsum(np.maximum(0.0, f - usual))])
                best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
                for k in range(1, MOST_MATCHES + 1):
                    read = cost[np.minimum(bounds[:-1] + one + k - 1, bounds[1:])] - cost[bounds[:-1]]
                    price = np.where(k <= np.maximum(1, share), read * (1 + VERIFY_COST / k), np.inf)
                    better = price < best
                    best[better], matches[better] = price[better], k
                size = np.minimum(one + matches - 1, n)
                at = np.concatenate([[0], np.cumsum(size)])
                taken = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(bounds[:-1], size)
                tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h[taken].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), *(pa.array(v) for v in (n, a, b, one, matches)), tokens, maps],
                    names=["id", "n", "a", "b", "one", "matches", "tokens", "parity"],
                )
        release()

    return docs.mapInArrow(run, "id long, n long, a long, b long, one long, matches long, tokens array<long>, parity binary")


def marked(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    where = spread(values)
    return (bits[where >> 3] >> (7 - (where & 7)) & 1).astype(bool)


def entries(batches: Iterator[pa.RecordBatch], seen: np.ndarray, hot: int, often: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(token, id, level, matches) of the prefix shingles whose slot counts more than ``hot``, or of the others; level: the least k whose prefix holds it."""
    for batch in batches:
        ids, one, matches = (batch.column(k).to_numpy() for k in range(3))
        tokens = batch.column(3).flatten().to_numpy()
        count = batch.column(3).value_lengths().to_numpy()
        row = np.repeat(np.arange(len(ids)), count)
        level = np.maximum(1, np.arange(len(tokens)) - np.repeat(np.cumsum(count) - count, count) - one[row] + 2)
        use = (seen[(tokens.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] > hot) == often
        yield tokens[use], ids[row[use]], level[use].astype(np.int16), matches[row[use]].astype(np.int16)


ENTRY = "token long, id long, level short, matches short"
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]
_WIDE = 20  # bytes of an entry


def meetings(nodes: DataFrame, held: Broadcast, shingled: int, percent: int, scratch: Scratch) -> DataFrame:
    """(token, id, level, matches, head) of every prefix shingle that nodes share; head: the smallest node at it.

    Entries of shingles that are not ``HOT`` travel packed, some hundred to a row, and are sorted where they arrive; a slot's count
    bounds such a group.  The others are grouped by Spark, which combines them before the shuffle.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingled * (100 - percent) * _WIDE // (100 * PART_BYTES)))
    fields, hot = nodes.select("id", "one", "matches", "tokens"), HOT

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def packed() -> pa.RecordBatch:
            made = [np.concatenate(c) for c in zip(*waiting)]
            part = ((made[0].view(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            made, part = [c[by] for c in made], part[by]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [b"".join(c[lo:hi].tobytes() for c in made) for lo, hi in zip(cuts, np.append(cuts[1:], len(part)))]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(blobs, pa.binary())], names=["part", "data"])

        for made in entries(batches, held.value, hot, False):
            waiting.append(made)
            n += len(made[0])
            if n >= DEAL:
                yield packed()
                waiting, n = [], 0
        if n:
            yield packed()
        del waiting
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b.as_buffer() for batch in batches for b in batch.column(1)]
        sizes = [len(b) // _WIDE for b in blobs]
        token, ids, level, matches = (np.concatenate([np.zeros(0, k), *(np.frombuffer(b, k, n, n * at) for b, n in zip(blobs, sizes))]) for k, at in ((np.int64, 0), (np.int64, 8), (np.int16, 16), (np.int16, 18)))
        del blobs
        by = np.lexsort((ids, token))
        token, ids = token[by], ids[by]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(token)))
        shared = ids[starts] != ids[starts + size - 1]
        head = np.repeat(ids[starts], size)
        use = np.repeat(shared, size)
        made = [token[use], ids[use], level[by][use], matches[by][use], head[use]]
        for at in range(0, len(made[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in made], names=[*_NAMES, "head"])
        del made
        release()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in entries(batches, held.value, hot, True):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=_NAMES)

    rare = fields.mapInArrow(deal, "part int, data binary").repartitionById(parts, F.col("part")).mapInArrow(meet, f"{ENTRY}, head long")
    often = scratch.keep(fields.mapInArrow(grouped, ENTRY))
    heads = often.groupBy("token").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")
    out = scratch.keep(rare.unionByName(often.join(heads, "token")))
    scratch.drop(often)
    return out


def without_copies(known: DataFrame, same: DataFrame) -> DataFrame:
    """One row for each set.  Rows without a bit among the copies' ids stay where they are; only the others are shuffled."""
    copies = known.select("id", "a", "b").join(same, ["a", "b"]).where("id <> rep").select("id")
    bits = known.sparkSession.sparkContext.broadcast(wanted_bits(copies))
    fields = known.select("id", "one", "matches", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("perhaps", pa.array(marked(batch.column(0).to_numpy(), bits.value)))

    sifted = fields.mapInArrow(run, "id long, one long, matches long, tokens array<long>, perhaps boolean")
    exact = sifted.where("perhaps").join(same.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    return sifted.where("NOT perhaps").unionByName(exact).drop("perhaps")


def wanted_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set): the whole sets of the wanted ids, and of a few others.  Texts are not shuffled as long as the bits tell most
    ids apart; beyond ``SIFTED`` ids a join picks them."""
    known = docs.where("id IS NOT NULL")
    few = ids.count() <= SIFTED
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(ids) if few else None)
    if not few:
        known = known.join(ids.distinct(), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits.value is not None:
                batch = batch.filter(pa.array(marked(batch.column(0).to_numpy(), bits.value)))
            for first, end, data, off in B.chunks(*B.string_buffers(batch.column(1)), CHUNK):
                h, bounds = shingles(data, off, words)
                sets = pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), sets], names=["id", "set"])

    return known.select("id", "text").mapInArrow(run, "id long, set binary")


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(k)] for k in (2, 3))
            yield batch.select(["x", "y"]).filter(pa.array([links(a, b, percent) for a, b in zip(left, right)], pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("x"), F.col("set").alias("p")), "x")
    two = one.join(sets.select(F.col("id").alias("y"), F.col("set").alias("q")), "y")
    near = (100 * F.least(F.length("p"), F.length("q")) >= percent * F.greatest(F.length("p"), F.length("q"))) & (F.length("p") > 0)
    return two.where(near).select("x", "y", "p", "q").mapInArrow(run, "x long, y long")


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that their bitmaps and sizes do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = differing(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield batch.select(["x", "y"]).filter(pa.array(may_link(differ, batch.column(4).to_numpy(), percent)))

    side = lambda k, bits, n: nodes.select(F.col("id").alias(k), F.col("parity").alias(bits), F.col("n").alias(n))
    met = pairs.join(side("x", "p", "m"), "x").join(side("y", "q", "n"), "y").where(100 * F.least("m", "n") >= percent * F.greatest("m", "n"))
    return met.select("x", "y", "p", "q", (F.col("m") + F.col("n")).alias("size")).mapInArrow(run, "x long, y long").distinct()


def block_pairs(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of different components over the two sides of a block that their bitmaps do not rule out."""
    new, old = frame[frame["side"] == 0], frame[frame["side"] == 1]
    found = []
    for width, part in old.groupby(old["parity"].map(len)):
        maps, size = np.frombuffer(b"".join(part["parity"]), np.uint8).reshape(len(part), width), part["n"].to_numpy()
        names, places = part["id"].to_numpy(), part["c"].to_numpy()
        for one, n, c, name in zip(new["parity"], new["n"], new["c"], new["id"]):
            take = np.flatnonzero((100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (places != c))
            if not len(take):
                continue
            narrow = min(len(one), width)
            mine = folded(np.frombuffer(one, np.uint8)[None, :], narrow)
            differ = np.bitwise_count(mine ^ folded(maps[take], narrow)).sum(axis=1, dtype=np.int64)
            take = take[may_link(differ, n + size[take], percent)]
            found.append(pd.DataFrame({"x": np.minimum(name, names[take]), "y": np.maximum(name, names[take])}))
    return pd.concat(found) if found else pd.DataFrame({"x": pd.Series(dtype="int64"), "y": pd.Series(dtype="int64")})


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, c): the smallest id of the component of every id on an edge (x, y); a table in the shared folder."""
    both = lambda e: e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    edges = scratch.keep(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    state = None
    while True:
        around = both(edges)
        least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = around.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # Every edge now points down; the smallest lower neighbour takes over the others.
        down = large.where("x > y").groupBy("x").agg(F.min("y").alias("m"))
        small = large.where("x > y").join(down, "x")
        small = small.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(down.select("x", F.col("m").alias("y"))).where("x > y").distinct()
        before, edges = edges, scratch.keep(small)
        scratch.drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == state:
            out = scratch.keep(edges.select(F.col("x").alias("id"), F.col("y").alias("c")))
            scratch.drop(edges)
            return out
        state = now


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of ``docs``; ids are integers."""
    scratch = scratch or Scratch(docs.sparkSession, "ngramjoin")  # it holds Arrow batches small, too
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = slot_counts(texts.select("text"), words)
    held = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, np.uint64(2**31 - 1)).astype(np.int32))
    rows = scratch.keep(prefixes(texts, held, float(counts.mean()), words, percent))
    known = rows.where("id IS NOT NULL AND n > 0")
    same = scratch.keep(known.groupBy("a", "b").agg(F.min("id").alias("rep")))
    nodes = scratch.keep(without_copies(known, same))  # kept also to have one Python worker a task in each step, not two
    marks = known.select("id", "n", "parity")
    near = meetings(nodes, held, int(counts.sum()), percent, scratch)
    stars = near.where("id <> head").select(F.col("head").alias("x"), F.col("id").alias("y")).distinct()
    stars = scratch.keep(bounded(stars, marks, percent))
    ends = lambda p: p.select(F.col("x").alias("id")).unionByName(p.select(F.col("y").alias("id")))
    sets = scratch.keep(wanted_sets(texts, ends(stars), words))
    linked = scratch.keep(verified(stars, sets, percent))
    scratch.drop(nodes, stars, sets)
    joined = components(linked, scratch)

    placed = near.join(joined, "id", "left").select("token", "id", "level", "matches", F.coalesce("c", "id").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("token", "size")
    cross = scratch.keep(placed.join(mixed, "token"))
    scratch.drop(near, joined)

    few = cross.where(F.col("size") <= SMALL)
    one = few.select("token", F.col("id").alias("x"), F.col("level").alias("lx"), F.col("matches").alias("mx"), F.col("c").alias("cx"))
    two = few.select("token", F.col("id").alias("y"), F.col("level").alias("ly"), F.col("matches").alias("my"), F.col("c").alias("cy"))
    met = one.join(two, "token").where("x < y AND cx <> cy AND lx <= least(mx, my) AND ly <= least(mx, my)")
    pairs = met.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(F.least("mx", "my")).alias("k")).where("n >= k").select("x", "y")

    many = cross.where(F.col("size") > SMALL)
    along = Window.partitionBy("id").orderBy("token")
    many = many.withColumn("before", F.filter(F.array(F.first("token").over(along), F.lag("token").over(along)), lambda t: t < F.col("token")))
    usual = many.select("token", F.explode(F.array_distinct("before")).alias("t")).groupBy("token", "t").agg(F.count("*").alias("n"))
    usual = usual.groupBy("token").agg(F.max(F.struct("n", "t"))["t"].alias("usual"))
    many = many.join(usual, "token", "left").withColumn("new", ~F.coalesce(F.array_contains("before", F.col("usual")), F.lit(False)))
    news = many.groupBy("token").agg(F.sum(F.col("new").cast("long")).alias("fresh")).where("fresh > 0")
    many = many.join(news, "token").withColumn("i", F.pmod(F.xxhash64("id"), F.ceil(F.col("fresh") / BLOCK))).withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("size") / BLOCK)))
    fresh = many.where("new").select("token", "id", "c", F.col("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1)).alias("j"), F.lit(0).alias("side"))
    every = many.select("token", "id", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("fresh") / BLOCK) - 1)).alias("i"), F.col("j"), F.lit(1).alias("side"))
    blocks = fresh.unionByName(every).join(marks, "id")
    more = blocks.groupBy("token", "i", "j").applyInPandas(functools.partial(block_pairs, percent=percent), "x long, y long")

    left = scratch.keep(bounded(pairs, marks, percent).unionByName(more.distinct()).distinct())
    sets = scratch.keep(wanted_sets(texts, ends(left), words))
    found = scratch.keep(verified(left, sets, percent))
    scratch.drop(cross, left, sets)
    final = components(linked.unionByName(found), scratch)
    scratch.drop(linked, found)
    of_set = same.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("a", "b", F.coalesce("c", "rep").alias("c"))
    out = rows.where("n > 0").select("id", "n", "a", "b").join(of_set, ["a", "b"], "left").select("id", "n", "c")
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("c")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    out = scratch.keep(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")))
    scratch.drop(rows, same, final)
    return out


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; of rows that repeat an id, all or none; null ids stay."""
    scratch = Scratch(docs.sparkSession, "ngramjoin")
    found = classes(docs, words, percent, id_col, text_col, scratch)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    # A table of known size: Catalyst broadcasts it if it is small, and else shuffles both sides.
    gone = Scratch(docs.sparkSession, "ngramjoin").keep(gone)
    scratch.drop()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's join: four words, 85 %."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4, percent=85)


SQL = """
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS sh FROM split),
listed AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS common FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * common >= 85 * (m + n - common)),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, len(sh) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = sets.doc_id) AS component_id FROM sets
"""
