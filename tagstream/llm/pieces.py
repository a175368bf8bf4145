"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The vocabulary is read from a public model file (a parameter; never trained
here).  The lattice of a text has a node for each byte position and an edge for
each piece that matches there; a piece's weight is Zipf's law over its rank in
the file, ``(rank + 2.7) ** -alpha``, and every byte of a character that is no
piece of its own can fall back to its byte token.  Forward filtering sums the
weights of all paths into each node; backward sampling then draws a path from
the end, each edge in proportion to the weight of all paths through it, with
random numbers that are hashes of (seed, row key, unit, step), so a row's pieces
do not depend on its neighbours or on how rows are dealt to tasks.

No piece has a space behind another byte, so the lattice falls apart into units
(spaces and the word behind them; control bytes by themselves).  Forward
filtering runs once for each distinct unit, all new units of a chunk at a time,
and backward sampling for all units of all rows at a time.

Text form: one space is put before a text that is not empty, and decoding takes
it away again; nothing else is normalised, so decoding gives back every text,
literal U+2581 and control characters included.

Defined results: null and empty texts have no pieces, which decode to the empty
text; null ids decode to null.  Rows with a null key share one key.  Repeated rows (same key, same text)
get the same pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .frames import append_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # the query takes another from ``tagstream.pieces.model`` of the session
ALPHA = 1.5
SEED = 1
SPACE = 32
CHUNK = 1 << 18
LINEAR = 48  # units of more bytes are filtered in logarithms
GAIN = 60.0  # about the inverse weight of a byte, so that sums neither vanish nor overflow over LINEAR bytes
MOST_EDGES = 1_000_000  # filtered units are kept for the next chunks of a task until they have so many edges
_NEXT = np.arange(48)[:, None]
IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


@dataclass
class Vocabulary:
    """Pieces by id (``None``: not usable in a text) and the ids of the 256 byte tokens."""

    pieces: list[bytes | None]
    byte_ids: np.ndarray

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: list[bytes | None] = []
        byte_ids = np.full(256, -1, np.int32)
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                pieces.append(None)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                pieces.append(None)
            else:
                pieces.append(piece.replace("▁", " ").encode())
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback, so encoding could lose text")
        for i, piece in enumerate(pieces):
            if piece and b" " in piece.lstrip(b" "):
                raise ValueError(f"piece {i} has a space behind another byte")
        return cls(pieces, byte_ids)


class Lattice:
    """The vocabulary as a trie in arrays, and the two passes."""

    def __init__(self, vocabulary: Vocabulary, alpha: float = ALPHA, seed: int = SEED) -> None:
        self.seed = np.uint64(seed)
        children: list[dict[int, int]] = [{}]
        terminal = [-1]
        rank = 0
        weight = [0.0]
        singles = set()
        joined = np.zeros(256, bool)  # bytes that stand in a piece of two or more bytes
        for i, piece in enumerate(vocabulary.pieces):
            if not piece:
                continue
            node = 0
            for b in piece:
                node = children[node].setdefault(b, len(children))
                if node == len(children):
                    children.append({})
                    terminal.append(-1)
                    weight.append(0.0)
            if terminal[node] < 0:
                terminal[node], weight[node] = i, -alpha * float(np.log(rank + 2.7))
            rank += 1
            if len(piece) > 1:
                joined[list(piece)] = True
            if len(piece.decode()) == 1:
                singles.add(piece)
        fallback = -alpha * float(np.log(rank + 2.7)) - 2.0
        order = sorted(range(len(children)), key=lambda n: not children[n])  # nodes with children first: only they have table rows
        name = np.empty(len(children), np.int32)
        name[order] = np.arange(len(children))
        self.inner = sum(map(bool, children))
        self.place([(list(children[n]), name[list(children[n].values())]) for n in order[: self.inner]])
        self.terminal, self.weight = np.array(terminal, np.int32)[order], np.array(weight)[order]
        self.forget()
        self.byte_ids, self.fallback = vocabulary.byte_ids, fallback
        self.single_ascii = np.array([bytes([b]) in singles for b in range(256)])
        self.solo = ~joined & (np.arange(256) < 128)
        self.singles = singles
        spelled = [p or b"" for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            spelled[i] = bytes([b])
        self.lengths = np.array([len(p) for p in spelled], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def place(self, rows: list[tuple[list[int], np.ndarray]]) -> None:
        """Lay the rows of the transition table over each other where their entries do not meet: node n goes on with byte b
        to ``target[base[n] + b]`` if ``owner`` there is n.  The whole table would take 40 MB a worker."""
        size = 4096 + 8 * sum(len(b) for b, _ in rows)
        self.base, self.owner, self.target = np.zeros(len(rows), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        count = np.array([len(b) for b, _ in rows])
        start = 0
        for n in sorted(np.flatnonzero(count > 1).tolist(), key=lambda n: -count[n]):
            places, at = np.array(rows[n][0]), start
            while not (good := (self.owner[at + _NEXT + places] < 0).all(axis=1)).any():
                at += len(_NEXT)
            at += int(good.argmax())
            self.base[n], self.owner[at + places], self.target[at + places] = at, n, rows[n][1]
            if at > start + 4 * len(_NEXT):  # crowded: later rows do not look here again
                start += len(_NEXT)
        lone = np.flatnonzero(count == 1)  # these fill the gaps
        at = 256 + np.flatnonzero(self.owner[256:] < 0)[: len(lone)]
        self.base[lone], self.owner[at], self.target[at] = at - [rows[n][0][0] for n in lone], lone, [rows[n][1][0] for n in lone]
        last = int(np.flatnonzero(self.owner >= 0).max(initial=0)) + 257
        self.owner, self.target = self.owner[:last].copy(), self.target[:last].copy()

    def needs_fallback(self, data: np.ndarray) -> np.ndarray:
        """Bytes of characters that are no piece of their own."""
        out = (data < 128) & ~self.single_ascii[data]
        lead = np.flatnonzero(data >= 192)
        size = 2 + (data[lead] >= 224) + (data[lead] >= 240)
        value = np.zeros(len(lead), np.int64)
        for k in range(4):
            value = value << 8 | np.where(k < size, data[np.minimum(lead + k, len(data) - 1)], 0)
        for v in np.unique(value):
            piece = bytes(b for b in int(v).to_bytes(4) if b)
            if piece not in self.singles:
                for k in range(len(piece)):
                    out[np.minimum(lead[value == v] + k, len(data) - 1)] = True
        return out

    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the units of the rows."""
        n = len(data)
        start = np.zeros(n, bool)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        space, solo = data == SPACE, self.solo[data] & (data != SPACE)
        start[1:] |= (space[1:] & ~space[:-1]) | solo[1:] | solo[:-1]
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the row bounds within them."""
        rows = len(offsets) - 1
        full = np.diff(offsets) > 0
        buffer = np.full(len(data) + int(full.sum()), SPACE, np.uint8)
        shift = np.cumsum(full)
        buffer[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
        bounds = offsets + np.concatenate([[0], shift])
        if not len(buffer):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        starts = self.units(buffer, bounds)
        ends = np.append(starts[1:], len(buffer))
        found, sample, which = np.unique(B.span_hashes(buffer, starts, ends), return_index=True, return_inverse=True)
        if len(self.made) > MOST_EDGES:
            self.forget()
        at = np.searchsorted(self.known, found)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != found) if len(self.known) else np.arange(len(found))
        if len(new):
            here = sample[new]
            span = ends[here] - starts[here]
            end = np.empty(len(new), np.int64)
            bare = self.needs_fallback(buffer)
            for some, log in ((np.flatnonzero(span <= LINEAR), False), (np.flatnonzero(span > LINEAR), True)):
                if len(some):
                    end[some] = self.filtered(buffer, starts[here[some]], ends[here[some]], bare, log)
            self.known, self.ends = np.insert(self.known, at[new], found[new]), np.insert(self.ends, at[new], end)
            at = np.searchsorted(self.known, found)
        row = np.searchsorted(bounds, starts, side="right") - 1
        nth = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[row]
        state = B.mix64(B.mix64(keys.astype(np.uint64) ^ B.mix64(np.array([self.seed])))[row] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, of_unit = self.sampled(self.ends[at][which], state)
        return ids, np.concatenate([[0], of_unit])[np.searchsorted(starts, bounds)]

    def forget(self) -> None:
        """Drop the filtered units: for each node the first and last of its incoming edges; for each edge its
        summed share, the node it comes from (-1: the unit's start) and its id; for each unit its end node."""
        self.first, self.last = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.summed, self.source, self.made = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.known, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def filtered(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, bare: np.ndarray, log: bool) -> np.ndarray:
        """Forward filtering of units, in logarithms or, for short ones, scaled by ``GAIN`` a byte; their end nodes."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")  # longest first: the units that reach position k are a prefix
        starts, length = starts[order], length[order]
        longest = int(length[0])
        alive = np.searchsorted(-length, -np.arange(longest + 2), side="right")  # units of length k or more
        first = np.concatenate([[0], np.cumsum(alive[:-1])])
        alpha = np.full(first[-1], -np.inf if log else 0.0)
        alpha[: alive[0]] = 0.0 if log else 1.0
        weight, fallback = (self.weight, self.fallback) if log else (np.exp(self.weight), np.exp(self.fallback))
        into, source, made, values = [], [], [], []

        def add(unit: np.ndarray, at: np.ndarray, k: int, to: int, ids: np.ndarray, by: np.ndarray | float) -> None:
            b = first[to] + unit
            if log:
                value = at + by
                alpha[b] = np.logaddexp(alpha[b], value)
            else:
                value = at * (by * GAIN ** (to - k))
                alpha[b] += value
            into.append(b.astype(np.int32))
            source.append((first[k] + unit).astype(np.int32) if k else np.full(len(unit), -1, np.int32))
            made.append(ids)
            values.append(value)

        for k in range(longest):
            n = int(alive[k + 1])
            here = alpha[first[k] : first[k] + n]
            unit = np.flatnonzero(here > -np.inf if log else here > 0)
            at = here[unit]
            where = starts[unit] + k
            alone = bare[where]
            if alone.any():
                add(unit[alone], at[alone], k, k + 1, self.byte_ids[buffer[where[alone]]], fallback)
            room = length[unit] - k
            node, d = np.zeros(len(unit), np.int64), 0
            while len(unit):
                spot = self.base[node] + buffer[where + d]
                node = np.where(self.owner[spot] == node, self.target[spot], -1)
                d += 1
                ids = self.terminal[node]
                end = np.flatnonzero((node >= 0) & (ids >= 0))
                if len(end):
                    add(unit[end], at[end], k, k + d, ids[end], weight[node[end]])
                on = np.flatnonzero((node >= 0) & (node < self.inner) & (room > d))
                unit, node, at, where, room = unit[on], node[on], at[on], where[on], room[on]
        into = np.concatenate(into)
        by = np.argsort(into, kind="stable")
        into = into[by]
        value = np.concatenate(values)[by]
        share = np.exp(value - alpha[into]) if log else value / alpha[into]
        edges = np.searchsorted(into, np.arange(first[-1] + 1))
        total = np.concatenate([[0.0], np.cumsum(share)])
        source = np.concatenate(source)[by]
        nodes, old = len(self.first), len(self.made)
        end = np.empty(len(order), np.int64)
        end[order] = nodes + first[length] + np.arange(len(order))
        self.first, self.last = np.append(self.first, (old + edges[:-1]).astype(np.int32)), np.append(self.last, (old + edges[1:] - 1).astype(np.int32))
        self.summed = np.append(self.summed, total[1:] - total[edges[:-1]][into])
        self.source = np.append(self.source, np.where(source < 0, -1, source + nodes).astype(np.int32))
        self.made = np.append(self.made, np.concatenate(made)[by])
        return end

    def sampled(self, node: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling from the end nodes of all units: their ids in order, and the running number of ids behind each unit."""
        unit, step = np.arange(len(node)), 0
        count = np.zeros(len(node), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(unit):
            edge, last = self.first[node], self.last[node]
            choice = np.flatnonzero(edge < last)
            u = (B.mix64(state[choice] + np.uint64(step * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0**-53
            at, last = edge[choice], last[choice]
            move = np.flatnonzero(self.summed[at] <= u)
            while len(move):
                at[move] += 1
                move = move[at[move] < last[move]]
                move = move[self.summed[at[move]] <= u[move]]
            edge[choice] = at
            drawn.append((unit, self.made[edge]))
            count[unit] += 1
            node = self.source[edge]
            on = np.flatnonzero(node >= 0)
            unit, node, state, step = unit[on], node[on], state[on], step + 1
        behind = np.cumsum(count)
        ids = np.empty(int(behind[-1]) if len(behind) else 0, np.int32)
        for step, (unit, got) in enumerate(drawn):
            ids[behind[unit] - (1 + step)] = got
        return ids, behind

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts."""
        size = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.spelling[np.arange(total[-1]) + np.repeat(self.at[ids] - total[:-1], size)]
        offsets = total[bounds]
        full = np.diff(offsets) > 0
        keep = np.ones(len(out), bool)
        keep[offsets[:-1][full]] = False  # the space before each text
        return out[keep], offsets - np.concatenate([[0], np.cumsum(full)])


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``docs`` with ``ids`` (pieces), ``n_tokens`` and ``lossless``: whether the ids, decoded, are the text."""
    # Built once, here: a few MB for 32,000 pieces, bounded by the vocabulary, and shared by the tasks of a worker.
    held = docs.sparkSession.sparkContext.broadcast(Lattice(Vocabulary.read(model), alpha, seed))
    fields = T.StructType([IDS, T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())])
    key = "_row_key"
    while key in docs.columns:
        key += "_"

    def make():
        lattice = held.value

        def kernel(text: pa.Array, keys: pa.Array) -> list[pa.Array]:
            raw, offsets = B.string_buffers(text)
            keyed = keys.to_numpy(zero_copy_only=False)
            parts, bounds, same, done = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, bool)], 0
            for a, b, data, off in B.chunks(raw, offsets, CHUNK):
                ids, at = lattice.encode(data, off, keyed[a:b])
                back, where = lattice.decode(ids, at)
                if len(back) == len(data) and (where == off).all():
                    differ = np.concatenate([[0], np.cumsum(back != data)])
                    same.append(differ[off[1:]] == differ[off[:-1]])
                else:
                    same.append(np.array([back[where[i] : where[i + 1]].tobytes() == data[off[i] : off[i + 1]].tobytes() for i in range(b - a)], bool))
                parts.append(ids)
                bounds.append(at[1:] + done)
                done += len(ids)
            ends = np.concatenate(bounds)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts)))
            return [lists.cast(kind), pa.array(np.diff(ends)), pa.array(np.concatenate(same))]

        kernel.done = lattice.forget
        return kernel

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(IDS.dataType)
    keyed = docs.withColumn(key, F.xxhash64(F.col(key_col).cast("string")))
    return append_columns(keyed, [text_col, key], fields, make).drop(key)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text that the ids stand for (null ids: null)."""
    held = rows.sparkSession.sparkContext.broadcast(Lattice(Vocabulary.read(model)))

    def make():
        lattice = held.value

        def kernel(ids: pa.Array) -> list[pa.Array]:
            values, bounds = ids.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in ids.to_pylist()])])
            data, off = lattice.decode(values, bounds)
            texts = [None if v is None else data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i, v in enumerate(ids.to_pylist())]
            return [pa.array(texts, pa.string())]

        return kernel

    return append_columns(rows, [ids_col], T.StructType([T.StructField(out_col, T.StringType())]), make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, model=spark.conf.get("tagstream.pieces.model", MODEL)).select("doc_id", "n_tokens", "lossless", "ids")
