"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, ``floor(256 * x)``.  A block of data and the queries are
indexed together in one cover tree: a node's children are a net of its points, taken
farthest first, its own centre first (so centres are nested), until all points are
within half the node's radius of one or ``FAN`` are taken; each point belongs to its
nearest.  The levels are made one at a time, only for nodes that are still needed.
Traversal goes over pairs of nodes, one for its queries, one for its data.  With centres
a, b and covering radii r, s (of the queries below, of the data below),

    q . p  <=  a . b + s |a| + r |b| + r s,

and a pair is dropped when that is below the worst kth score of the node's
queries.  At each level a node's queries first meet the data of the same node, which
lie around them: the kth score they have there lifts the worst before pairs are dropped.
What is left is scored in falling order of the bound for each node of queries, which
stops where the bound falls below the worst kth score by then.  A tree that rules out
less than ``PAYS`` of the work of a level, with nodes hardly smaller than those above, is
not grown further, and a block of which nothing to speak of is ruled out is one product.

Queries come in blocks of at most ``QUERIES`` rows, which are broadcast; data stay where
they are, in blocks of ``BLOCK`` rows.  Each task hands on k rows a query.

Defined results: rows whose id or vector is null, or whose vector holds a null or
a component that is not finite, take no part; vectors are compared only with
those of the same length.  Rows with the query's own id are not its candidates.
Ties go to the smaller id; of repeated rows each is a candidate, and a repeated
query id is one query (its smallest vector).  A query without candidates has no
row.  Scores are exact however large, and end at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import Scratch, small_batches

K = 5
SCALE = 256
QUERIES = 32_768  # in a broadcast
GROUP = 4096  # that are searched together
BLOCK = 8192
FAN = 64  # children of a node
LEAF = 64  # points of a node that is not split
FEW = 1 << 21  # pairs of points that are one leaf
PAYS = 0.3
PAIRS = 400_000  # of nodes at one level
COLUMNS = 2048  # data scored at a time
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows: floats hold all partial sums below 2 ** 24, doubles below 2 ** 53."""
    size = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if size < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if size < 2**53:
        return a @ b.T
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.array([[min(max(x, LEAST + 1), MOST) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, id) of each query so far; ``floor``: a score that the kth reaches anyway."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), LEAST, np.int64)
        self.found = np.full((len(ids), k), MOST, np.int64)
        self.floor = np.full(len(ids), LEAST, np.int64)
        self.scored = self.asked = 0  # pairs of a query and a candidate
        self.measured = 0  # distances at most that trees took

    def worst(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def kth(self, score: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The kth best of each row of scores without the query's own; the least number where there are fewer."""
        score = np.where(ids[None, :] == self.ids[rows][:, None], LEAST, score.astype(np.int64))
        if score.shape[1] < self.k:
            return np.full(len(rows), LEAST)
        return np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]

    def lift(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Learn from scores of candidates that will be added later."""
        self.floor[rows] = np.maximum(self.floor[rows], self.kth(score, rows, ids))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates (columns) for some queries (rows)."""
        self.scored += score.size
        worst = self.worst()[rows]
        if score.shape[1] > 4 * self.k and (worst == LEAST).any():
            worst = np.maximum(worst, self.kth(score, rows, ids))
        behind = np.where(self.score[rows, -1] == worst, self.found[rows, -1], MOST)  # a tie with the kth must have a smaller id
        take = score >= worst[:, None]
        if np.count_nonzero(take) > 8 * self.k * len(rows):  # many ties: the smallest ids of each row are enough
            by = np.argsort(ids, kind="stable")
            score, ids, take = score[:, by], ids[by], take[:, by]
            tied = (score == worst[:, None]) & (ids[None, :] < behind[:, None]) & (ids[None, :] != self.ids[rows][:, None])
            take &= (score > worst[:, None]) | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= self.k))
        r, c = np.nonzero(take)
        mine = (ids[c] != self.ids[rows[r]]) & ((score[r, c] > worst[r]) | (ids[c] < behind[r]))
        r, c = r[mine], c[mine]
        if not len(r):
            return
        some = np.unique(r)
        every = np.concatenate([np.repeat(some, self.k), r])
        value = np.concatenate([self.score[rows[some]].ravel(), score[r, c].astype(np.int64)])
        names = np.concatenate([self.found[rows[some]].ravel(), ids[c]])
        by = np.lexsort((names, ~value, every))
        every, value, names = every[by], value[by], names[by]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        at = (first[:, None] + np.arange(self.k)[None, :]).ravel()
        self.score[rows[some]], self.found[rows[some]] = value[at].reshape(-1, self.k), names[at].reshape(-1, self.k)


class Nodes:
    """One level of a cover tree: for each node its centre, its queries and data, and their covering radii."""

    def __init__(self, points: np.ndarray, norm: np.ndarray, split: int, members: list[np.ndarray]) -> None:
        self.points, self.norm, self.split, self.members = points, norm, split, members
        self.centre = np.array([m[0] for m in members])
        self.queries = [m[m < split] for m in members]
        self.data = [m[m >= split] for m in members]
        self.sizes = np.array([[len(q) for q in self.queries], [len(d) for d in self.data]])
        self.radius = np.zeros((2, len(members)))
        for side, parts in enumerate((self.queries, self.data)):
            for j, p in enumerate(parts):
                if len(p):
                    self.radius[side, j] = np.sqrt(float(self.squares(p, self.centre[j]).max()))

    def squares(self, p: np.ndarray, c: int, held: np.ndarray | None = None) -> np.ndarray:
        """Squared distances of points (``held``: their rows) to a point."""
        return np.maximum(0.0, self.norm[p] + self.norm[c] - 2 * ((self.points[p] if held is None else held) @ self.points[c]))

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At most what a query below a and a datum below b score together."""
        ca, cb, r, s = self.centre[a], self.centre[b], self.radius[0, a], self.radius[1, b]
        r, s = r.astype(np.float64), s.astype(np.float64)
        dot = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.points[ca[k : k + 65536]], self.points[cb[k : k + 65536]]) for k in range(0, len(a), 65536))])
        bound = dot + s * np.sqrt(self.norm[ca].astype(np.float64)) + r * np.sqrt(self.norm[cb].astype(np.float64)) + r * s
        return bound + 1e-9 * (1 + np.abs(bound)) + 1e-6 * (1 + r * s)

    def net(self, j: int) -> list[np.ndarray]:
        """The points of a node by their nearest in a net, whose first is the node's centre; each part has its centre first."""
        m = self.members[j]
        far, home, centres = np.full(len(m), np.inf), np.zeros(len(m), np.int64), []
        held = self.points[m]
        at, enough = 0, self.radius[:, j].max() ** 2 / 4
        while len(centres) < FAN:
            d = self.squares(m, m[at], held)
            d[at] = 0.0
            closer = d < far
            far[closer], home[closer] = d[closer], len(centres)
            centres.append(at)
            at = int(far.argmax())
            if far[at] <= enough:
                break
        out = []
        for k, c in enumerate(centres):
            inside = m[home == k]
            out.append(np.concatenate([[m[c]], inside[inside != m[c]]]))
        return out

    def grown(self, wanted: np.ndarray) -> tuple[Nodes, list[np.ndarray]]:
        """The next level, where the wanted nodes that are large enough are split; and for each node its children there."""
        members, children = [], []
        for j in range(len(self.members)):
            parts = self.net(j) if wanted[j] and len(self.members[j]) > LEAF and self.radius[:, j].max() > 0 else [self.members[j]]
            children.append(np.arange(len(members), len(members) + len(parts)))
            members += parts
        return Nodes(self.points, self.norm, self.split, members), children


def search(best: Best, rows: np.ndarray, queries: np.ndarray, data: np.ndarray, ids: np.ndarray) -> None:
    """Take a block of data into the best of some queries (``rows``: which of ``best`` they are)."""
    nq = len(queries)
    if not len(data) or not nq:
        return
    best.asked += nq * len(data)
    whole = [(np.arange(nq), np.arange(len(data)))]
    level = None
    if nq * len(data) > FEW:
        points = np.concatenate([queries, data])
        norm = (points * points).sum(axis=1)
        if norm.max() < 2**22:  # floats hold all sums exactly
            points, norm = points.astype(np.float32), norm.astype(np.float32)
        level = Nodes(points, norm, nq, [np.arange(len(points))])
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    work = nq * len(data)
    while level is not None and work > 2 * FAN * len(level.points):  # else the next level costs more than it can save
        need = np.zeros(len(level.members), bool)
        need[a] = need[b] = True
        best.measured += FAN * int(level.sizes[:, need].sum())
        below, children = level.grown(need)
        if len(below.members) == len(level.members):
            break
        for q, d in zip(below.queries, below.data):
            if len(q) and len(d):
                best.lift(rows[q], product(queries[q], data[d - nq]), ids[d - nq])
        count = np.array([len(c) for c in children])
        if int((count[a] * count[b]).sum()) > PAIRS:
            break
        x = np.concatenate([np.repeat(children[i], count[j]) for i, j in zip(a, b)])
        y = np.concatenate([np.tile(children[j], count[i]) for i, j in zip(a, b)])
        full = (below.sizes[0, x] > 0) & (below.sizes[1, y] > 0)
        x, y = x[full], y[full]
        worst = best.worst()[rows]
        group = np.array([worst[q].min() if len(q) else MOST for q in below.queries], np.float64)
        live = below.bounds(x, y) >= group[x]
        x, y = x[live], y[live]
        left = int((below.sizes[0, x] * below.sizes[1, y]).sum())
        spread = below.radius.max(axis=0)
        middle = np.median(np.repeat(spread, below.sizes.sum(axis=0)))
        if left > (1 - PAYS) * work and middle > (1 - PAYS) * level.radius.max():  # the level does not pay, and no better one is in sight
            if work == nq * len(data):
                level = None
            break
        level, a, b, work = below, x, y, left
    if level is None or len(level.members) == 1:
        for q, d in whole:
            for lo in range(0, len(d), COLUMNS):
                best.add(rows[q], product(queries[q], data[d[lo : lo + COLUMNS]]), ids[d[lo : lo + COLUMNS]])
        return
    bound = level.bounds(a, b)
    by = np.lexsort((-bound, a))
    a, b, bound = a[by], b[by], bound[by]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    for lo, hi in zip(starts, np.append(starts[1:], len(a))):
        q = level.queries[a[lo]]
        at = lo
        while at < hi and bound[at] >= best.worst()[rows[q]].min():
            end, size = at, 0
            while end < hi and size < COLUMNS:
                size += int(level.sizes[1, b[end]])
                end += 1
            other = np.concatenate([level.data[x] for x in b[at:end]]) - nq
            best.add(rows[q], product(queries[q], data[other]), ids[other])
            at = end


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and integer matrix for each vector length; vectors with nulls or non-finite components are left out."""
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = [None if not v.is_valid else len(v) for v in column]
    at = 0
    for row, size in enumerate(sizes):
        if size is None:
            continue
        v = values[at : at + size]
        at += size
        if np.isfinite(v).all():  # a null reads as not a number
            out.setdefault(size, []).append((row, v))
    return {d: (np.array([r for r, _ in rows]), np.floor(SCALE * np.array([v for _, v in rows]).reshape(len(rows), d))) for d, rows in out.items()}


def top(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best other rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("id IS NOT NULL AND v IS NOT NULL")
    scratch = Scratch(spark, "topk")
    asked = scratch.keep(rows.where("asked").groupBy("id").agg(F.min("v").alias("v")))
    parts = max(1, -(-asked.count() // QUERIES))
    group, block_rows = GROUP, BLOCK
    found = []
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id").toArrow()  # about QUERIES rows
        ids = block.column("id").to_numpy()
        held = {d: (ids[at], q) for d, (at, q) in matrices(block.column("v").combine_chunks() if block.num_rows else pa.array([], pa.list_(pa.float64()))).items()}
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            every = {d: (Best(names, k), q) for d, (names, q) in shared.value.items()}
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def settle(d: int) -> None:
                names, m = (np.concatenate(x) for x in zip(*waiting.pop(d)))
                best, q = every[d]
                for lo in range(0, len(q), group):
                    search(best, np.arange(lo, min(lo + group, len(q))), q[lo : lo + group], m, names)

            for batch in batches:
                names = batch.column(0).to_numpy()
                for d, (at, m) in matrices(batch.column(1)).items():
                    if d in every:
                        for lo in range(0, len(at), block_rows):
                            waiting.setdefault(d, []).append((names[at[lo : lo + block_rows]], m[lo : lo + block_rows]))
                            if sum(len(n) for n, _ in waiting[d]) >= block_rows:
                                settle(d)
            for d in list(waiting):
                settle(d)
            for best, _ in every.values():
                real = best.score > LEAST
                of = np.broadcast_to(best.ids[:, None], real.shape)
                yield pa.RecordBatch.from_arrays([pa.array(of[real]), pa.array(best.found[real]), pa.array(best.score[real])], names=["query_id", "vec_id", "score"])

        got = rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(got if parts == 1 else scratch.keep(got))
        if parts > 1:
            shared.destroy()
    if parts > 1:
        scratch.drop(asked)
    return reduce(DataFrame.unionByName, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top(vectors.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
  FROM whole q JOIN whole p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
