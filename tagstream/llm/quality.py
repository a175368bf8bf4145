"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are maximal runs of word bytes (ASCII letters and digits, all non-ASCII
bytes) or of punctuation; features are hashes of single tokens and of pairs of
neighbours (any token twice in a row is one common feature) in ``2 ** BITS``
slots, each worth ``SCALE / number of tokens`` an
occurrence, so a long text weighs as much as a short one.  Training is
FTRL-proximal, one labelled text at a time in an order fixed by a hash of its
id, ``EPOCHS`` times over; scoring is a sparse dot product and a logistic curve.

``fit`` learns from at most ``max_rows`` labelled texts (those with the smallest
hash of the id), a fixed bound: one task holds their slots and counts, at most 2 MB
for a text however long.  Scoring covers all rows.

Defined results: rows without label, text or id are not learned from and do not count
towards ``max_rows``; of several labels for one id the largest counts, and of several
texts the smallest.
With no rows to learn from every score is 0.5.  A null or empty text has no
token and is scored by the intercept.  Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .frames import append_columns, small_batches
from .langid import held_out

BITS = 18
REPEAT = 0  # the slot of every pair of equal tokens, so that stuttering is one feature whatever the word
SCALE = 30.0
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
MAX_ROWS = 12_000
THRESHOLD = 0.3
OUTPUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[48:58] = 1
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[128:] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each row, and the row bounds within them."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    kind = _KIND[data]
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    inner = offsets[:-1]
    start[inner[inner < n]] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n)
    real = kind[at] > 0
    at, ends = at[real], ends[real]
    return B.span_hashes(data, at, ends), np.searchsorted(at, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the single tokens, slots of the pairs (a pair stands at its first token; the last of a row has none: -1), row bounds."""
    h, bounds = tokens(data, offsets)
    single = (h >> np.uint64(64 - BITS)).astype(np.int64)
    pair = np.full(len(h), -1, dtype=np.int64)
    if len(h) > 1:
        both = B.mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        pair[:-1] = (both >> np.uint64(64 - BITS)).astype(np.int64)
        pair[:-1][h[:-1] == h[1:]] = REPEAT
        last = bounds[1:][np.diff(bounds) > 0] - 1
        pair[last] = -1
    return single, pair, bounds


@dataclass
class Model:
    weights: np.ndarray  # 2 ** BITS + 1 float32: the last, always 0, stands for a missing pair
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        single, pair, bounds = features(data, offsets)
        total = B.bounded_sums(self.weights[single].astype(np.float64) + self.weights[pair], bounds)
        z = self.intercept + total * SCALE / np.maximum(1, np.diff(bounds))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> Model:
    """FTRL-proximal over (slots, values, label) examples in the order given."""
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the last slot is the intercept
    if not rows:
        return Model(np.zeros(size + 1, np.float32), 0.0)

    def settle(i: np.ndarray) -> np.ndarray:
        got = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, got)

    for _ in range(EPOCHS):
        for slots, values, label in rows:
            w[slots] = held = settle(slots)
            p = 1 / (1 + np.exp(-np.clip(held @ values, -60, 60)))
            g = (p - label) * values
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - sigma * held
            n[slots] += g * g
    w = settle(np.arange(size + 1))
    intercept, w[size] = float(w[size]), 0.0
    return Model(w.astype(np.float32), intercept)


EXAMPLE = "turn long, label double, slots binary, counts binary, tokens long"


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turn, label, text) rows as slots and counts, so that no task holds the texts of others."""
    for batch in batches:
        for first, end, data, off in B.chunks(*B.string_buffers(batch.column(2))):
            single, pair, bounds = features(data, off)
            slots, counts = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                some, n = np.unique(np.concatenate([single[a:b], pair[a : max(a, b - 1)]]), return_counts=True)
                slots.append(some.astype(np.int32).tobytes())
                counts.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(slots, pa.binary()), pa.array(counts, pa.binary()), pa.array(np.diff(bounds))], names=["turn", "label", "slots", "counts", "tokens"])


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights, from all examples in the order of ``turn``."""
    seen = []
    for batch in batches:
        for turn, label, slots, counts, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
            values = np.frombuffer(counts, np.int32) * (SCALE / max(1, n))
            seen.append((turn, label, np.append(np.frombuffer(slots, np.int32), np.int32(1 << BITS)), np.append(values, 1.0).astype(np.float32)))
    model = train([(slots, values, label) for _, label, slots, values in sorted(seen, key=lambda x: x[0])])
    used = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(model.weights[used], model.intercept).astype(np.float64))], names=["slot", "weight"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows of ``docs``, at most ``max_rows`` ids of them."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("id"))
    marks = marks.join(texts.select("id"), "id", "left_semi").orderBy("turn", "id").limit(max_rows)  # only ids are shuffled
    rows = texts.join(F.broadcast(marks), "id")  # max_rows bounds the broadcast side
    made = rows.groupBy("id", "turn", "label").agg(F.min("text").alias("text")).select("turn", F.col("label").cast("double").alias("label"), "text").mapInArrow(examples, EXAMPLE)
    kept = made.repartition(1).mapInArrow(learn, "slot long, weight double").toPandas()
    weights, intercept = np.zeros((1 << BITS) + 1, np.float32), 0.0
    for slot, weight in zip(kept["slot"], kept["weight"]):
        if slot < 0:
            intercept = weight
        else:
            weights[slot] = weight
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def make():
        def kernel(text: pa.Array) -> list[pa.Array]:
            raw, offsets = B.string_buffers(text)
            scores = [np.zeros(0)] + [held.value.score(data, off) for _, _, data, off in B.chunks(raw, offsets)]
            s = np.concatenate(scores)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return kernel

    return append_columns(docs, [text_col], OUTPUT, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    out = score(docs, fit(docs.where(~held_out()), labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
