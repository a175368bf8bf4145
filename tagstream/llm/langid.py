"""Language identification with bit-sliced Bloom filters of byte 4-grams.

``train`` counts the 4-grams of every training text exactly, and keeps for each
language those that make up at least ``min_share`` of its 4-grams, so at most
``1 / min_share`` a language, whatever the corpus.  One Bloom filter a language
is stored bit-sliced: slot ``h`` of the table is a bitmask of the languages
whose filter has bit ``h``, so ``HASHES`` lookups and an AND give all languages
that contain a 4-gram.  A text's hits are popcounts per language over its
4-grams, corrected for each filter's own false-positive rate; the language with
most corrected hits wins (ties: the first in sorted order).

Text form: ASCII letters in lower case, every other ASCII byte a space, runs of
spaces one space, two spaces around the text.  Non-ASCII bytes are kept.

Defined results: null text or text without a letter gives ``und`` and score 0;
text with letters but no known 4-gram gives the language with most training
text and score 0.  Rows without text or language are not learned from.  A
corpus with nothing to learn from gives ``und`` everywhere, and one with more than
``MOST_LANGUAGES`` distinct languages is an error.  Texts are read
whole; repeated rows count as often as they stand there.
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
from .frames import Scratch, append_columns, small_batches

HASHES = 3
MIN_SHARE = 2e-5
BITS_EACH = 16  # filter bits for each 4-gram a language may hold
MERGE_AT = 1 << 20
WORD = 64  # languages in one table
MOST_LANGUAGES = 4096  # more distinct values than this are no languages: an error, as the model is held by each worker
OUTPUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

_FORM = np.full(256, 32, dtype=np.uint8)
_FORM[97:123] = np.arange(97, 123)
_FORM[65:91] = np.arange(97, 123)
_FORM[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of each row as packed integers, and the row bounds within them."""
    x = _FORM[data]
    space = x == 32
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inner = offsets[:-1][offsets[:-1] < len(x)]
    keep[inner] |= True  # a row's first byte does not depend on the row before it
    kept = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    bounds = kept[offsets]
    lengths = np.diff(bounds)
    rows = len(lengths)
    start = bounds[:-1] + 4 * np.arange(rows) + 2  # two spaces before and behind each row
    y = np.full(int(bounds[-1]) + 4 * rows, 32, dtype=np.uint8)
    y[np.arange(int(bounds[-1])) + np.repeat(4 * np.arange(rows) + 2, lengths)] = x[keep]
    if len(y) < 4:
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    wide = y.astype(np.uint32)
    packed = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    valid = np.ones(len(packed), dtype=bool)
    ends = (start + lengths + 2)[:-1]  # windows that reach over the end of a row
    for k in (1, 2, 3):
        valid[ends - k] = False
    double = (y[:-1] == 32) & (y[1:] == 32)
    valid &= ~(double[:-2] & double[2:])  # nothing but spaces
    count = np.zeros(len(packed) + 1, dtype=np.int64)
    np.cumsum(valid, out=count[1:])
    firsts = np.concatenate([start - 2, [len(packed)]])
    return packed[valid], count[np.minimum(firsts, len(packed))]


def slots(packed: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``HASHES`` table positions of each 4-gram; ``size`` is a power of two."""
    shift = np.uint64(64 - size.bit_length() + 1)
    wide = packed.astype(np.uint64)
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[:HASHES]:
        yield ((wide * np.uint64(odd)) ^ (wide << np.uint64(29))) * np.uint64(0xA0761D6478BD642F) >> shift


@dataclass
class Model:
    """Sorted languages, bit-sliced tables (one for each 64 languages) and false-positive rates."""

    languages: list[str]
    tables: list[np.ndarray]
    rates: np.ndarray
    fallback: str

    @classmethod
    def build(cls, sets: dict[str, np.ndarray], sizes: dict[str, int]) -> Model:
        languages = sorted(sizes)
        if not languages:
            return cls([], [], np.zeros(0), "und")
        most = max([1, *(len(sets.get(lang, ())) for lang in languages)])
        size = 1 << max(10, (most * BITS_EACH - 1).bit_length())
        tables, rates = [], []
        for at in range(0, len(languages), WORD):
            group = languages[at : at + WORD]
            kind = np.uint8 if len(group) <= 8 else np.uint16 if len(group) <= 16 else np.uint32 if len(group) <= 32 else np.uint64
            table = np.zeros(size, dtype=kind)
            for bit, lang in enumerate(group):
                for where in slots(sets.get(lang, np.zeros(0, np.uint32)), size):
                    table[where] |= kind(1 << bit)
                rates.append(float(np.mean(table >> kind(bit) & kind(1))) ** HASHES)
            tables.append(table)
        fallback = min(languages, key=lambda lang: (-sizes[lang], lang))
        return cls(languages, tables, np.array(rates), fallback)

    def hits(self, packed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Corrected hits, rows by languages."""
        out = []
        for table in self.tables:
            mask = None
            for where in slots(packed, len(table)):
                got = table[where]
                mask = got if mask is None else mask & got
            for bit in range(min(WORD, len(self.languages) - len(out))):
                out.append(B.bounded_sums((mask >> table.dtype.type(bit)) & table.dtype.type(1), bounds))
        n = np.diff(bounds)[:, None]
        return np.maximum(0.0, (np.stack(out, axis=1) - n * self.rates) / (1 - self.rates))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        if not self.languages:
            return ["und"] * rows, np.zeros(rows)
        packed, bounds = grams(data, offsets)
        hits = self.hits(packed, bounds)
        best = hits.argmax(axis=1)
        top = hits[np.arange(rows), best]
        score = np.clip(top / np.maximum(1, np.diff(bounds)), 0.0, 1.0)
        letter = B.bounded_sums(((data | 32) >= 97) & ((data | 32) <= 122), offsets) > 0
        names = [self.languages[i] if t > 0 else self.fallback for i, t in zip(best, top)]
        for i in np.flatnonzero(~letter):
            if not any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")):
                names[i], score[i] = "und", 0.0
        return names, score


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's rows: (lang, text) batches in, one exact count for each pair out."""
    names: dict[str, int] = {}
    keys, counts, waiting = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(all_keys)
        all_keys, all_counts = all_keys[order], all_counts[order]
        first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
        return all_keys[first], np.add.reduceat(all_counts, first)

    def rows() -> Iterator[pa.RecordBatch]:
        k, c = merged()
        langs = np.array(list(names), dtype=object)
        for at in range(0, len(k), 100_000):
            part = k[at : at + 100_000]
            index = pa.array((part >> np.uint64(32)).astype(np.int32))
            lang = pa.DictionaryArray.from_arrays(index, pa.array(langs, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(c[at : at + 100_000])], names=["lang", "gram", "n"])

    for batch in batches:
        raw, offsets = B.string_buffers(batch.column(1))
        lang = np.array([names.setdefault(v, len(names)) for v in batch.column(0).to_pylist()], dtype=np.uint64)
        for a, b, data, off in B.chunks(raw, offsets):
            packed, bounds = grams(data, off)
            if not len(packed):
                continue
            key, n = np.unique(packed | np.repeat(lang[a:b], np.diff(bounds)) << np.uint64(32), return_counts=True)
            keys.append(key)
            counts.append(n.astype(np.int64))
            waiting += len(key)
            if waiting > MERGE_AT:
                k, c = merged()
                keys, counts, waiting = [k], [c], 0
                if len(k) > MERGE_AT // 2:  # bounded memory: hand on what has been counted
                    yield from rows()
                    keys, counts = [], []
    if keys:
        yield from rows()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> Model:
    """Learn from all rows of ``docs`` that have a text and a language."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A window over a language would put it in one task: totals are a second, small aggregate.
    scratch = Scratch(docs.sparkSession, "langid")
    counted = scratch.keep(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct values of {lang_col!r}: these are no languages")
    sizes = {r["lang"]: int(r["n"]) for r in totals}
    sets: dict[str, np.ndarray] = {}
    if sizes:
        least = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1.0, n * min_share))])
        kept = counted.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toPandas()
        sets = {lang: np.sort(part.to_numpy()).astype(np.uint32) for lang, part in kept.groupby("lang")["gram"]}
    scratch.drop()
    return Model.build(sets, sizes)


def detect(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (corrected share of the text's 4-grams in that language's filter)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 MB for each 64 languages: see MIN_SHARE

    def make():
        def kernel(text: pa.Array) -> list[pa.Array]:
            raw, offsets = B.string_buffers(text)
            names: list[str] = []
            scores = [np.zeros(0)]
            for _, _, data, off in B.chunks(raw, offsets):
                got, score = held.value.predict(data, off)
                names += got
                scores.append(score)
            return [pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())]

        return kernel

    return append_columns(docs, [text_col], OUTPUT, make)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows of the fold that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    out = detect(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
