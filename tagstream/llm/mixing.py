"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share of the output over its share of
the rows: ``size * weight / rows of the source``.  Each row draws a Poisson count
with that mean by inversion: a hash of (seed, key) is a uniform number, and the
count is how many steps of the cumulative distribution it passes.  The row is
exploded by its count and all copies are dealt to random partitions, and sorted
within them, by a hash of (seed, key, copy): a global shuffle, reproducible from
the seed, in one exchange and without a sampling pass.

``weights`` names the sources with a target of their own; all others, null among
them, share what is left to 1 (weight ``rest``) in proportion to their rows.  The
table of rates has one row for each named source and one for the rest, so the
parameter bounds it.  A named source without rows has no rate; the others' rates
do not change.

Defined results: an empty table stays empty.  Rows whose key is null or stands in
several rows, equal ones among them, draw each for itself: the hash then takes in where
the row stands in the input (Spark's partition and row number, which are the same
again when a lost task is repeated, and as long as the files are read alike).  So no
source is dropped or multiplied as a whole, and such copies are spread like all others.
The keys that repeat are a table in the shared folder, which Catalyst broadcasts if it
is small.  Rates above ``MAX_RATE`` are drawn as a sum of equal Poisson
parts, each with its own hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import Scratch

SEED = 7
MAX_RATE = 8.0
STEPS = 48  # P(count >= 48 | rate 8) is below 1e-20, less than a step of the hash
REST = "*"
#: Production weights of the query: the hot source is held to a tenth, three are raised, the rest share what is left.
WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.06, "src3": 0.02}


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the first 13 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def thresholds(rate: float) -> list[float]:
    """The cumulative distribution, up to the last step a 52-bit hash can tell from 1."""
    term = total = math.exp(-rate)
    out = [total]
    for k in range(1, STEPS):
        term *= rate / k
        total += term
        out.append(total)
        if total >= 1 - 2.0**-52:
            break
    return out


def reached(u: Column, steps: list[float]) -> Column:
    """The Poisson count of a uniform number: how many steps it is not below."""
    return F.size(F.filter(F.array(*map(F.lit, steps)), lambda step: u >= step))


def rates(docs: DataFrame, weights: dict[str, float], size: int | None = None, source_col: str = "source") -> dict[str, float]:
    """Mean repetitions of each named source and of the rest (``REST``); ``size`` defaults to the rows there are."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1:
        raise ValueError("weights are shares of the output: not negative, and at most 1 together")
    named = F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(F.lit(REST)) if weights else F.lit(REST)
    counts = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}
    size = sum(counts.values()) if size is None else size
    share = {**weights, REST: 1 - sum(weights.values())}
    return {s: size * share[s] / n for s, n in counts.items()}


def fresh(name: str, taken: set[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in taken:
        name += "_"
    return name


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, size: int | None = None, key_col: str = "doc_id", source_col: str = "source", copy_col: str | None = "copy") -> DataFrame:
    """Every row as often as its draw says, in a global random order; ``copy_col`` numbers the copies from 0."""
    weights = WEIGHTS if weights is None else weights
    rate = rates(docs, weights, size, source_col)
    columns, taken = docs.columns, {c.lower() for c in docs.columns}
    copy = copy_col or fresh("_copy", taken)
    turn, row, again, name = (fresh(c, taken) for c in ("_turn", "_row", "_again", "_name"))
    repeated = docs.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias(again)).agg(F.count("*").alias(row)).where(F.col(row) > 1).select(again)
    repeated = Scratch(docs.sparkSession, "mixing").keep(repeated)
    out = docs.withColumn(row, F.monotonically_increasing_id())
    alone = F.col(key_col).isNotNull()
    if not repeated.isEmpty():
        out = out.join(repeated, F.col(key_col) == F.col(again), "left")
        alone &= F.col(again).isNull()
    out = out.withColumn(name, F.when(alone, F.col(key_col).cast("string")).otherwise(F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("null")), F.lit("#"), F.col(row))))
    count: Column = F.lit(0)
    for source, mean in rate.items():
        parts = max(1, math.ceil(mean / MAX_RATE))
        steps = thresholds(mean / parts)
        drawn = sum((reached(uniform(seed, F.col(name), F.lit(p)), steps) for p in range(parts)), F.lit(0))
        mine = ~F.coalesce(F.col(source_col).isin(*weights), F.lit(False)) if source == REST and weights else F.lit(True) if source == REST else F.col(source_col) == source
        count = F.when(mine, drawn).otherwise(count)
    rest = [c for c in columns if c.lower() != copy.lower()]
    copies = F.explode(F.sequence(F.lit(0), count - 1)).alias(copy)
    out = out.where(count > 0).select(*rest, name, copies)
    out = out.withColumn(turn, uniform(seed + 1, F.col(name), F.col(copy)))
    out = out.repartition(F.col(turn)).sortWithinPartitions(turn, name, copy).drop(turn, name)
    return out if copy_col else out.drop(copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return out.select("doc_id", "copy", "source", "lang", "text")


def sql() -> str:
    """The same draw in DuckDB SQL."""
    names = ", ".join(f"'{s}'" for s in WEIGHTS)
    weight = " ".join(f"WHEN '{s}' THEN {w!r}" for s, w in WEIGHTS.items())
    u = f"(('0x' || substr(md5('{SEED}:' || doc_id || ':0'), 1, 13))::BIGINT / 4503599627370496.0)"
    cumulative = []
    for k in range(21):
        cumulative.append("list_sum(list_transform(range(0, %d), lambda i: exp(-rate) * pow(rate, i) / factorial(i::INTEGER)))" % (k + 1))
    count = " + ".join(f"(u >= {c})::INT" for c in cumulative)
    return f"""
WITH named AS (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '{REST}' END AS s FROM documents),
sized AS (SELECT s, count(*) AS n FROM named GROUP BY s),
rated AS (SELECT s, (SELECT count(*) FROM documents) * (CASE s {weight} ELSE {1 - sum(WEIGHTS.values())!r} END) / n AS rate FROM sized),
drawn AS (SELECT doc_id, source, lang, text, rate, {u} AS u FROM named JOIN rated USING (s)),
counted AS (SELECT *, {count} AS n FROM drawn)
SELECT doc_id, unnest(range(0, n))::INT AS copy, source, lang, text FROM counted WHERE n > 0
"""
