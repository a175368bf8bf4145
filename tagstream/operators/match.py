"""Blocks to tokens, the confidence of a reading, and the positional match against the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

NO_BLOCKS = 999.0
NOT_RUN = -999.0
SPREAD = 4096


def tokens(blocks: Column) -> Column:
    """The texts of an ordered block list (text, score) that are not blank, trimmed."""
    kept = F.filter(blocks, lambda b: ~text.is_blank(b["text"]))
    return F.transform(kept, lambda b: text.utrim(b["text"]))


def token_rows(blocks: DataFrame, frame: str, pos: str, value: str) -> DataFrame:
    """The same for blocks as rows: (frame, token_pos from 0, token)."""
    from pyspark.sql import Window

    kept = blocks.where(~text.is_blank(F.col(value)))
    turn = F.row_number().over(Window.partitionBy(frame).orderBy(pos)) - 1
    return kept.select(frame, turn.alias("token_pos"), text.utrim(F.col(value)).alias("token"))


def min_score(scores: Column, ran: Column | None = None) -> Column:
    """Lowest score of all blocks, blank ones too: 999 if there is none (not-a-number is none), -999 if reading was not run."""
    real = F.filter(scores, lambda s: ~F.isnan(s) & (s < NO_BLOCKS))
    lowest = F.coalesce(F.array_min(real), F.lit(NO_BLOCKS).cast("float"))
    return lowest if ran is None else F.when(F.coalesce(ran, F.lit(False)), lowest).otherwise(F.lit(NOT_RUN).cast("float"))


def min_score_rows(frames: DataFrame, blocks: DataFrame, key: str, score: str) -> DataFrame:
    """(key, min_score) of every frame, from blocks as rows."""
    real = F.when(~F.isnan(score) & (F.col(score) < NO_BLOCKS), F.col(score))
    lowest = blocks.groupBy(key).agg(F.min(real).alias("min_score"))
    return frames.select(key).join(lowest, key, "left").withColumn("min_score", F.coalesce("min_score", F.lit(NO_BLOCKS)))


def match(readings: DataFrame, entries: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``readings`` with ma_ao, size and color: the trimmed token where its position's list holds it, else ''.

    Token 1 is the code, token 2 the size, token 3 the colour; of more than
    three, all from the third on are joined without separator.  Fewer than three
    (or null) match nothing.  Probes are trimmed and in lower case, but keep inner
    white space, which dictionary entries have lost.  The three lists are probed
    independently of each other.  Catalyst broadcasts the dictionary if it is small.
    """
    t = F.col(tokens_col)
    enough = F.coalesce(F.size(t) >= 3, F.lit(False))
    tail = F.when(F.size(t) == 3, text.utrim(F.element_at(t, 3))).otherwise(text.joined_tail(t, 3))
    found = {"ma_ao": ("model", text.utrim(F.element_at(t, 1))), "size": ("size", text.utrim(F.element_at(t, 2))), "color": ("color", tail)}
    out = readings.withColumns({f"_{name}": F.when(enough, F.coalesce(token, F.lit(""))) for name, (_, token) in found.items()})
    # One table for the three probes, so that it is made and sent once: a bit for each list that holds the value.
    bits = {kind: 1 << i for i, (kind, _) in enumerate(found.values())}
    listed = entries.groupBy("value").agg(F.bit_or(F.coalesce(*[F.when(F.col("kind") == kind, bit) for kind, bit in bits.items()], F.lit(0))).alias("lists"))
    nowhere = F.concat(F.lit("\0"), (F.rand(1) * SPREAD).cast("int"))  # short readings probe for nothing, spread over partitions
    for name, (kind, _) in found.items():
        held = listed.select(F.col("value").alias(f"_{name}_value"), F.col("lists").alias(f"_{name}_lists"))
        out = out.withColumn(f"_{name}_probe", F.coalesce(F.lower(f"_{name}"), nowhere))
        out = out.join(held, F.col(f"_{name}_probe") == F.col(f"_{name}_value"), "left")
    out = out.withColumns({name: F.when(F.col(f"_{name}").isNotNull() & F.col(f"_{name}_lists").bitwiseAND(bits[kind]).eqNullSafe(bits[kind]), F.col(f"_{name}")).otherwise(F.lit("")) for name, (kind, _) in found.items()})
    return out.drop(*[f"_{name}{s}" for name in found for s in ("", "_value", "_lists", "_probe")])


def accepted(matched: DataFrame) -> DataFrame:
    """The readings whose three parts were all found."""
    return matched.where("ma_ao <> '' AND size <> '' AND color <> ''")
