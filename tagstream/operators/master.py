"""The master sheet: three lists of distinct, normalised values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

KINDS = ("model", "size", "color")


class NoValidData(ValueError):
    """The sheet has neither a size nor a colour."""


def skip_header(sheet: DataFrame, pos: str = "pos") -> DataFrame:
    """Without the first row by position, whatever it says."""
    first = sheet.agg(F.min(pos).alias("_first"))
    return sheet.join(F.broadcast(first), F.col(pos) > F.col("_first")).drop("_first")  # one row


def dictionary(sheet: DataFrame) -> DataFrame:
    """(kind, value, first_pos): distinct values of each column, by itself, with the position where each stood first."""
    pairs = ", ".join(f"'{k}', {k}" for k in KINDS)
    cells = sheet.selectExpr("pos", f"stack({len(KINDS)}, {pairs}) AS (kind, cell)").where(~text.is_blank(F.col("cell")))
    return cells.groupBy("kind", text.dictionary_form(F.col("cell")).alias("value")).agg(F.min("pos").alias("first_pos"))


def validity(entries: DataFrame) -> DataFrame:
    """One row: entries of each kind, and whether the sheet is usable - which codes do not decide."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    out = entries.agg(*[count(k).alias(f"{k}s") for k in KINDS])
    return out.withColumn("valid", (F.col("sizes") > 0) | (F.col("colors") > 0))


def checked(entries: DataFrame) -> DataFrame:
    """The dictionary itself, or ``NoValidData``."""
    if entries.where(F.col("kind").isin("size", "color")).isEmpty():
        raise NoValidData("no size and no colour in the sheet")
    return entries


def listing(entries: DataFrame) -> DataFrame:
    """(kind, listing): each kind's values in first-seen order as text."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "value"))), lambda e: e["value"])
    return entries.groupBy("kind").agg(text.listed(values).alias("listing"))


def camera_labels(cameras: DataFrame, order: str, name: str) -> DataFrame:
    """(camera_index, label), numbered from 0; one row with a null index if there is no camera."""
    # All cameras of one host stand in one window: a device list, not data.
    numbered = cameras.select(F.col(name).alias("name"), (F.row_number().over(Window.orderBy(order)) - 1).alias("camera_index"))
    labels = numbered.select("camera_index", F.concat(F.col("camera_index").cast("string"), F.lit(". "), F.col("name")).alias("label"))
    none = cameras.sparkSession.range(1).join(labels.limit(1).select(F.lit(1).alias("has")), F.lit(True), "left_anti")
    return labels.unionByName(none.select(F.lit(None).cast("int").alias("camera_index"), F.lit("No camera found.").alias("label")))
