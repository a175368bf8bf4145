"""What becomes of a frame, and what the display shows, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETS, CLEARS = "SUCCESS", "NO_LABEL"


def outcome(has_frame: Column, has_roi: Column, failed: Column, has_label: Column, aligned: Column, matched: Column) -> Column:
    """The first that applies: NO_FRAME, NO_ROI, ERROR, NO_LABEL, ALIGN_FAIL, NO_MATCH, SUCCESS.  A null flag is a no."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(has_frame), "NO_FRAME").when(no(has_roi), "NO_ROI").when(F.coalesce(failed, F.lit(False)), "ERROR")
        .when(no(has_label), "NO_LABEL").when(no(aligned), "ALIGN_FAIL").when(no(matched), "NO_MATCH").otherwise("SUCCESS")
    )


def sticky(frames: DataFrame, camera: str, order: list[str], result: str = "outcome") -> DataFrame:
    """``frames`` with ``detected``: success sets it, a frame without label clears it, all else holds it; false at first."""
    change = F.when(F.col(result) == SETS, True).when(F.col(result) == CLEARS, False)
    running = Window.partitionBy(camera).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("detected", F.coalesce(F.last(change, ignorenulls=True).over(running), F.lit(False)))


def paused(frames: DataFrame, camera: str, order: list[str], seconds: float, ts: str = "ts", result: str = "outcome") -> DataFrame:
    """The frames that are looked at: none in the ``seconds`` after a success that was itself looked at; the frame at the end of the pause is.

    A left fold over each camera's frames in order: each decision needs the one
    before.  Frames stream through sorted partitions, one at a time, so a camera's
    history is never held, and one camera is one chain however long.
    """
    if seconds < 0:
        raise ValueError("a pause is not negative")
    pause = pd.Timedelta(seconds=seconds)
    where, what, when = frames.columns.index(camera), frames.columns.index(result), frames.columns.index(ts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, until = None, None
        for part in parts:
            keep = []
            for key, outcome, time in zip(part.iloc[:, where], part.iloc[:, what], part.iloc[:, when]):
                if key != at:
                    at, until = key, None
                seen = until is None or time >= until
                if seen and outcome == SETS:
                    until = time + pause
                keep.append(seen)
            yield part[keep]

    return frames.repartition(camera).sortWithinPartitions(camera, *order).mapInPandas(run, frames.schema)
