"""Per-camera state on streams: the sticky display and the pause after a success.

Rows of a micro-batch are taken in (ts, frame) order; a late row is applied when
it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.outcome import CLEARS, SETS

COLUMNS = ["camera_id", "frame_id", "ts", "outcome"]
FRAME = "camera_id long, frame_id long, ts timestamp, outcome string"


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(["ts", "frame_id"], kind="stable")


def _sticky(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    shown = state.get[0] if state.exists else False
    rows = _ordered(parts)
    detected = []
    for outcome in rows["outcome"]:
        shown = True if outcome == SETS else False if outcome == CLEARS else shown
        detected.append(shown)
    state.update((shown,))
    yield rows[COLUMNS].assign(detected=detected)


def sticky(frames: DataFrame) -> DataFrame:
    """A stream of frames (camera_id, frame_id, ts, outcome) with ``detected``."""
    return frames.select(*COLUMNS).groupBy("camera_id").applyInPandasWithState(_sticky, f"{FRAME}, detected boolean", "shown boolean", "append", GroupStateTimeout.NoTimeout)


def paused(frames: DataFrame, seconds: float) -> DataFrame:
    """A stream of frames without those in the pause after a success that was itself looked at."""
    pause = pd.Timedelta(seconds=seconds)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = _ordered(parts)
        keep = []
        for ts, outcome in zip(rows["ts"], rows["outcome"]):
            seen = until is None or ts >= until
            if seen and outcome == SETS:
                until = ts + pause
            keep.append(seen)
        if until is not None:
            state.update((until.value // 1000,))
        yield rows[COLUMNS][keep]

    return frames.select(*COLUMNS).groupBy("camera_id").applyInPandasWithState(fold, FRAME, "until_us long", "append", GroupStateTimeout.NoTimeout)
