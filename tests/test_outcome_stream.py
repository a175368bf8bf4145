"""Outcomes, sticky state and pause: golden rows, properties, and batch against stream."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagstream.operators import outcome
from tagstream.plans import catalogue, streams  # noqa: F401

START = datetime(2024, 1, 1)
GOLD = [(0.0, "NO_LABEL", True, False), (0.5, "NO_MATCH", True, False), (1.0, "SUCCESS", True, True), (1.5, "NO_LABEL", False, True), (2.9, "SUCCESS", False, True), (3.0, "NO_MATCH", True, True), (3.2, "NO_ROI", True, True), (3.4, "NO_LABEL", True, False), (3.6, "SUCCESS", True, True)]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(c, i, START + timedelta(seconds=t), o) for c in (1, 2) for i, (t, o, *_) in enumerate(GOLD)]
    return spark.createDataFrame(rows, "camera_id long, frame_id long, ts timestamp, outcome string")


def test_pause_and_sticky(frames):
    seen = outcome.paused(frames, "camera_id", ["ts", "frame_id"], 2)
    got = {(r["camera_id"], r["frame_id"]): r["detected"] for r in outcome.sticky(seen, "camera_id", ["ts", "frame_id"]).collect()}
    assert got == {(c, i): d for c in (1, 2) for i, (_, _, looked, d) in enumerate(GOLD) if looked}


def test_successes_are_a_pause_apart(frames):
    times = [r["ts"] for r in outcome.paused(frames, "camera_id", ["ts", "frame_id"], 2).where("camera_id = 1 AND outcome = 'SUCCESS'").orderBy("ts").collect()]
    assert all(b - a >= timedelta(seconds=2) for a, b in zip(times, times[1:]))


def test_outcome_takes_the_first_that_applies(spark):
    flags = [(None,) * 6, (True, False, True, None, None, None), (True, True, True, True, True, True), (True, True, False, False, False, False), (True, True, False, True, False, False), (True, True, False, True, True, False), (True, True, None, True, True, True)]
    rows = spark.createDataFrame(flags, "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean")
    got = [r[0] for r in rows.select(outcome.outcome(*map(F.col, "abcdef"))).collect()]
    assert got == ["NO_FRAME", "NO_ROI", "ERROR", "NO_LABEL", "ALIGN_FAIL", "NO_MATCH", "SUCCESS"]


@pytest.mark.parametrize("batch,stream", [("sticky_state", "stream_sticky"), ("pause_filter", "stream_pause")])
def test_stream_gives_what_batch_gives(spark, sf_dir, batch, stream):
    a, b = (catalogue.QUERIES[n](spark, sf_dir) for n in (batch, stream))
    columns = sorted(a.columns)
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))
