"""Golden rows of the geometry, and its invariants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagstream.functions import geometry as G


def one(spark, column):
    return spark.range(1).select(column.alias("r")).head()["r"]


def lits(*values):
    return [F.lit(v) for v in values]


ROIS = [
    ((1280, 720, 149, 78, 298, 156), 0.43333334, 20.666656, 0.0, (296, 180, 687, 360), True),
    ((1280, 720, 0, 0, 100, 100), 0.43333334, 20.666656, 0.0, (0, 0, 230, 230), True),
    ((1280, 720, 590, 10, 6, 50), 0.43333334, 20.666656, 0.0, (0, 0, 0, 0), False),
    ((640, 480, 149, 78, 298, 156), 0.65, 90.0, 0.0, (90, 120, 458, 240), True),
    ((640, 480, 0, 0, 596, 312), 0.65, 90.0, 0.0, (0, 0, 640, 480), True),
]


@pytest.mark.parametrize("case", ROIS)
def test_guide_box_to_frame(spark, case):
    (iw, ih, x, y, w, h), scale, ox, oy, mapped, ok = case
    r = one(spark, G.guide_to_frame(*lits(x, y, w, h, 596, 312, iw, ih)))
    assert tuple(r["mapped"]) == mapped and r["has_image"] == ok
    assert (r["scale"], r["offset_x"], r["offset_y"]) == pytest.approx((scale, ox, oy), rel=1e-6, abs=1e-4)


def test_no_frame_or_preview(spark):
    r = one(spark, G.guide_to_frame(*lits(1, 1, 5, 5, 596, 312, 0, 0)))
    assert tuple(r["mapped"]) == (0, 0, 0, 0) and not r["has_image"] and r["scale"] == 0


def test_region_stays_inside_the_frame(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randint(a, b) for a, b in ((-50, 700), (-50, 400), (0, 700), (0, 400), (1, 900), (1, 700), (1, 2000), (1, 1500))) for _ in range(500)]
    frame = spark.createDataFrame(rows, "gx int, gy int, gw int, gh int, bw int, bh int, iw int, ih int")
    got = frame.select("iw", "ih", G.guide_to_frame(*map(F.col, frame.columns))["mapped"].alias("m"))
    assert got.where("m.x < 0 OR m.y < 0 OR m.w < 0 OR m.h < 0 OR m.x + m.w > iw OR m.y + m.h > ih").count() == 0


@pytest.mark.parametrize("w,h,angle,want", [(200, 100, 10, (10, 200, 100)), (200, 100, 90, (90, 200, 100)), (100, 100, 45, (45, 100, 100)), (100, 200, 10, (100, 200, 100)), (100, 200, 45, (-45, 200, 100)), (100, 200, 80, (-10, 200, 100)), (100, 200, 90, (0, 200, 100)), (100, 200, 0, (90, 100, 200))])
def test_label_angle(spark, w, h, angle, want):
    assert tuple(one(spark, G.label_angle(*[c.cast("float") for c in lits(angle, w, h)]))) == want


@pytest.mark.parametrize("label,qr,flip", [(10, 12, False), (-10, 170, True), (0, 180, True), (10, 100, False), (10, -80.5, True), (100, -170, False), (45, -136, True)])
def test_flip(spark, label, qr, flip):
    assert one(spark, G.needs_flip(F.lit(label).cast("float"), F.lit(qr).cast("float"))) is flip


def test_wrap_is_half_open(spark):
    assert [one(spark, G.wrapped(F.lit(v))) for v in (-180.0, 180.0, 540.0, -190.0, 0.0)] == [180.0, 180.0, 180.0, 170.0, 0.0]


@pytest.mark.parametrize("w,h,want", [(200, 100, (0, 60, 160, 40)), (101, 57, (0, 34, 80, 22)), (7, 7, (0, 4, 5, 2)), (2, 3, (0, 1, 1, 1)), (1, 1, (0, 0, 0, 0))])
def test_reading_part(spark, w, h, want):
    assert tuple(one(spark, G.ocr_crop(*lits(w, h)))) == want


def test_rounding_goes_to_even(spark):
    assert [one(spark, G.rounded(F.lit(v))) for v in (0.5, 1.5, 2.5, -0.5, -1.5)] == [0, 2, 2, 0, -2]


def test_two_half_turns_are_none(spark):
    points = F.array(F.struct(F.lit(3.0).cast("float").alias("x"), F.lit(4.5).cast("float").alias("y")))
    again = G.flipped(G.flipped(points, F.lit(20), F.lit(10)), F.lit(20), F.lit(10))
    assert [tuple(p) for p in one(spark, again)] == [(3.0, 4.5)]


def test_turning_about_the_centre_keeps_it(spark):
    points = F.array(F.struct(F.lit(7.0).alias("x"), F.lit(9.0).alias("y")))
    turned = G.transformed(points, G.rotation(F.lit(7), F.lit(9), F.lit(33.0)), F.lit(2), F.lit(3))
    assert [tuple(p) for p in one(spark, turned)] == [pytest.approx((5.0, 6.0))]


def test_guide_box_edges(spark):
    box = F.struct(F.lit(100).alias("x"), F.lit(50).alias("y"), F.lit(200).alias("w"), F.lit(100).alias("h"))
    hits = [one(spark, G.hit_edge(box, *lits(*p))) for p in ((102, 97), (295, 100), (200, 55), (200, 145), (150, 80))]
    assert hits == ["L", "R", "T", "B", None]
    assert tuple(one(spark, G.drag_box(box, F.lit("L"), *lits(-150, 0, 596, 312)))) == (0, 50, 350, 100)
    assert tuple(one(spark, G.drag_box(box, F.lit(None).cast("string"), *lits(400, 0, 596, 312)))) == (500, 50, 96, 100)
    assert tuple(one(spark, G.default_guide_box(*lits(596, 312)))) == (149, 78, 298, 156)
