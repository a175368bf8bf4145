"""From frames to readings: upright labels at any angle, geometry as in the Columns, odd frames, batch and stream."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagstream.functions import geometry as G
from tagstream.operators import imaging, labels, master, outcome
from tagstream.operators.reader import Replay
from tagstream.plans import catalogue, readings, streams  # noqa: F401
from tagstream.streaming import state

PATTERN = np.clip(190 + np.arange(61)[None, :] * 0.6 + np.arange(31)[:, None] * 0.9, 0, 255)  # brighter to the right and downwards


def scene(degrees: float, cx: float = 60.0, cy: float = 58.0) -> np.ndarray:
    """The pattern on a dark frame, its own right turned by ``degrees`` (clockwise on the screen)."""
    out = np.full((120, 120, 3), 15.0)
    a = np.radians(degrees)
    ys, xs = np.mgrid[0:120, 0:120]
    u = np.rint(np.cos(a) * (xs - cx) + np.sin(a) * (ys - cy) + 30).astype(int)
    v = np.rint(-np.sin(a) * (xs - cx) + np.cos(a) * (ys - cy) + 15).astype(int)
    on = (u >= 0) & (u <= 60) & (v >= 0) & (v <= 30)
    out[on] = PATTERN[v[on], u[on]][:, None]
    return out.astype(np.uint8)


@pytest.mark.parametrize("degrees", [0, 10, 30, 44, 60, 89, 90, 100, 120, 135, 150, 180, 200, 210, 270, 300, 330, 350])
def test_labels_come_out_upright(degrees):
    image = scene(degrees)
    found = imaging.detect(image, 100)
    a = np.radians(degrees)
    corners = np.array([(-28, -13), (-20, -13), (-20, -5), (-28, -5)]) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + (60, 58)
    label, box = labels.align(image, found[0], corners)
    assert abs(label.shape[0] - 30) <= 3 and abs(label.shape[1] - 60) <= 3
    rows, columns = label.shape[:2]
    want = PATTERN[15 - rows // 2 :, 30 - columns // 2 :][:rows, :columns]
    inner = np.s_[rows // 2 : -5, columns // 3 : -5]  # away from the border and the drawn code
    assert np.abs(label[..., 0].astype(float)[: want.shape[0], : want.shape[1]][inner] - want[inner]).mean() < 3
    assert np.abs(box - [(2, 2), (10, 2), (10, 10), (2, 10)]).max() <= 3


def test_rotation_turns_the_way_of_the_affine_points(spark):
    """A bright dot lands where the Columns say it does."""
    rows = [(i, 30.0 + i, 28.0, float(d), 41.0, 17.0 + i) for i, d in enumerate([30, 90, -45, 180, 10])]
    frame = spark.createDataFrame(rows, "i int, cx float, cy float, d float, x float, y float")
    point = F.array(F.struct("x", "y"))
    for r in frame.select("*", G.transformed(point, G.rotation(F.col("cx"), F.col("cy"), F.col("d")), F.lit(0), F.lit(0))[0].alias("to")).collect():
        image = np.zeros((60, 70, 3), np.uint8)
        image[int(r["y"]) - 1 : int(r["y"]) + 2, int(r["x"]) - 1 : int(r["x"]) + 2] = 255
        turned = imaging.rotate(image, r["cx"], r["cy"], r["d"])[..., 0].astype(float)
        ys, xs = np.mgrid[0:60, 0:70]
        assert ((turned * xs).sum() / turned.sum(), (turned * ys).sum() / turned.sum()) == pytest.approx((r["to"]["x"], r["to"]["y"]), abs=0.3)
        part = imaging.rotate(image, r["cx"], r["cy"], r["d"], (5, 7, 20, 30))
        assert (part == imaging.rotate(image, r["cx"], r["cy"], r["d"])[7:37, 5:25]).all()


def test_alignment_has_the_geometry_of_the_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *[float(v) for v in (rng.uniform(20, 90), rng.uniform(20, 70), rng.uniform(3, 60), rng.uniform(3, 60), rng.uniform(0.5, 90))], *[float(v) for v in rng.uniform(0, 90, 4)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "i int, cx float, cy float, w float, h float, angle float, x0 float, y0 float, x1 float, y1 float")
    points = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    made = frame.withColumn("l", G.label_angle(F.col("angle"), F.col("w"), F.col("h"))).withColumn("p", points)
    made = made.withColumn("v", G.crop_window(F.col("cx"), F.col("cy"), F.col("l.w"), F.col("l.h"), F.lit(120), F.lit(100)))
    moved = G.transformed(F.col("p"), G.rotation(F.col("cx"), F.col("cy"), F.col("l.angle")), F.col("v.x"), F.col("v.y"))
    made = made.withColumn("q", F.when(G.needs_flip(F.col("l.angle"), G.qr_angle(F.col("p"))), G.flipped(moved, F.col("v.w"), F.col("v.h"))).otherwise(moved))
    for r in made.select("*", G.clamped(F.col("q"), F.col("v.w"), F.col("v.h")).alias("box")).collect():
        label, box = labels.align(np.zeros((100, 120, 3), np.uint8), imaging.Rotated(*(r[c] for c in ("cx", "cy", "w", "h", "angle"))), np.array([(r["x0"], r["y0"]), (r["x1"], r["y1"])]))
        assert label.shape[:2] == (r["v"]["h"], r["v"]["w"])
        assert np.abs(box - [(b["x"], b["y"]) for b in r["box"]]).max() <= 1  # a half may round either way


IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def test_odd_frames_are_outcomes(spark):
    """No channels, too many, too few bytes, no pixels: each frame has an outcome, and none fails the job."""
    good = readings.drawn(7)
    pixels = good.tobytes()
    rows = [(1, (None, 48, 64, good.shape[2], 0, bytearray(pixels))), (2, None), (3, (None, 0, 64, 3, 0, bytearray())), (4, (None, 48, 64, 3, 0, bytearray(pixels[:100]))), (5, (None, 48, 64, 0, 0, bytearray(pixels))), (6, (None, 48, 64, 3, 0, None)), (8, (None, 1, 1, 3, 0, bytearray(3)))]
    entries = spark.createDataFrame([("model", "brand#8"), ("size", "8"), ("color", "smallbolt")], "kind string, value string")
    out = readings.readings(spark.createDataFrame(rows, f"frame_id long, {IMAGE}"), entries).collect()
    got = {r["frame_id"]: r["outcome"] for r in out}
    assert got == {1: "SUCCESS", 2: "NO_FRAME", 3: "NO_FRAME", 4: "ERROR", 5: "ERROR", 6: "NO_FRAME", 8: "NO_ROI"}
    one = next(r for r in out if r["frame_id"] == 1)
    assert one["fps"] > 0 and one["detect_ms"] >= 0 and one["result"].startswith('QR: "Q7"') and next(r for r in out if r["frame_id"] == 4)["fps"] is None
    assert imaging.detect_frames(spark.createDataFrame([(r[0], r[1][1], r[1][2], r[1][3], r[1][5]) for r in rows if r[1]], "frame_id long, height int, width int, nChannels int, data binary"), 180).count() == 1


class _Failing(readings.Drawn):
    def read_text(self, image):
        raise RuntimeError("no engine")


def test_a_failing_reader_is_no_match(spark):
    frames = spark.createDataFrame([(7, (None, 48, 64, 3, 0, bytearray(readings.drawn(7).tobytes())))], f"frame_id long, {IMAGE}")
    entries = spark.createDataFrame([], "kind string, value string")
    out = labels.read_frames(frames, entries, "failing", _Failing, F.struct(F.lit(4).alias("x"), F.lit(4).alias("y"), F.lit(56).alias("w"), F.lit(40).alias("h")), (64, 48)).collect()[0]
    assert (out["outcome"], out["ran"], out["min_score"], out["blocks"]) == ("NO_MATCH", False, -999, [])


def test_replay_answers_through_the_pipeline(spark):
    """``Replay`` knows images by their bytes: the code of the label's part, and the text of the upright label's."""
    image = readings.drawn(7)
    region = image[4:44, 4:60]
    rect, (x, y, w, h) = imaging.detect(region)
    code = ("any code", np.array([(0, 0), (5, 0), (5, 5), (0, 5)], np.float32))
    upright, _ = labels.align(region, rect, code[1] + np.float32([x, y]))
    known = {imaging.crop(region, x, y, w, h).tobytes(): (code, []), labels.read_part(upright).tobytes(): (None, [("A1", 0.5), ("XL", 0.75), ("Red", 1.0)])}
    frames = spark.createDataFrame([(7, (None, 48, 64, 3, 0, bytearray(image.tobytes())))], f"frame_id long, {IMAGE}")
    entries = spark.createDataFrame([("model", "a1"), ("size", "xl"), ("color", "red")], "kind string, value string")
    out = labels.read_frames(frames, entries, "replayed", lambda: Replay(known), F.struct(F.lit(4).alias("x"), F.lit(4).alias("y"), F.lit(56).alias("w"), F.lit(40).alias("h")), (64, 48)).collect()[0]
    assert (out["outcome"], out["qr_text"], out["ma_ao"], out["size"], out["color"], out["min_score"]) == ("SUCCESS", "any code", "A1", "XL", "Red", 0.5)


def test_frames_to_display_as_a_stream(spark, sf_dir, tmp_path):
    """The same readings from a stream of frames as in batch, on to the display's state and the pause."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    entries = master.dictionary(master_sheet(read))
    frames = readings.camera_frames(read).withColumn("camera_id", F.col("frame_id") % 3).withColumn("ts", F.timestamp_seconds(F.col("frame_id"))).repartition(4)
    frames.write.parquet(str(tmp_path / "frames"))
    stored = spark.read.parquet(str(tmp_path / "frames"))
    batch = readings.readings(stored, entries).select(*state.COLUMNS)

    def streamed(operator, name):
        arriving = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "frames"))
        seen = readings.readings(arriving, entries).select(*state.COLUMNS)
        query = operator(seen).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return {tuple(r) for r in spark.table(name).collect()}

    assert streamed(lambda f: f, "labels_seen") == {tuple(r) for r in batch.collect()}
    assert streamed(state.sticky, "labels_shown") == {tuple(r) for r in outcome.sticky(batch, "camera_id", ["ts", "frame_id"]).select(*state.COLUMNS, "detected").collect()}
    assert streamed(lambda f: state.paused(f, 60), "labels_paused") == {tuple(r) for r in outcome.paused(batch, "camera_id", ["ts", "frame_id"], 60).select(*state.COLUMNS).collect()}


def master_sheet(read):
    from tagstream.plans.catalogue import sheet

    return sheet(read)


def test_blobs_against_tracing():
    """Areas by cells and components by runs, against each blob's traced border, on random pictures."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        binary = (rng.random(rng.integers(1, 14, 2)) < rng.choice([0.3, 0.5, 0.7, 0.85])).astype(np.uint8) * 255
        blobs = imaging.regions(binary)
        areas = [(imaging.polygon_area(imaging.outline(b)), -i) for i, b in enumerate(blobs)]
        best = max(areas, default=(0, 0))
        found = imaging.Blobs(np.stack([binary, binary]))
        for runs in found.largest():
            assert (runs is None) == (best[0] == 0)
            if runs is not None:
                assert found.area[found.runs.label[runs[0]]] == best[0]
                assert found.bound(runs)[:2] == tuple(blobs[-best[1]].min(axis=0))


#: Around the first key of six digits, as of a table sixty times the largest one here, and far beyond.
KEYS = [*range(99_950, 100_100), *range(899_950, 900_000), *range(2**31 - 9, 2**31 + 9), *range(10**12, 10**12 + 30)]


@pytest.fixture(scope="module")
def long_keys(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long_keys"))
    spark.createDataFrame([(k,) for k in KEYS], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    spark.read.parquet(f"{sf_dir}/part.parquet").write.parquet(f"{folder}/part.parquet")
    return folder


def as_sql_says(spark, folder, name):
    duck = duckdb.connect()
    for table in ("customer", "part"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, folder)
    want = duck.sql(catalogue.SQL[name])
    by = lambda rows: sorted(map(tuple, rows), key=str)
    assert sorted(got.columns) == sorted(want.columns)
    assert by(got.select(*want.columns).collect()) == by(want.fetchall())


@pytest.mark.parametrize("key", [0, 7, 99_999, 100_000, 899_999, 2**31, 10**15 + 3, 2**63 - 1])
def test_a_label_holds_every_key(key):
    key += next(i for i in range(99) if (key + i) % 19 and (key + i) % 11) if key < 2**62 else 0
    x, y, w, h = (a + b for a, b in zip(readings.label_of(key), (readings.MARGIN + 1, readings.MARGIN + 1, -3, -3)))
    label = imaging.to_bgr(readings.drawn(key))[y : y + h, x : x + w]
    assert readings.number(label[0, :, 2]) == key
    upright = label[::-1, ::-1] if readings.on_its_head(key) else label
    assert readings.Drawn().read_text(labels.read_part(upright))[0] == (f" Brand#{key % 30 + 1}", 1.0)


def test_label_detection_of_long_keys(spark, long_keys):
    as_sql_says(spark, long_keys, "label_detection")


def test_frames_are_drawn_and_sent_in_small_batches(spark, long_keys):
    """Ten thousand keys are one batch, their frames would be 120 MB."""
    parts = list(readings.shots(iter([pd.DataFrame({"frame_id": range(10_000)})])))
    assert [k for part in parts for k in part["frame_id"]] == list(range(10_000))
    assert max(sum(len(image["data"]) for image in part["image"].dropna()) for part in parts) <= labels.BATCH_BYTES
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    catalogue.QUERIES["label_detection"](spark, long_keys)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == labels.BATCH_BYTES


def test_label_reading_of_long_keys(spark, long_keys):
    as_sql_says(spark, long_keys, "label_reading")


def test_stream_of_long_keys(spark, long_keys):
    as_sql_says(spark, long_keys, "stream_label_reading")


def test_label_reading_compiles(spark, sf_dir):
    """Spark's code for it is within the JVM's 64 KB a method: without Spark's way back, more is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert catalogue.QUERIES["label_reading"](spark, sf_dir).count() > 0
        catalogue.QUERIES["label_reading"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_tasks_of_frames_are_bounded(spark, tmp_path):
    spark.range(5 * readings.A_TASK).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    frames = readings.camera_frames(lambda table: spark.read.parquet(f"{tmp_path}/{table}.parquet"))
    assert frames.rdd.getNumPartitions() == 5


def test_hull_of_few_and_of_collinear_points():
    for points, want in ([[(3, 1), (3, 2), (3, 5)], [(3, 1), (3, 5)]], [[(1, 1), (2, 2), (3, 3)], [(1, 1), (3, 3)]], [[(4, 4)] * 3, [(4, 4)]], [[(0, 0), (0, 1), (0, 2), (1, 1), (2, 0), (2, 2)], [(0, 0), (2, 0), (2, 2), (0, 2)]]):
        assert imaging.hull(np.array(points)).tolist() == [list(p) for p in want]
