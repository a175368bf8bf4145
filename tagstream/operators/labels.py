"""From frames to readings: region under the guide box, label, code, upright label, text, match, outcome.

Geometry of the region, tokens, match and outcome are Columns and joins; everything that
needs pixels is one Arrow step, so pixels go to Python once and do not come back.  In it a
frame leaves at the first thing it lacks (label, code, upright label, region to read),
before the dearer steps behind that.  Frames without a region are not even sent: their
pixels are replaced by null.  A frame that fails is an outcome, never a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions import text
from . import imaging, match, outcome
from .match import NO_BLOCKS, NOT_RUN
from .reader import LabelReader, engine

PREVIEW = (596, 312)
LEVEL = 180
BATCH_BYTES = 4 << 20


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_YES, _INT, _FLOAT, _MS = T.BooleanType(), T.IntegerType(), T.FloatType(), T.DoubleType()
SEEN = _struct(
    failed=_YES, has_label=_YES, aligned=_YES, ran=_YES, qr_text=T.StringType(), rect=_struct(cx=_FLOAT, cy=_FLOAT, w=_FLOAT, h=_FLOAT, angle=_FLOAT),
    box=T.ArrayType(_struct(x=_INT, y=_INT)), label=_struct(height=_INT, width=_INT), min_score=_FLOAT, blocks=T.ArrayType(_struct(text=T.StringType(), score=_FLOAT)), detect_ms=_MS, align_ms=_MS, read_ms=_MS,
)


def align(region: np.ndarray, r: imaging.Rotated, code: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The label turned upright and cut out, with the code's outline drawn on it, and the outline's points; None for a label without area.

    ``code``: the code's corners in the region; the first two are its upper edge, which tells whether the label stands on its head.
    Numbers are single precision where the screen's are; ``functions.geometry`` has the same steps as Columns.
    """
    f = np.float32
    w, h, angle = int(f(r.w)), int(f(r.h)), f(r.angle)
    if w <= 0 or h <= 0:
        return None
    if f(r.w) < f(r.h):
        angle = f(angle + 90)
    if 135 <= angle <= 180:
        angle, w, h = f(angle - 180), int(f(r.h)), int(f(r.w))
    elif 90 < angle <= 135:
        w, h = int(f(r.h)), int(f(r.w))
    code = np.asarray(code, f)
    edge = (code[1] - code[0]).astype(np.float64)
    apart = f(angle - f(np.arctan2(edge[1], edge[0]) * (180.0 / np.pi)))
    apart = f(apart % 360)
    on_its_head = abs(f(apart - 360) if apart > 180 else apart) > 90
    height, width = region.shape[:2]
    x = max(0, min(int(f(f(r.cx) - f(w) / f(2))), width - 1))
    y = max(0, min(int(f(f(r.cy) - f(h) / f(2))), height - 1))
    w, h = min(w, width - x), min(h, height - y)
    label = imaging.rotate(region, float(f(r.cx)), float(f(r.cy)), float(angle), (x, y, w, h))
    a, b = np.cos(np.radians(float(angle))), np.sin(np.radians(float(angle)))
    cx, cy, p = float(f(r.cx)), float(f(r.cy)), code.astype(np.float64)
    points = np.stack([a * p[:, 0] + b * p[:, 1] + (1 - a) * cx - b * cy - x, -b * p[:, 0] + a * p[:, 1] + b * cx + (1 - a) * cy - y], axis=1).astype(f)
    if on_its_head:
        label, points = imaging.half_turn(label), np.array([w, h], f) - points
    box = np.clip(np.rint(points.astype(np.float64)), 0, [w - 1, h - 1]).astype(int)
    return imaging.mark(label, box), box


def read_part(label: np.ndarray) -> np.ndarray | None:
    """The lower left part of an upright label; None if there is none."""
    height, width = label.shape[:2]
    y, w, h = int(height * 0.6), int(width * 0.8), int(height * 0.4)
    return imaging.crop(label, 0, y, w, h) if w > 0 and min(h, height - y) > 0 else None


def decoded(reader: LabelReader, part: np.ndarray) -> tuple[str, np.ndarray] | None:
    try:
        got = reader.decode_qr(part)
    except Exception:  # counts as no code
        return None
    return got if got and got[0] else None


def read_one(region: np.ndarray, found: imaging.Found | None, reader: LabelReader, row: dict) -> None:
    """Take one region as far as it goes; ``row`` gets what was seen."""
    began = time.perf_counter()
    if found is None:
        return
    r, (x, y, w, h) = found
    code = decoded(reader, imaging.crop(region, x, y, w, h))
    row["detect_ms"] += 1e3 * (time.perf_counter() - began)
    if code is None:
        return
    row["has_label"], row["qr_text"] = True, code[0]
    row["rect"] = {"cx": r.cx, "cy": r.cy, "w": r.w, "h": r.h, "angle": r.angle}
    row["box"] = [{"x": int(px) + row["_x"], "y": int(py) + row["_y"]} for px, py in np.rint(r.corners())]
    began = time.perf_counter()
    try:
        upright = align(region, r, np.asarray(code[1], np.float32) + np.array([x, y], np.float32))
    except Exception:  # counts as not aligned
        upright = None
    row["align_ms"] = 1e3 * (time.perf_counter() - began)
    if upright is None:
        return
    row["aligned"], row["label"] = True, {"height": upright[0].shape[0], "width": upright[0].shape[1]}
    began = time.perf_counter()
    try:
        if (part := read_part(upright[0])) is not None:
            blocks = reader.read_text(part)
            row["blocks"] = [{"text": t, "score": s} for t, s in blocks]
            row["ran"], row["min_score"] = True, min([NO_BLOCKS, *(s for _, s in blocks if s < NO_BLOCKS)])
    except Exception:  # a reader's failure is a frame without reading
        row["blocks"], row["ran"], row["min_score"] = [], False, NOT_RUN
    row["read_ms"] = 1e3 * (time.perf_counter() - began)


def look(regions: DataFrame, name: str, factory: Callable[[], LabelReader], level: int = LEVEL) -> DataFrame:
    """``regions`` with what is seen in them (``SEEN``) in place of ``image`` and ``region`` (x, y, w, h; null: not looked at).

    Arrow batches are held to ``BATCH_BYTES``, unless the session has a bound of its own; else ten thousand frames are one.
    """
    conf, bound = regions.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))
    keep = [c for c in regions.columns if c not in ("image", "region")]
    pixels = [F.col(f"image.{c}").alias(f"_{c}") for c in ("height", "width", "nChannels")] + [F.when(F.col("region").isNotNull(), F.col("image.data")).alias("_data")]
    sent = regions.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], *pixels, *[F.col(f"region.{c}").alias(f"_{c}") for c in "xywh"])
    fields = T.StructType([*sent.schema.fields[: len(keep)], *SEEN.fields])
    made = to_arrow_schema(SEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = engine(name, factory)
        for batch in batches:
            rows = []
            for height, width, depth, data, x, y, w, h in zip(*(batch.column(len(keep) + k) for k in range(8))):
                began = time.perf_counter()
                row = {"failed": False, "has_label": False, "aligned": False, "ran": False, "min_score": NOT_RUN, "blocks": [], "_x": x.as_py(), "_y": y.as_py(), "_region": None}
                if row["_x"] is not None:
                    try:
                        image = imaging.to_bgr(imaging.image_array(data.as_buffer(), height.as_py(), width.as_py(), depth.as_py()))
                        row["_region"] = imaging.crop(image, row["_x"], row["_y"], w.as_py(), h.as_py())
                    except Exception:  # not the bytes of such a picture
                        row["failed"] = True
                row["detect_ms"] = 1e3 * (time.perf_counter() - began)
                rows.append(row)
            ready = [row for row in rows if row["_region"] is not None]
            began = time.perf_counter()
            found = imaging.detect_each([row["_region"] for row in ready], level)
            each = 1e3 * (time.perf_counter() - began) / max(1, len(ready))
            for row, one in zip(ready, found):
                row["detect_ms"] += each
                try:
                    read_one(row["_region"], one, reader, row)
                except Exception:
                    row["failed"] = True
            arrays = [pa.array([row.get(f.name) for row in rows], f.type) for f in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=fields.names)

    return sent.mapInArrow(run, fields).toDF(*keep, *SEEN.names)


def read_frames(
    frames: DataFrame,
    entries: DataFrame,
    name: str,
    factory: Callable[[], LabelReader],
    guide: Column | None = None,
    preview: tuple[int, int] = PREVIEW,
    level: int = LEVEL,
) -> DataFrame:
    """Frames (any columns and ``image``, as of Spark's image source), in batch or as a stream, with what became of them.

    ``guide``: the guide box (x, y, w, h) on the preview, the default box if none; ``entries``: the master
    dictionary; ``name`` and ``factory``: the reader.  Adds the ``SEEN`` columns, ``region``, ``tokens``, ``ma_ao``,
    ``size``, ``color``, ``outcome`` and, of a success, ``accuracy`` and ``result``; ``fps`` of a success and of a frame
    without label, else null.
    """
    width, height = (F.lit(v) for v in preview)
    box = G.default_guide_box(width, height) if guide is None else guide
    image = F.col("image")
    shot = F.coalesce(image.isNotNull() & image["data"].isNotNull() & (image["width"] > 0) & (image["height"] > 0), F.lit(False))
    roi = G.guide_to_frame(box["x"], box["y"], box["w"], box["h"], width, height, image["width"], image["height"])
    framed = frames.withColumn("has_frame", shot).withColumn("_roi", F.when(shot, roi))
    framed = framed.withColumn("region", F.when(F.col("_roi.has_image"), F.col("_roi.mapped"))).drop("_roi").withColumn("mapped", F.col("region"))
    seen = look(framed, name, factory, level).withColumnRenamed("mapped", "region").withColumn("tokens", match.tokens(F.col("blocks")))
    out = match.match(seen, entries)
    matched = (F.col("ma_ao") != "") & (F.col("size") != "") & (F.col("color") != "")
    out = out.withColumn("outcome", outcome.outcome(F.col("has_frame"), F.col("region").isNotNull(), F.col("failed"), F.col("has_label"), F.col("aligned"), matched))
    won, spent = F.col("outcome") == outcome.SETS, sum((F.coalesce(F.col(f"{k}_ms"), F.lit(0.0)) for k in ("detect", "align", "read")), F.lit(0.0))
    return out.withColumns(
        {
            "accuracy": F.when(won, text.accuracy_text(F.col("min_score"))),
            "result": F.when(won, text.result_text(F.col("qr_text"), F.col("ma_ao"), F.col("size"), F.col("color"))),
            "fps": F.when(won | (F.col("outcome") == outcome.CLEARS), text.fps(F.floor(spent))),
        }
    ).drop("has_frame")
