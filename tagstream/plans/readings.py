"""The label pipeline from pixels to accepted readings, over frames drawn from keys.

Every customer is a frame of 64 x 48 pixels, in one, three or four channels, with a bright label
whose place and size come from the key, or dark, broken, missing, or outside of the guide box.
``Drawn`` is the reader: it finds the key in the red values of a few pixels, where the code and the
text would be, and says what a decoder and a recogniser would say of that label.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels, master
from ..operators.reader import Block
from .catalogue import ENTRIES, dealt, query, sheet

WIDTH, HEIGHT, MARGIN = 64, 48, 4
ZERO = 240  # the red value of digit 0
TOGETHER = 256  # frames in a batch, 3 MB at most
A_TASK = 8192  # frames in a task
LOOKS, THINGS = ("small", "hot", "red", "blue", "large", "cold", "green"), ("ring", "widget", "bolt", "gear", "gizmo")


def label_of(key: int) -> tuple[int, int, int, int]:
    """Left, top, width and height of the drawn label in the region."""
    return 2 + key % 5, 2 + key % 4, 36 + key % 7, 24 + key % 5


def on_its_head(key: int) -> bool:
    return key % 3 == 0


def drawn(key: int) -> np.ndarray:
    """The frame of a key."""
    channels = {0: 4, 1: 1}.get(key % 5, 3)
    image = np.full((HEIGHT, WIDTH, channels), 20, np.uint8)
    if key % 11 == 0:
        return image
    red = 2 if channels > 1 else 0
    x, y, w, h = label_of(key)
    label = image[y + MARGIN : y + MARGIN + h, x + MARGIN : x + MARGIN + w]
    label[:] = 250
    digits = [ZERO + int(d) for d in f"{key:05d}"]  # five at least; the 19 of the largest key have room in the narrowest label
    seen = label[1 : h - 2, 1 : w - 2]  # what the detector takes for the label, after the blur
    if key % 19:
        seen[0, : len(digits), red] = digits
    upright = seen[::-1, ::-1] if on_its_head(key) else seen
    upright[int((h - 3) * 0.6), : len(digits), red] = digits
    return image


def number(pixels: np.ndarray) -> int | None:
    """The key whose digits stand at the beginning, up to the first pixel that is none; None without five."""
    digits = list(takewhile(lambda d: 0 <= d <= 9, (int(p) - ZERO for p in pixels)))
    return int("".join(map(str, digits))) if len(digits) >= 5 else None


class Drawn:
    """The reader of the drawn frames."""

    def decode_qr(self, image: np.ndarray) -> tuple[str, np.ndarray] | None:
        key = number(image[0, :, 2])
        if key is None:
            return None
        corners = np.array([(0, 0), (5, 0), (5, 5), (0, 5)], np.float32)
        return f"Q{key}", corners[:1] if key % 23 == 0 else corners[[2, 3, 0, 1]] if on_its_head(key) else corners

    def read_text(self, image: np.ndarray) -> list[Block]:
        key = number(image[0, :, 2])
        if key is None:
            return []
        look, thing, sure = LOOKS[key % 7], THINGS[key % 5], 1 - key % 3 / 4
        name = [(look + thing, sure)] if key % 4 == 0 else [(look, 1.0), (" ", 1.0), (thing.upper(), sure)]
        return [(f" Brand#{key % 30 + 1}", 1.0), (str(key % 55 + 1), 1.0), *name]


def shots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of keys, ``TOGETHER`` at a time: a part of keys is small, its frames are not."""
    for part in parts:
        for at in range(0, len(part), TOGETHER):
            rows = []
            for key in part["frame_id"].iloc[at : at + TOGETHER]:
                image = drawn(key)
                data = image.tobytes()
                rows.append((key, None if key % 29 == 0 else {"origin": str(key), "height": HEIGHT, "width": WIDTH, "nChannels": image.shape[2], "mode": 0, "data": data[:-1] if key % 17 == 0 else data}))
            yield pd.DataFrame(rows, columns=["frame_id", "image"])


def camera_frames(read) -> DataFrame:
    """(frame_id, image) of every customer, as Spark's image source gives them."""
    image = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return dealt(read("customer").select(F.col("c_custkey").alias("frame_id")), A_TASK).mapInPandas(shots, f"frame_id long, {image}")


def readings(frames: DataFrame, entries: DataFrame) -> DataFrame:
    """What becomes of the drawn frames; each thirteenth has its guide box off the frame."""
    box = F.struct(F.when(F.col("frame_id") % 13 == 0, WIDTH).otherwise(MARGIN).alias("x"), F.lit(MARGIN).alias("y"), F.lit(WIDTH - 2 * MARGIN).alias("w"), F.lit(HEIGHT - 2 * MARGIN).alias("h"))
    return labels.read_frames(frames, entries, "drawn", Drawn, box, (WIDTH, HEIGHT))


_PICK = lambda words, n: "[" + ", ".join(f"'{w}'" for w in words) + f"][k % {n} + 1]"
FRAME_SQL = f"""{ENTRIES}, f AS (SELECT c_custkey AS k, 2 + k % 5 + 1 + {MARGIN} AS x, 2 + k % 4 + 1 + {MARGIN} AS y, 36 + k % 7 - 3 AS w, 24 + k % 5 - 3 AS h,
    'Brand#' || (k % 30 + 1) AS a, (k % 55 + 1)::VARCHAR AS b, {_PICK(LOOKS, 7)} || CASE k % 4 WHEN 0 THEN {_PICK(THINGS, 5)} ELSE upper({_PICK(THINGS, 5)}) END AS c FROM customer),
  g AS (SELECT *, k % 29 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 11 <> 0 AND k % 19 <> 0 AS found FROM f),
  r AS (SELECT *, found AND k % 23 <> 0 AS up FROM g),
  m AS (SELECT *, CASE WHEN up AND lower(a) IN (SELECT value FROM entries WHERE kind = 'model') THEN a ELSE '' END AS ma_ao,
    CASE WHEN up AND lower(b) IN (SELECT value FROM entries WHERE kind = 'size') THEN b ELSE '' END AS size,
    CASE WHEN up AND lower(c) IN (SELECT value FROM entries WHERE kind = 'color') THEN c ELSE '' END AS color FROM r),
  o AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'NO_FRAME' WHEN k % 13 = 0 THEN 'NO_ROI' WHEN k % 17 = 0 THEN 'ERROR' WHEN NOT found THEN 'NO_LABEL'
    WHEN NOT up THEN 'ALIGN_FAIL' WHEN ma_ao = '' OR size = '' OR color = '' THEN 'NO_MATCH' ELSE 'SUCCESS' END AS outcome FROM m)"""


@query("label_reading", f"""WITH {FRAME_SQL} SELECT k AS frame_id, outcome, CASE WHEN found THEN 'Q' || k END AS qr_text, ma_ao, size, color,
    (CASE WHEN up THEN 1 - (k % 3) / 4 ELSE -999 END)::FLOAT AS min_score, CASE outcome WHEN 'SUCCESS' THEN printf('Accuracy: %.2f%%', 100 * (1 - (k % 3) / 4)) END AS accuracy,
    CASE outcome WHEN 'SUCCESS' THEN 'QR: "Q' || k || '"' || chr(13) || chr(10) || 'Mã áo: "' || ma_ao || '"' || chr(13) || chr(10) || 'Size áo: "' || size || '"' || chr(13) || chr(10) || 'Màu áo: "' || color || '"' END AS result FROM o""")
def _(read):
    out = readings(camera_frames(read), master.dictionary(sheet(read)))
    return out.select("frame_id", "outcome", "qr_text", "ma_ao", "size", "color", "min_score", "accuracy", "result")


@query("label_detection", f"""WITH {FRAME_SQL} SELECT k AS frame_id, x::INT AS x0, y::INT AS y0, (x + w)::INT AS x2, (y + h)::INT AS y2, (x - {MARGIN} + w / 2)::FLOAT AS cx, (y - {MARGIN} + h / 2)::FLOAT AS cy,
    90::FLOAT AS angle, CASE WHEN up THEN w::INT END AS label_w, CASE WHEN up THEN h::INT END AS label_h FROM o WHERE found""")
def _(read):
    out = readings(camera_frames(read), master.dictionary(sheet(read))).where("has_label")
    corner = lambda k, c: F.col("box")[k][c]
    return out.select("frame_id", corner(0, "x").alias("x0"), corner(0, "y").alias("y0"), corner(2, "x").alias("x2"), corner(2, "y").alias("y2"), "rect.cx", "rect.cy", "rect.angle", F.col("label.width").alias("label_w"), F.col("label.height").alias("label_h"))
