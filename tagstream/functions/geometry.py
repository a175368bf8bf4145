"""Rectangles, angles and affine points as Columns.

Where the screen geometry is in single precision, every step is cast back to
float: Spark's division of floats gives doubles, and one missed cast changes what
truncation gives.  Casts from float to int truncate towards zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f(c: Column) -> Column:
    return c.cast("float")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, the value worked out once; a Column is spelled out wherever it is named, and steps on steps double at each."""
    return F.transform(F.array(value), of)[0]


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def default_guide_box(width: Column, height: Column) -> Column:
    """A quarter in from the top left, half as large; integer division."""
    part = lambda c, n: (c.cast("int") - c.cast("int") % n) / n
    return rect(part(width, 4), part(height, 4), part(width, 2), part(height, 2))


def intersect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The part of a rectangle inside (0, 0, width, height); all zero if none."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    right, bottom = F.least(x + w, width), F.least(y + h, height)
    none = rect(*[F.lit(0)] * 4)
    return F.when((right >= left) & (bottom >= top), rect(left, top, right - left, bottom - top)).otherwise(none)


def guide_to_frame(gx: Column, gy: Column, gw: Column, gh: Column, box_w: Column, box_h: Column, img_w: Column, img_h: Column) -> Column:
    """Region of the frame under a guide box on a preview that shows the frame scaled to fit, bars at its sides.

    (mapped, scale, offset_x, offset_y, has_image).  Left and top are clamped without shrinking the box.
    A frame or preview without area gives zeros and no image.
    """
    ok = (img_w > 0) & (img_h > 0) & (box_w > 0) & (box_h > 0)
    half = F.lit(2.0).cast("float")
    zero = F.lit(0).cast("float")
    offset = lambda b, i, scale: _f(_f(b - _f(i * scale)) / half)
    start = lambda g, o, scale: F.greatest(zero, _f(_f(_f(g) - o) / scale))
    extent = lambda i, at, g, scale: F.least(_f(i - at), _f(_f(g) / scale)).cast("int")

    def full(m: Column, scale: Column, o: Column) -> Column:
        return F.struct(m.alias("mapped"), scale.alias("scale"), o["x"].alias("offset_x"), o["y"].alias("offset_y"), ((m["w"] > 0) & (m["h"] > 0)).alias("has_image"))

    def within(s: Column, scale: Column, o: Column) -> Column:
        corner = F.struct(start(gx, o["x"], scale).alias("x"), start(gy, o["y"], scale).alias("y"))
        box = lambda at: F.struct(at["x"].cast("int").alias("x"), at["y"].cast("int").alias("y"), extent(s["iw"], at["x"], gw, scale).alias("w"), extent(s["ih"], at["y"], gh, scale).alias("h"))
        mapped = lambda r: intersect(r["x"], r["y"], r["w"], r["h"], img_w.cast("int"), img_h.cast("int"))
        return once(corner, lambda at: once(box(at), lambda r: once(mapped(r), lambda m: full(m, scale, o))))

    def scaled(s: Column) -> Column:
        offsets = lambda scale: F.struct(offset(s["bw"], s["iw"], scale).alias("x"), offset(s["bh"], s["ih"], scale).alias("y"))
        return once(F.least(_f(s["bw"] / s["iw"]), _f(s["bh"] / s["ih"])), lambda scale: once(offsets(scale), lambda o: within(s, scale, o)))

    sizes = F.struct(*[_f(F.when(ok, c).otherwise(F.lit(1))).alias(n) for n, c in (("iw", img_w), ("ih", img_h), ("bw", box_w), ("bh", box_h))])
    empty = F.struct(rect(*[F.lit(0)] * 4).alias("mapped"), zero.alias("scale"), zero.alias("offset_x"), zero.alias("offset_y"), F.lit(False).alias("has_image"))
    return F.when(ok, once(sizes, scaled)).otherwise(empty)


def moved(points: Column, dx: Column, dy: Column) -> Column:
    """Points (x, y) with an offset added."""
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def label_angle(angle: Column, width: Column, height: Column) -> Column:
    """(angle, w, h): the angle brought to -45 .. 135, sides swapped where it turns.

    135 itself is turned back by 180 (and swapped); from above 90 on sides are swapped.
    """
    a = _f(F.when(width < height, angle + 90).otherwise(angle))
    back = (a >= 135) & (a <= 180)
    swap = back | ((a > 90) & (a <= 135))
    w, h = width.cast("int"), height.cast("int")
    return F.struct(F.when(back, _f(a - 180)).otherwise(a).alias("angle"), F.when(swap, h).otherwise(w).alias("w"), F.when(swap, w).otherwise(h).alias("h"))


def qr_angle(points: Column) -> Column:
    """Direction of the code's upper edge in degrees."""
    d = lambda k: (points[1][k].cast("float") - points[0][k].cast("float")).cast("double")
    return _f(F.atan2(d("y"), d("x")) * F.lit(180.0 / 3.141592653589793))


def wrapped(angle: Column) -> Column:
    """An angle difference in (-180, 180]: -180 becomes 180."""
    turned = F.pmod(angle.cast("double"), F.lit(360.0))
    return _f(F.when(turned > 180, turned - 360).otherwise(turned))


def needs_flip(label: Column, qr: Column) -> Column:
    """Whether label and code point apart by more than 90 degrees."""
    return F.abs(wrapped(_f(label - qr))) > 90


def rotation(cx: Column, cy: Column, degrees: Column) -> Column:
    """The six coefficients that turn about a centre, scale 1: X = a x + b y + tx, Y = -b x + a y + ty."""
    a, b = F.cos(F.radians(degrees.cast("double"))), F.sin(F.radians(degrees.cast("double")))
    x, y = cx.cast("double"), cy.cast("double")
    return F.struct(a.alias("a"), b.alias("b"), ((1 - a) * x - b * y).alias("tx"), (b * x + (1 - a) * y).alias("ty"))


def crop_window(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The label's window about its centre, its corner clamped into the image, its sides cut at the border."""
    two = F.lit(2.0).cast("float")
    corner = lambda c, s, most: F.greatest(F.lit(0), F.least(_f(_f(c) - _f(_f(s) / two)).cast("int"), most.cast("int") - 1))
    x, y = corner(cx, w, width), corner(cy, h, height)
    return rect(x, y, F.least(w.cast("int"), width.cast("int") - x), F.least(h.cast("int"), height.cast("int") - y))


def transformed(points: Column, turn: Column, x: Column, y: Column) -> Column:
    """Points turned, then moved so that (x, y) is the origin; in double, stored as float."""
    return F.transform(
        points,
        lambda p: F.struct(
            _f(turn["a"] * p["x"].cast("double") + turn["b"] * p["y"].cast("double") + (turn["tx"] - x)).alias("x"),
            _f(-turn["b"] * p["x"].cast("double") + turn["a"] * p["y"].cast("double") + (turn["ty"] - y)).alias("y"),
        ),
    )


def flipped(points: Column, w: Column, h: Column) -> Column:
    """Points after a half turn of a w x h image."""
    return F.transform(points, lambda p: F.struct(_f(_f(w) - p["x"]).alias("x"), _f(_f(h) - p["y"]).alias("y")))


def rounded(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(c.cast("double")).cast("int")


def clamped(points: Column, w: Column, h: Column) -> Column:
    """Points rounded and brought into a w x h image."""
    into = lambda c, most: F.greatest(F.lit(0), F.least(rounded(c), most.cast("int") - 1))
    return F.transform(points, lambda p: F.struct(into(p["x"], w).alias("x"), into(p["y"], h).alias("y")))


def bound(points: Column, width: Column, height: Column) -> Column:
    """The upright rectangle of integer points, cut at the image's border."""
    x, y = (F.array_min(points[k]) for k in ("x", "y"))
    w, h = (F.array_max(points[k]) - F.array_min(points[k]) + 1 for k in ("x", "y"))
    left, top = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    return rect(left, top, F.least(width - left, w), F.least(height - top, h))


def ocr_crop(w: Column, h: Column) -> Column:
    """The part of an upright label that is read: from 0.6 of its height, 0.8 wide, 0.4 high, each truncated by itself."""
    part = lambda c, share: (c.cast("double") * F.lit(share)).cast("int")
    return intersect(F.lit(0), part(h, 0.6), part(w, 0.8), part(h, 0.4), w.cast("int"), h.cast("int"))


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A dragged guide box: left and top to 0 without shrinking, right and bottom cut."""
    x, y = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    return rect(x, y, F.when(x + w > width, width - x).otherwise(w), F.when(y + h > height, height - y).otherwise(h))


def drag_box(box: Column, edge: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A guide box after a mouse drag at an edge (L, R, T, B) or, with null, of the whole box."""
    x = box["x"] + F.when((edge == "L") | edge.isNull(), dx).otherwise(F.lit(0))
    y = box["y"] + F.when((edge == "T") | edge.isNull(), dy).otherwise(F.lit(0))
    w = box["w"] + F.when(edge == "L", -dx).when(edge == "R", dx).otherwise(F.lit(0))
    h = box["h"] + F.when(edge == "T", -dy).when(edge == "B", dy).otherwise(F.lit(0))
    return clamp_box(x, y, w, h, width, height)


def hit_edge(box: Column, px: Column, py: Column, handle: int = 10) -> Column:
    """The first of the edge handles L, R, T, B that holds a point; null if none."""
    half = lambda c: (c - c % 2) / 2
    mid_x, mid_y = box["x"] + half(box["w"]) - handle // 2, box["y"] + half(box["h"]) - handle // 2
    holds = lambda x, y: (px >= x) & (px < x + handle) & (py >= y) & (py < y + handle)
    return (
        F.when(holds(box["x"], mid_y), "L").when(holds(box["x"] + box["w"] - handle, mid_y), "R").when(holds(mid_x, box["y"]), "T").when(holds(mid_x, box["y"] + box["h"] - handle), "B")
    )
