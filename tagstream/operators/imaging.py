"""Pixel work on BGR images as numpy kernels, run by ``mapInPandas``.

Images are (height, width, 3) ``uint8`` arrays.  Areas, hulls and rectangles agree
with the usual vision libraries on convex and simple blobs; exact equality on
every outline is not claimed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def image_array(data: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    """Pixels of Spark's image struct."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def to_bgr(image: np.ndarray) -> np.ndarray:
    """Gray images three times over; of more than three channels the first three."""
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return image[y : y + h, x : x + w]


def gray(image: np.ndarray) -> np.ndarray:
    """Weights 0.114 B, 0.587 G, 0.299 R, to the nearest integer, halves to even; of one image or of a stack."""
    b, g, r = (image[..., k].astype(np.int32) for k in range(3))
    whole, rest = np.divmod(114 * b + 587 * g + 299 * r, 1000)
    return (whole + ((rest > 500) | (rest == 500) & (whole & 1 == 1))).astype(np.uint8)


def blur(image: np.ndarray) -> np.ndarray:
    """Gaussian of 5 x 5: 1 4 6 4 1 over 16 each way, border mirrored without its own pixel; of one image or of a stack."""
    height, width = image.shape[-2:]
    mode = "edge" if min(height, width) < 3 else "reflect"
    padded = np.pad(image.astype(np.int32), [(0, 0)] * (image.ndim - 2) + [(2, 2)] * 2, mode=mode)
    weights = (1, 4, 6, 4, 1)
    rows = sum(k * padded[..., i : i + height, :] for i, k in enumerate(weights))
    both = sum(k * rows[..., i : i + width] for i, k in enumerate(weights))
    return ((both + 128) >> 8).astype(np.uint8)


def threshold(image: np.ndarray, level: int) -> np.ndarray:
    """255 above the level, else 0."""
    return np.where(image > level, 255, 0).astype(np.uint8)


class Runs:
    """The runs of set pixels of a stack of pictures, row by row, and the components they form."""

    def __init__(self, on: np.ndarray, reach: int) -> None:
        """``reach`` 1: pixels that touch at a corner belong together; 0: only at a side."""
        n, self.height, self.width = on.shape
        padded = np.zeros((n * self.height, self.width + 2), np.int8)
        padded[:, 1:-1] = on.reshape(-1, self.width)
        step = np.diff(padded, axis=1)
        self.row, self.start = np.nonzero(step == 1)
        self.end = np.nonzero(step == -1)[1] - 1
        wide = self.width + 2
        self.first, last = self.row * wide + self.start, self.row * wide + self.end
        inner = np.flatnonzero(self.row % self.height < self.height - 1)
        below = (self.row[inner] + 1) * wide
        lo, hi = np.searchsorted(last, below + self.start[inner] - reach), np.searchsorted(self.first, below + self.end[inner] + reach, side="right")
        count = np.maximum(0, hi - lo)
        a = np.repeat(inner, count)
        b = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        self.label = np.arange(len(self.row))  # the first run of the component, in the end
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(jumped := self.label[self.label], self.label):
                self.label = jumped

    def at(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The components of set pixels."""
        return self.label[np.searchsorted(self.first, row * (self.width + 2) + x, side="right") - 1]

    def pixels(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat positions of the pixels of some runs, and for each which run it is of."""
        size = self.end[of] - self.start[of] + 1
        which = np.repeat(np.arange(len(of)), size)
        return (self.row[of] * self.width + self.start[of] - np.cumsum(size) + size)[which] + np.arange(int(size.sum())), which


class Blobs:
    """8-connected blobs of a stack of binary pictures: their runs, and the area within each outermost blob's outer border.

    The border runs through pixel centres, so the area is that of the 2 x 2 cells with all pixels set, and half that of those
    with three, once holes and what lies in them are filled in: a full block of w x h pixels has (w - 1)(h - 1).
    """

    def __init__(self, binary: np.ndarray) -> None:
        on = binary > 0
        n, height, width = on.shape
        self.runs = runs = Runs(on, 1)
        holes = Runs(~on, 0)
        edge = (holes.row % height == 0) | (holes.row % height == height - 1) | (holes.start == 0) | (holes.end == width - 1)
        outside = np.zeros(len(holes.row), bool)
        outside[holes.label[edge]] = True
        outer = np.arange(len(runs.row))  # of a component: the outermost one around it
        inside = np.flatnonzero(~outside[holes.label])
        if len(inside):
            roots = np.flatnonzero(holes.label == np.arange(len(holes.label)))
            around = np.zeros(len(holes.row), np.int64)
            lake = roots[~outside[roots]]
            around[lake] = runs.at(holes.row[lake] - 1, holes.start[lake])  # what lies above a hole's first pixel is around it
            isle = np.flatnonzero((runs.label == np.arange(len(runs.label))) & (runs.row % height > 0))
            water = holes.at(runs.row[isle] - 1, runs.start[isle])
            isle, water = isle[~outside[water]], water[~outside[water]]
            outer[isle] = around[water]
            while not np.array_equal(outer[outer], outer):
                outer = outer[outer]
        self.outer = outer[runs.label]
        picture = np.zeros(n * height * width, np.int64)
        at, which = runs.pixels(np.arange(len(runs.row)))
        picture[at] = self.outer[which] + 1
        if len(inside):
            at, which = holes.pixels(inside)
            picture[at] = outer[around[holes.label[inside]]][which] + 1
        picture = picture.reshape(n, height, width)
        corners = [picture[:, dy : dy + height - 1, dx : dx + width - 1] for dy in (0, 1) for dx in (0, 1)]
        full = sum((c > 0).astype(np.int8) for c in corners) if height > 1 and width > 1 else np.zeros((n, 0, 0), np.int8)
        cells = np.nonzero(full >= 3)
        name = np.maximum.reduce([c[cells] for c in corners]) - 1 if len(cells[0]) else np.zeros(0, np.int64)
        self.area = np.bincount(name, weights=np.where(full[cells] == 4, 1.0, 0.5), minlength=len(runs.row))
        self.count = n

    def largest(self) -> list[np.ndarray | None]:
        """For each picture the runs of the outermost blob of largest area, the first of equal ones; None if all areas are 0."""
        names = np.flatnonzero(self.area > 0)
        picture = self.runs.row[names] // self.runs.height
        by = np.lexsort((names, -self.area[names], picture))
        first = by[np.concatenate([[True], np.diff(picture[by]) > 0])] if len(by) else by
        best = np.full(self.count, -1)
        best[picture[first]] = names[first]
        mine = np.flatnonzero(self.runs.label == best[self.runs.row // self.runs.height])
        cuts = np.searchsorted(self.runs.row[mine] // self.runs.height, np.arange(self.count + 1))
        return [mine[a:b] if b > a else None for a, b in zip(cuts, cuts[1:])]


    def bound(self, of: np.ndarray) -> tuple[int, int, int, int]:
        """(x, y, w, h) around some runs of one picture."""
        row, x = self.runs.row[of] % self.runs.height, int(self.runs.start[of].min())
        return x, int(row[0]), int(self.runs.end[of].max()) - x + 1, int(row[-1]) - int(row[0]) + 1


def regions(binary: np.ndarray) -> list[np.ndarray]:
    """8-connected blobs, each as its (x, y) pixels, in the order their first pixels are met from the top left."""
    runs = Runs((binary > 0)[None], 1)
    at, which = runs.pixels(np.arange(len(runs.row)))
    name = runs.label[which]
    by = np.argsort(name, kind="stable")
    cuts = np.flatnonzero(np.diff(name[by])) + 1
    points = np.stack([at % binary.shape[1], at // binary.shape[1]], axis=1)[by]
    return np.split(points, cuts) if len(by) else []


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in a frame whose y points up (monotone chain)."""
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for x, y in points.tolist():
        low[x], high[x] = min(low.get(x, y), y), max(high.get(x, y), y)
    p = sorted({*low.items(), *high.items()})  # what lies between two points of its column is no corner
    if len(p) < 3:
        return np.array(p)

    def chain(ordered: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for x, y in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def outline(region: np.ndarray) -> np.ndarray:
    """A blob's outer border pixels in order around it (Moore tracing from its top left pixel)."""
    low, high = region.min(axis=0), region.max(axis=0)
    wide = int(high[0] - low[0]) + 3  # with an empty border
    inside = bytearray(wide * (int(high[1] - low[1]) + 3))
    flat = (region[:, 1] - low[1] + 1) * wide + region[:, 0] - low[0] + 1
    for i in flat.tolist():
        inside[i] = 1
    around = (1, 1 + wide, wide, wide - 1, -1, -1 - wide, -wide, 1 - wide)
    start = int(flat.min())
    out, at, came, first = [start], start, 4, -1
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            if inside[at + around[d]]:
                break
        else:
            break
        step = at + around[d]
        if first < 0:
            first = step
        elif at == start and step == first:
            out.pop()
            break
        out.append(step)
        at, came = step, (d + 4) % 8
    border = np.array(out)
    return np.stack([border % wide - 1 + low[0], border // wide - 1 + low[1]], axis=1)


def polygon_area(points: np.ndarray) -> float:
    """Area within a polygon of pixel centres: a filled block of w x h pixels has (w - 1)(h - 1)."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0].astype(np.int64), points[:, 1].astype(np.int64)
    return abs(int((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def largest(binary: np.ndarray) -> np.ndarray | None:
    """The outline of largest area, the first of equal ones; None if every area is 0."""
    blobs = Blobs(binary[None])
    best = blobs.largest()[0]
    if best is None:
        return None
    at, _ = blobs.runs.pixels(best)
    return outline(np.stack([at % binary.shape[1], at // binary.shape[1]], axis=1))


@dataclass(frozen=True)
class Rotated:
    cx: float
    cy: float
    w: float
    h: float
    angle: float

    def corners(self) -> np.ndarray:
        a = np.radians(self.angle)
        u, v = np.array([np.cos(a), np.sin(a)]) * self.w / 2, np.array([-np.sin(a), np.cos(a)]) * self.h / 2
        c = np.array([self.cx, self.cy])
        return np.array([c - u + v, c - u - v, c + u - v, c + u + v])


def min_area_rect(points: np.ndarray) -> Rotated:
    """The rotated rectangle of least area around points; its angle in (0, 90]."""
    h = hull(points).astype(np.float64)
    if len(h) == 1:
        return Rotated(float(h[0, 0]), float(h[0, 1]), 0.0, 0.0, 90.0)
    edges = np.roll(h, -1, axis=0) - h if len(h) > 2 else h[1:] - h[:1]
    a = np.degrees(np.arctan2(edges[:, 1], edges[:, 0])) % 90
    angles = np.where(a == 0, 90.0, a)
    u = np.array([np.cos(np.radians(angles)), np.sin(np.radians(angles))])
    p, q = h @ u, h @ np.array([-u[1], u[0]])
    left, right, low, high = p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)
    area = (right - left) * (high - low)
    k = int(np.argmax(area <= area.min() + 1e-9))
    x, y = (right[k] + left[k]) / 2, (high[k] + low[k]) / 2
    return Rotated(float(u[0, k] * x - u[1, k] * y), float(u[1, k] * x + u[0, k] * y), float(right[k] - left[k]), float(high[k] - low[k]), float(angles[k]))


def rotate(image: np.ndarray, cx: float, cy: float, degrees: float, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """The image turned about a centre on the same canvas, or a window (x, y, w, h) of that: bilinear, border pixels repeated."""
    height, width = image.shape[:2]
    x, y, w, h = window or (0, 0, width, height)
    a, b = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    dx, dy = np.arange(x, x + w)[None, :] - cx, np.arange(y, y + h)[:, None] - cy
    sx, sy = np.clip(a * dx - b * dy + cx, 0, width - 1), np.clip(b * dx + a * dy + cy, 0, height - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    flat = np.ascontiguousarray(image).reshape(height * width, *image.shape[2:])
    at = lambda y, x: flat.take(y * width + x, axis=0)
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def half_turn(image: np.ndarray) -> np.ndarray:
    return image[::-1, ::-1]


_SQUARE = np.array([(0, 0), (1, 0), (0, 1), (1, 1)])
_DISC = np.array([(x, y) for x in range(-4, 5) for y in range(-4, 5) if x * x + y * y <= 16])


def mark(image: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The code's outline (red, 2 wide) and corners (green discs of radius 4): the reader sees them."""
    out = to_bgr(image).copy()
    most = np.array(out.shape[1::-1]) - 1
    lines = []
    for p, way in zip(points, points[[*range(1, len(points)), 0]] - points):
        steps = int(max(abs(way).max(), 1))
        t = np.arange(steps + 1) * (1.0 / steps)
        t[-1] = 1.0
        lines.append(np.rint(p + way * t[:, None]).astype(int))
    line = np.minimum(np.maximum(np.concatenate(lines)[:, None, :] + _SQUARE, 0), most).reshape(-1, 2)
    out[line[:, 1], line[:, 0]] = (0, 0, 255)
    disc = (points.astype(int)[:, None, :] + _DISC).reshape(-1, 2)
    disc = disc[((disc >= 0) & (disc <= most)).all(axis=1)]
    out[disc[:, 1], disc[:, 0]] = (0, 255, 0)
    return out


Found = tuple[Rotated, tuple[int, int, int, int]]


def detect_all(stack: np.ndarray, level: int = 180) -> list[Found | None]:
    """For each image of a stack the rotated rectangle and the upright bound (x, y, w, h) of the brightest large blob."""
    blobs = Blobs(threshold(blur(gray(stack)), level))
    runs, out = blobs.runs, []
    for best in blobs.largest():
        if best is None:
            out.append(None)
            continue
        row = runs.row[best] % runs.height
        points = np.concatenate([np.stack([runs.start[best], row], axis=1), np.stack([runs.end[best], row], axis=1)])
        out.append((min_area_rect(points), blobs.bound(best)))
    return out


def detect(image: np.ndarray, level: int = 180) -> Found | None:
    return detect_all(image[None], level)[0]


STACK = 4 << 20  # pixels looked at together


def detect_each(images: list[np.ndarray], level: int = 180) -> list[Found | None]:
    """``detect`` for images of any sizes, those of one size together."""
    by_size: dict[tuple[int, ...], list[int]] = {}
    for i, image in enumerate(images):
        if image.size:
            by_size.setdefault(image.shape, []).append(i)
    out: list[Found | None] = [None] * len(images)
    for shape, which in by_size.items():
        step = max(1, STACK // max(1, shape[0] * shape[1]))
        for at in range(0, len(which), step):
            some = which[at : at + step]
            for i, found in zip(some, detect_all(np.stack([images[i] for i in some]), level)):
                out[i] = found
    return out


DETECTED = "frame_id long, cx float, cy float, w float, h float, angle float, bx int, by int, bw int, bh int"


def detect_frames(frames: DataFrame, level: int = 180) -> DataFrame:
    """Labels found in frames (frame_id, height, width, data, and nChannels if there are others than three); a frame without one, or with other bytes than it says, has no row."""
    channels = "nChannels" if "nChannels" in frames.columns else "3 AS nChannels"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DETECTED.split(", ")]
        for part in parts:
            keys, images = [], []
            for frame, height, width, depth, data in zip(*(part[c] for c in ("frame_id", "height", "width", "nChannels", "data"))):
                try:
                    images.append(to_bgr(image_array(data, height, width, depth)))
                    keys.append(frame)
                except (ValueError, TypeError):  # not the bytes of such a picture
                    pass
            rows = [(key, r.cx, r.cy, r.w, r.h, r.angle, *b) for key, got in zip(keys, detect_each(images, level)) if got for r, b in [got]]
            yield pd.DataFrame(rows, columns=names)

    return frames.selectExpr("frame_id", "height", "width", channels, "data").mapInPandas(run, DETECTED)
