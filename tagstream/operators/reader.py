"""The boundary to QR decoding and text recognition, which this library leaves to plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import imaging
from .match import NO_BLOCKS, NOT_RUN

Block = tuple[str | None, float]


class LabelReader(Protocol):
    """One engine for each Python worker, made by a factory on its first use."""

    def decode_qr(self, image: np.ndarray) -> tuple[str, np.ndarray] | None:
        """Text and four corner points of a code, or None."""

    def read_text(self, image: np.ndarray) -> list[Block]:
        """Blocks (text, score) in reading order."""


class Replay:
    """A reader that answers from a table by image content, for tests and reruns."""

    def __init__(self, answers: dict[bytes, tuple[tuple[str, np.ndarray] | None, list[Block]]]) -> None:
        self.answers = answers

    def decode_qr(self, image: np.ndarray) -> tuple[str, np.ndarray] | None:
        return self.answers.get(image.tobytes(), (None, []))[0]

    def read_text(self, image: np.ndarray) -> list[Block]:
        return self.answers.get(image.tobytes(), (None, []))[1]


READ = "frame_id long, ran boolean, min_score float, blocks array<struct<text:string,score:float>>"
_engines: dict[str, LabelReader] = {}


def engine(name: str, factory: Callable[[], LabelReader]) -> LabelReader:
    if name not in _engines:
        _engines[name] = factory()
    return _engines[name]


def read_labels(labels: DataFrame, name: str, factory: Callable[[], LabelReader]) -> DataFrame:
    """Blocks of upright labels (frame_id, height, width, data), read in their lower left part.

    A label without such a part, or whose reading fails, has ``ran`` false, no
    blocks and the score for not run; one without blocks the score for none.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for frame, height, width, data in zip(part["frame_id"], part["height"], part["width"], part["data"]):
                ran, score, blocks = False, NOT_RUN, []
                try:
                    y, w, h = int(height * 0.6), int(width * 0.8), int(height * 0.4)
                    if w > 0 and min(h, height - y) > 0:
                        image = imaging.image_array(data, height, width)
                        blocks = engine(name, factory).read_text(imaging.crop(image, 0, y, w, h))
                        ran, score = True, min([NO_BLOCKS, *(s for _, s in blocks if s < NO_BLOCKS)])
                except Exception:  # a reader's failure is a frame without reading, never a failed job
                    ran, score, blocks = False, NOT_RUN, []
                rows.append((frame, ran, score, [{"text": t, "score": s} for t, s in blocks]))
            yield pd.DataFrame(rows, columns=["frame_id", "ran", "min_score", "blocks"])

    return labels.select("frame_id", "height", "width", "data").mapInPandas(run, READ)


DECODED = "frame_id long, qr_text string, qr_points array<struct<x:float,y:float>>"


def decode_codes(crops: DataFrame, name: str, factory: Callable[[], LabelReader]) -> DataFrame:
    """Codes found in label bounds (frame_id, bx, by, height, width, data), points moved to the whole region; failures count as none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for frame, bx, by, height, width, data in zip(*(part[c] for c in ("frame_id", "bx", "by", "height", "width", "data"))):
                try:
                    got = engine(name, factory).decode_qr(imaging.image_array(data, height, width))
                except Exception:  # counts as no code
                    got = None
                if got and got[0]:
                    rows.append((frame, got[0], [{"x": float(x + bx), "y": float(y + by)} for x, y in got[1]]))
            yield pd.DataFrame(rows, columns=["frame_id", "qr_text", "qr_points"])

    return crops.select("frame_id", "bx", "by", "height", "width", "data").mapInPandas(run, DECODED)
