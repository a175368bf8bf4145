"""Pixel kernels, the reader boundary, and the sources."""

from __future__ import annotations

import struct
import zipfile
import zlib

import numpy as np
import pytest

from tagstream.operators import imaging, reader
from tagstream.sources import frames, xlsx


def test_filled_block_has_the_area_between_pixel_centres():
    image = np.zeros((20, 30), np.uint8)
    image[4:10, 5:17] = 255
    assert imaging.polygon_area(imaging.largest(image)) == 11 * 5
    assert imaging.largest(np.zeros((5, 5), np.uint8)) is None


def test_first_of_equal_blobs_wins_and_single_pixels_do_not_count():
    image = np.zeros((20, 30), np.uint8)
    image[1, 1] = 255
    image[3:6, 3:6] = 255
    image[10:13, 10:13] = 255
    assert imaging.largest(image).min(axis=0).tolist() == [3, 3]


def test_diagonal_pixels_are_one_region():
    assert len(imaging.regions(np.eye(6, dtype=np.uint8) * 255)) == 1


def test_rotated_rectangle():
    r = imaging.min_area_rect(np.array([[0, 0], [10, 0], [10, 4], [0, 4]]))
    assert {round(r.w), round(r.h)} == {10, 4} and r.angle == 90.0 and (r.cx, r.cy) == pytest.approx((5, 2))
    tilted = np.array([[10, 0], [0, 10], [-5, 5], [5, -5]])
    t = imaging.min_area_rect(tilted)
    assert 0 < t.angle <= 90 and t.w * t.h == pytest.approx(100)
    assert {tuple(np.rint(c).astype(int)) for c in t.corners()} == {tuple(p) for p in tilted}


def test_kernels():
    image = np.full((9, 9, 3), 100, np.uint8)
    assert (imaging.gray(image) == 100).all() and (imaging.blur(imaging.gray(image)) == 100).all()
    assert imaging.threshold(np.array([[180, 181]], np.uint8), 180).tolist() == [[0, 255]]
    assert (imaging.rotate(image, 4, 4, 30) == 100).all() and imaging.to_bgr(image[:, :, :1]).shape == (9, 9, 3)
    mixed = np.arange(27, dtype=np.uint8).reshape(3, 3, 3)
    assert (imaging.half_turn(imaging.half_turn(mixed)) == mixed).all()
    assert (imaging.rotate(mixed, 1, 1, 0) == mixed).all()
    assert (imaging.mark(np.zeros((20, 20, 3), np.uint8), np.array([[5, 5], [15, 5], [15, 15], [5, 15]]))[5, 5] == (0, 255, 0)).all()
    assert imaging.crop(mixed, 1, 0, 2, 1).shape == (1, 2, 3)


def _replay():
    image = np.zeros((10, 10, 3), np.uint8)
    return reader.Replay({imaging.crop(image, 0, 6, 8, 4).tobytes(): (("code", np.array([[1, 2]] * 4)), [("3000", 0.9), (" ", 0.2)])})


class _Broken(reader.Replay):
    def read_text(self, image):
        raise RuntimeError("no engine")


def _broken():
    return _Broken({})


def test_reading(spark):
    black = bytes(300)
    labels = spark.createDataFrame([(1, 10, 10, bytearray(black)), (2, 1, 1, bytearray(3)), (3, 10, 10, bytearray(b"\1" * 300))], "frame_id long, height int, width int, data binary")
    got = {r["frame_id"]: r for r in reader.read_labels(labels, "replay", _replay).collect()}
    assert got[1]["ran"] and got[1]["min_score"] == pytest.approx(0.2) and [b["text"] for b in got[1]["blocks"]] == ["3000", " "]
    assert not got[2]["ran"] and got[2]["min_score"] == -999
    assert got[3]["ran"] and got[3]["min_score"] == 999
    assert all(not r["ran"] and r["min_score"] == -999 for r in reader.read_labels(labels, "broken", _broken).collect())


def test_codes(spark):
    part = spark.createDataFrame([(1, 5, 7, 4, 8, bytearray(96)), (2, 0, 0, 2, 2, bytearray(12))], "frame_id long, bx int, by int, height int, width int, data binary")
    got = reader.decode_codes(part, "replay", _replay).collect()
    assert [(r["frame_id"], r["qr_text"], tuple(r["qr_points"][0])) for r in got] == [(1, "code", (6.0, 9.0))]


def png(path, pixels):
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_frames_in_batch_and_as_stream(spark, tmp_path):
    folder = tmp_path / "camera"
    folder.mkdir()
    rgb = np.zeros((2, 3, 3), np.uint8)
    rgb[0, 0] = (255, 0, 0)
    png(folder / "a.png", rgb)
    (folder / "broken.png").write_bytes(b"nothing")
    rows = frames.batch(spark, str(folder), 3).collect()
    assert len(rows) == 1 and rows[0]["camera_id"] == 3
    image = rows[0]["image"]
    assert imaging.image_array(bytes(image["data"]), image["height"], image["width"])[0, 0].tolist() == [0, 0, 255]
    query = frames.stream(spark, str(folder), 3).writeStream.format("memory").queryName("frames_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("frames_seen").count() == 1


BOOK = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="b" sheetId="2" r:id="r9"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r9" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Code</t></si><si><r><t>Dark </t></r><r><t>Blue</t></r></si></sst>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c></row><row r="3"/><row r="4"><c r="B4"><v>3000</v></c><c r="C4" t="inlineStr"><is><t>XL</t></is></c><c r="D4" t="s"><v>1</v></c></row><row r="6"><c r="C6"><v>1.5</v></c></row></sheetData></worksheet>',
}


def test_spreadsheet(spark, tmp_path):
    path = tmp_path / "data.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        for name, content in BOOK.items():
            book.writestr(name, content)
    want = [(4, "3000", "XL", "Dark Blue"), (6, None, "1.5", None)]
    assert [tuple(r) for r in xlsx.read(spark, str(path)).collect()] == want
    xlsx.register(spark)
    assert [tuple(r) for r in spark.read.format("label_sheet").load(str(path)).collect()] == want
