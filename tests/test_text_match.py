"""Golden rows of the dictionary, the match and the scores."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tagstream.functions import text
from tagstream.operators import master, match

SHEET = [(0, "Code", "Size", "Colour"), (1, "3000", "XL", "Dark Blue"), (2, " 3000 ", "2 XL", "RED"), (3, None, "xl", "dark blue"), (4, "A 12", "  ", "red")]
SCHEMA = "pos long, model string, size string, color string"


@pytest.fixture(scope="module")
def entries(spark):
    return master.dictionary(master.skip_header(spark.createDataFrame(SHEET, SCHEMA)))


def test_dictionary_keeps_first_seen_order(entries):
    got = {r["kind"]: r["listing"] for r in master.listing(entries).collect()}
    assert got == {"model": "3000, a12", "size": "xl, 2xl", "color": "darkblue, red"}


def test_codes_do_not_decide_validity(spark):
    def valid(rows):
        entries = master.dictionary(spark.createDataFrame(rows, SCHEMA))
        return master.validity(entries).head()["valid"], entries

    ok, entries = valid([(1, "a", None, " ")])
    assert not ok
    with pytest.raises(master.NoValidData):
        master.checked(entries)
    ok, entries = valid([(1, None, "xl", None)])
    assert ok and master.checked(entries).count() == 1


MATCHES = [
    (["3000", "XL", "Red"], "3000", "XL", "Red"),
    (["3000", "XL", "Dark", "Blue"], "3000", "XL", "DarkBlue"),
    (["3000", "XL", "Dark Blue"], "3000", "XL", ""),
    (["3000", "2 XL", "Red"], "3000", "", "Red"),
    (["3000", "2XL", "Red"], "3000", "2XL", "Red"),
    (["A12", "xl", "red"], "A12", "xl", "red"),
    (["XL", "3000", "Red"], "", "", "Red"),
    (["3000", "XL", "Red", "extra"], "3000", "XL", ""),
    ([" 3000　", "XL", "\tRed "], "3000", "XL", "Red"),
    (["3000", None, "Red"], "3000", "", "Red"),
    (["3000", "XL"], "", "", ""),
    ([], "", "", ""),
    (None, "", "", ""),
]


def test_positional_match(spark, entries):
    rows = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MATCHES)], "id int, tokens array<string>")
    matched = match.match(rows, entries)
    got = {r["id"]: (r["ma_ao"], r["size"], r["color"]) for r in matched.collect()}
    assert got == {i: tuple(m[1:]) for i, m in enumerate(MATCHES)}
    assert {r["id"] for r in match.accepted(matched).collect()} == {i for i, m in enumerate(MATCHES) if all(m[1:])}


BLOCKS = [
    ([("3000", 0.99), (" ", 0.10), ("XL", 0.97), ("Red", 0.95)], ["3000", "XL", "Red"], 0.10),
    ([(None, 0.5), ("XL", 0.9)], ["XL"], 0.5),
    ([], [], 999.0),
    ([("x", math.nan)], ["x"], 999.0),
]


def test_tokens_and_lowest_score(spark):
    rows = spark.createDataFrame([(b[0],) for b in BLOCKS], "blocks array<struct<text:string,score:float>>")
    got = rows.select(match.tokens(F.col("blocks")).alias("t"), match.min_score(F.col("blocks.score")).alias("s"), match.min_score(F.col("blocks.score"), F.lit(False)).alias("off")).collect()
    for r, (_, tokens, score) in zip(got, BLOCKS):
        assert r["t"] == tokens and r["s"] == pytest.approx(score) and r["off"] == -999.0


def test_texts(spark):
    row = spark.range(1).select(
        text.utrim(F.lit("  a b\u0085")).alias("trim"), text.squash(F.lit("a b\tc")).alias("squash"), text.utrim(F.lit("​a")).alias("kept"),
        text.is_blank(F.lit(" 　")).alias("blank"), text.result_text(F.lit("q"), F.lit("c"), F.lit(None), F.lit("d")).alias("result"), text.accuracy_text(F.lit(0.5)).alias("acc"),
        text.debug_text(F.array(F.struct(F.lit(" a ").alias("text"), F.lit(0.25).alias("score")), F.struct(F.lit(None).cast("string").alias("text"), F.lit(0.5).alias("score")))).alias("debug"),
        text.fps(F.lit(40)).alias("fps"), text.fps(F.lit(0)).alias("none"), text.is_empty(F.lit("")).alias("empty"),
    ).head()
    assert row["trim"] == "a b" and row["squash"] == "abc" and row["kept"] == "​a" and row["blank"] and row["empty"]
    assert row["result"] == 'QR: "q"\r\nMã áo: "c"\r\nSize áo: ""\r\nMàu áo: "d"' and row["acc"] == "Accuracy: 50.00%"
    assert row["debug"] == "a | Score: 25.00%\r\n | Score: 50.00%\r\n" and row["fps"] == 25.0 and row["none"] == 0.0


def test_cameras(spark):
    got = master.camera_labels(spark.createDataFrame([(1, "front"), (2, "back")], "k int, name string"), "k", "name").collect()
    assert [(r["camera_index"], r["label"]) for r in got] == [(0, "0. front"), (1, "1. back")]
    none = master.camera_labels(spark.createDataFrame([], "k int, name string"), "k", "name").collect()
    assert [(r["camera_index"], r["label"]) for r in none] == [(None, "No camera found.")]
