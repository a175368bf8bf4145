"""Every query of the reference's operators against its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tagstream.plans import catalogue, readings, streams  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame, columns):
    frame = frame[columns].map(lambda v: round(v, 6) if isinstance(v, float) else v)
    return frame.astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert plain(got, columns).equals(plain(want, columns))


def test_imaging_finds_every_rectangle(spark, sf_dir):
    rows = catalogue.QUERIES["imaging_pipeline"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    for r in rows:
        k = r["frame_id"]
        x, y, w, h = k % 17 + 4, k % 11 + 4, k % 13 + 8, k % 7 + 8
        assert abs(r["cx"] - (x + (w - 1) / 2)) <= 1 and abs(r["cy"] - (y + (h - 1) / 2)) <= 1
        assert abs(r["bw"] - w) <= 2 and abs(r["bh"] - h) <= 2
