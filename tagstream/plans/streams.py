"""Streams run to completion over what is there: the stateful operators over events, frames to the display; and a sheet from a workbook."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import master
from ..sources import xlsx
from ..streaming import state
from . import readings
from .catalogue import QUERIES, SQL, outcome_of_event, sheet


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine on a local master, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir is not set: the stream's output and log need a folder that all executors share")
    return (folder or "file:///tmp/tagstream-checkpoints").rstrip("/")


def own_folder(spark: SparkSession, name: str):
    """A new folder in the shared one, its file system, and a way to make paths; it goes when the driver ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(root))
    files.deleteOnExit(path(root))
    return root, files, path


def finished(frames: DataFrame, root: str) -> DataFrame:
    """All rows that a stream gives for what is there, kept in ``root``."""
    running = frames.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return frames.sparkSession.read.schema(frames.schema).parquet(f"{root}/out")


def completed(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    """What the operator gives for all events that are there, kept in the shared folder."""
    root, _, _ = own_folder(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads a folder: the file's own, with the file's name as filter.
    parent, _, name = path.rpartition("/")
    frames = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    frames = frames.select(F.col("user_id").alias("camera_id"), F.col("event_id").alias("frame_id"), "ts", outcome_of_event().alias("outcome"))
    out = finished(operator(frames), root)
    return out.select(F.col("frame_id").alias("event_id"), F.col("camera_id").alias("user_id"), "ts", "outcome", *[c for c in out.columns if c == "detected"])


def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn frames as a stream of images from eight cameras, on to the display's state."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    root, _, _ = own_folder(spark, "frames")
    frames = readings.camera_frames(read).withColumn("camera_id", F.col("frame_id") % 8).withColumn("ts", F.timestamp_micros(F.col("frame_id")))
    frames.write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(frames.schema).parquet(f"{root}/in")
    seen = readings.readings(arriving, master.dictionary(sheet(read)))
    return finished(state.sticky(seen), root).select("frame_id", "camera_id", "outcome", "detected")


QUERIES["stream_label_reading"] = displayed
SQL["stream_label_reading"] = f"""WITH {readings.FRAME_SQL} SELECT k AS frame_id, k % 8 AS camera_id, outcome,
  coalesce(last_value(CASE outcome WHEN 'SUCCESS' THEN true WHEN 'NO_LABEL' THEN false END IGNORE NULLS) OVER (PARTITION BY k % 8 ORDER BY k ROWS UNBOUNDED PRECEDING), false) AS detected FROM o"""


def workbook(rows: list[tuple]) -> bytes:
    """A workbook with one sheet: text as inline strings, numbers as numbers, nothing for null, an unused row before each tenth."""
    at, lines = 1, []
    for row in rows:
        at += 1 + (at % 10 == 0)
        cells = [f'<c r="{c}{at}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in zip("CDE", row) if v is not None]
        lines.append(f'<row r="{at}">{"".join(cells)}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    linked = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{linked}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, written as a workbook and read back as a master sheet."""
    root, files, path = own_folder(spark, "sheet")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25
    out = files.create(path(f"{root}/master.xlsx"))
    out.write(bytearray(workbook([("Code", "Size", "Colour"), *((r["n_name"], r["n_nationkey"], None if r["n_regionkey"] == 0 else f" {r['n_regionkey']} ") for r in rows)])))
    out.close()
    return xlsx.read(spark, f"{root}/master.xlsx").select("model", "size", "color")


QUERIES["sheet_scan"] = scanned
SQL["sheet_scan"] = "SELECT n_name AS model, n_nationkey::VARCHAR AS size, CASE WHEN n_regionkey <> 0 THEN ' ' || n_regionkey || ' ' END AS color FROM nation"
QUERIES["stream_sticky"] = lambda spark, sf_dir: completed(spark, sf_dir, state.sticky)
SQL["stream_sticky"] = SQL["sticky_state"]
QUERIES["stream_pause"] = lambda spark, sf_dir: completed(spark, sf_dir, lambda frames: state.paused(frames, 24 * 3600))
SQL["stream_pause"] = SQL["pause_filter"]
