"""Frame sources: image folders in batch and as a stream, one camera a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType(
    [
        T.StructField(
            "image",
            T.StructType(
                [
                    T.StructField("origin", T.StringType()),
                    T.StructField("height", T.IntegerType()),
                    T.StructField("width", T.IntegerType()),
                    T.StructField("nChannels", T.IntegerType()),
                    T.StructField("mode", T.IntegerType()),
                    T.StructField("data", T.BinaryType()),
                ]
            ),
        )
    ]
)


def readable(frames: DataFrame) -> DataFrame:
    """Frames that were read and have pixels."""
    return frames.where(F.col("image").isNotNull() & (F.col("image.width") > 0) & (F.col("image.height") > 0))


def batch(spark: SparkSession, path: str, camera_id: int = 0) -> DataFrame:
    """(camera_id, frame_id, image) of a folder; frames are numbered by a hash of their origin."""
    return _named(readable(spark.read.format("image").option("dropInvalid", True).load(path)), camera_id)


def stream(spark: SparkSession, path: str, camera_id: int = 0) -> DataFrame:
    """The same as a stream: files as they arrive.  ``StreamingQuery.stop`` closes it."""
    return _named(readable(spark.readStream.format("image").schema(IMAGE).load(path)), camera_id)


def _named(frames: DataFrame, camera_id: int) -> DataFrame:
    return frames.select(F.lit(camera_id).cast("long").alias("camera_id"), F.xxhash64("image.origin").alias("frame_id"), "image")
