"""Plumbing between DataFrames and Arrow kernels; tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES``, unless the session has a bound of its own.

    A batch is held several times over, in the JVM and in the worker, as input and as output.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give the memory a finished task has freed back to the system: Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


Kernel = Callable[..., Sequence[pa.Array]]


def position(df: DataFrame, name: str) -> int:
    """Index of a column: the exact name first, else without regard to case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return i
    raise ValueError(f"no column {name!r} among {df.columns}")


def append_columns(df: DataFrame, inputs: Sequence[str], outputs: T.StructType, make: Callable[[], Kernel]) -> DataFrame:
    """``df`` with the columns of ``outputs``, computed from ``inputs`` by an Arrow kernel.

    ``make`` runs once a task and returns the kernel, which gets the input
    arrays of a batch and returns one array for each output.  Like
    ``withColumn``, an output replaces an input column of the same name; all
    other columns, whatever their names, pass through unchanged.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in outputs}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    picked = plain.select(*[f"c{i}" for i in keep], *[F.col(f"c{position(df, c)}").alias(f"in{k}") for k, c in enumerate(inputs)])
    fields = [T.StructField(f"c{i}", df.schema[i].dataType) for i in keep]
    fields += [T.StructField(f"out{k}", f.dataType) for k, f in enumerate(outputs)]
    kinds = [to_arrow_schema(T.StructType([f])).field(0).type for f in outputs]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            made = kernel(*batch.columns[n_keep:])
            made = [a if a.type == kind else a.cast(kind) for a, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=[f.name for f in fields])
            del made, batch
        if done := getattr(kernel, "done", None):
            done()
        del kernel
        gc.collect()
        release()

    out = picked.mapInArrow(run, T.StructType(fields))
    return out.toDF(*[df.columns[i] for i in keep], *[f.name for f in outputs])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a folder of this machine on a local master, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = "file:///tmp/tagstream-checkpoints"
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
    return folder.rstrip("/")


class Scratch:
    """Tables written in the shared folder, which any executor can read again after one is lost; what is not dropped goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}
        small_batches(spark)
        root = self.at(self.root)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(root)
        files.deleteOnExit(root)

    def at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again: the plan before it is cut off."""
        path = f"{self.root}/{len(self.paths) + 1}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that no later step reads; all of them if none is named."""
        for k, (table, path) in list(self.paths.items()):
            if table is not None and (not tables or any(table is t for t in tables)):
                at = self.at(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
                self.paths[k] = (None, path)
