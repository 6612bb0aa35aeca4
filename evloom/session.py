"""Session helpers shared by the engine: the shared folder, written intermediates, shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "spark.evloom.shipped"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session has none and runs on one machine (local tests) a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.evloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evloom-")
        spark.conf.set("spark.evloom.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. `few` is for rows of
    ids and numbers, not of texts: at most four files a core, however many partitions they are dealt over."""
    spark = df.sparkSession
    df = df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df
    path = f"{shared_dir(spark)}/evloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_evloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def alone(make, name: str) -> DataFrame:
    """written(make(), name); the tables that were written on the way are deleted."""
    at = len(_WRITTEN)
    out = written(make(), name)
    for path in _WRITTEN[at:-1]:
        _delete(out.sparkSession, path)
    del _WRITTEN[at:-1]
    return out


def clean(spark: SparkSession) -> None:
    """Delete all intermediates that this driver has written: for sessions that have used their results."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run (once per session), and keep their Arrow
    batches small: whole texts travel in them. A batch size that the session has set itself stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    if spark.conf.get(_SHIPPED, None) == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="evloom-code-"), "evloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("evloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)


def sliced(batches, rows: int = 512):
    """Arrow batches in smaller parts: bounds what a Python worker holds at once. At the end of the input the worker gives
    memory that it no longer uses back to the system: workers stay for later stages beside the executor's heap."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        _release()


def _release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to ask for
        pass


def settled(df: DataFrame) -> DataFrame:
    """df as it is, but filters from above stay above: pushed below the projections that make their columns, they repeat
    whole nested expressions once per mention. A column without a fixed value holds them in place."""
    return df.withColumn("_pin", F.monotonically_increasing_id()).where("_pin >= 0").drop("_pin")


def where_once(df: DataFrame, condition) -> DataFrame:
    """df.where(condition), kept above the projections that make its columns.

    Pushed below them, a filter repeats their expressions once per mention, which for nested
    measurements multiplies the work; a column without a fixed value holds it in place.
    """
    return df.withColumn("_pin", F.monotonically_increasing_id()).where(condition & (F.col("_pin") >= 0)).drop("_pin")
