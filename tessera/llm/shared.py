"""Session settings, the shared scratch folder and column helpers used by the training-data operators.

Intermediate tables are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver reach it, so a lost executor costs only the
tasks it was running.  The folder of each run is removed when the driver ends, or earlier by
:func:`sweep`.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a Python worker; longer single texts are still taken whole.
CHUNK_BYTES = 2 << 20
#: Bytes of input a reduce-side bucket should hold.
BUCKET_BYTES = 8 << 20
#: Size estimates from here on mean that the size isn't known.
UNKNOWN_BYTES = 1 << 60

_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_folders: list[tuple[SparkSession, str]] = []


def settle(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes and let finished queries free their shuffle files."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` where set, else, on one machine only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        _folders.append((spark, root))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table or set of files."""
    path = f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def save(df: DataFrame, name: str, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.  options: the writer's."""
    spark = settle(df.sparkSession)
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd").options(**options or {})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Remove all scratch folders of this driver; results that were not written yet become unreadable."""
    while _folders:
        spark, path = _folders.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone when the driver ends
            continue


atexit.register(sweep)


def buckets(df: DataFrame, factor: float = 1.0) -> int:
    """Reduce-side tasks for a frame, from the optimiser's size estimate; at least the session's setting.

    A frame that isn't read from files (local rows, an RDD) has no estimate but a placeholder beyond all
    real sizes; it gets the session's setting.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size >= UNKNOWN_BYTES:
        return least
    return max(least, min(200_000, int(size * factor / BUCKET_BYTES)))


def merged(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the corpus: merged by key at every size and never broadcast."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the tables of a data folder."""
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the whole text (null: empty) and nothing else, so that other columns can't clash."""
    return df.select(F.col(f"`{key}`").cast("long").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return what earlier tasks of this worker have freed to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each slice has about ``limit`` bytes of ``column`` (one row at least)."""
    import numpy as np

    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(start, stop - start)


_TYPES = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "spans": (
        T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
    ),
}


def arrow_schema(fields: str) -> tuple[T.StructType, pa.Schema]:
    """A Spark schema and the Arrow schema of what mapInArrow yields for it, from "name type, name type"."""
    pairs = [field.split() for field in fields.split(",")]
    return (
        T.StructType([T.StructField(name, _TYPES[kind][0]) for name, kind in pairs]),
        pa.schema([(name, _TYPES[kind][1]) for name, kind in pairs]),
    )
