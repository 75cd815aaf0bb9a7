"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets one made here; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/spanloom/{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, tag: str, by: list[str]) -> DataFrame:
    """Like ``materialize`` for rows grouped by the keys, in as many buckets of them as there are shuffle partitions: joins by
    the keys, with tables written alike or with anything that is exchanged, leave these rows where they are."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def tidy(run):
    """The pass ``run`` over Arrow batches, which hands memory that it no longer uses back when it ends: a Python worker lives
    on from task to task, and what it keeps counts towards its executor."""

    def passes(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return passes


def digest_key(col: Column) -> Column:
    """A 16-byte key of a string; null counts as the empty string."""
    return F.unhex(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo ``n``; null stays null."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(field: T.StructField, ddl: str) -> T.StructType:
    """A schema of ``field`` and the columns of ``ddl``."""
    return T.StructType([field, *T.StructType.fromDDL(ddl).fields])


def chunks(texts: pa.Array, target: int = 1 << 21):
    """Split an Arrow string array into (first row, array) pieces of about ``target`` bytes; a longer text is a piece of its own."""
    offsets = _offsets(texts)
    n, i = len(texts), 0
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= target:
            j += 1
        yield i, texts.slice(i, j - i)
        i = j


def _offsets(arr: pa.Array):
    import numpy as np

    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    width = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=width)[arr.offset : arr.offset + len(arr) + 1]


def text_array(column: pa.Array) -> pa.Array:
    """The column as one plain string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column
