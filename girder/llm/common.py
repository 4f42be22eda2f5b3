"""Shared folders, saved tables and Arrow batches for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that a vectorised step handles at once.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = new_dir(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that are no longer referenced."""
    for _ in range(2):  # what the first round frees held the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def put(path: str, data: bytes) -> None:
    """Write under another name, then rename: a task that is repeated leaves a whole file."""
    store, at = fs.FileSystem.from_uri(path)
    own = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, at)


def drop_saved(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by saved(), when nothing reads it any more."""
    spark = df.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages, which need it otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    arrow_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read, whatever else ``docs`` has; null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; text i is bytes[offsets[i]:offsets[i + 1]]."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, ends, data = column.buffers()
    if ends is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes each; a longer text gets a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
