"""Shared pieces of the training-data operators: scratch tables, word rules, Arrow helpers."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]++"
#: The same six characters, for trimming. ``bytes.split()`` and ``bytes.strip()`` use exactly these.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a null id sorts as where an order is needed: after all others.
LAST_ID = 9223372036854775807


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        from tempfile import gettempdir

        root = f"file://{gettempdir()}/quire-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/quire-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_quire_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        if path := df.__dict__.get("_quire_path"):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def binary_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b""."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class HashCache(dict):
    """word -> 64-bit hash, filled on demand; emptied when it holds too many words for a worker's memory."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every window of n word hashes; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for i in range(1, n):
        h *= _P
        h += words[i : i + m]
    h ^= h >> np.uint64(29)
    h *= _Q
    h ^= h >> np.uint64(32)
    return h


def release() -> None:
    """Hand memory that a task has freed back to the system: Spark reuses Python workers for tasks of other operators."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def released(run):
    """run over Arrow batches; what it held goes back to the system when the task ends."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def worker_state(key: str, make):
    """What make() gives, kept for later tasks of the same Python worker: tables that only save time."""
    import sys
    from types import ModuleType

    held = sys.modules.setdefault("_quire_worker_state", ModuleType("_quire_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, for the rows are whole texts: a batch stands in the executor's
    direct memory and in the worker's at once, beside the worker's tables. A session that has a value of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)
