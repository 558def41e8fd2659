"""Helpers of this subpackage: staged tables, column names, words, hashes and sparse linear algebra."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a folder of our own only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="versoline-llm-"))
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Let Spark hand Arrow batches of at most ``size`` (one row, if that is longer) to Python, whatever the rows' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, runs the plan once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, by: str) -> DataFrame:
    """``stage`` in buckets of ``by``, as many as a shuffle has partitions: what groups by it reads them without a shuffle.

    Spark knows buckets of tables only: the table's name is taken back at once, its files stay.
    """
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", shared_folder(spark)).bucketBy(shuffle_partitions(spark), by).saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    spark.sql(f"drop table {name}")
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(column: str = "doc_id") -> F.Column:
    """Every fifth document, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` has about ``limit`` bytes in each; a row is never cut."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Give back what a finished task of this worker still holds: cycles, Arrow's pool, free pages of the C heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """``run`` over batches, with the worker's memory given back when its task ends: workers are used again by later stages."""

    @wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: word number per token, its document, and the distinct words."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for words in split for w in words]
    codes, distinct = pd.factorize(flat)
    return codes.astype(np.int64), np.repeat(np.arange(len(texts)), counts), distinct


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal on every machine."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def hash_words(words, salt: str = "0123456789abcdef") -> np.ndarray:
    """A 64-bit hash per string, equal on every machine."""
    words = np.asarray(words, dtype=object)
    return pd.util.hash_array(words, hash_key=salt, categorize=False) if len(words) else np.zeros(0, U64)


class Sparse:
    """Rows of (feature, value) pairs, for fitting on a bounded sample."""

    def __init__(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n_rows: int, n_features: int):
        self.rows, self.features, self.values, self.shape = rows, features, values.astype(np.float32), (n_rows, n_features)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.features], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.features, self.values * r[self.rows], self.shape[1])

    def squares(self) -> np.ndarray:
        return np.bincount(self.features, self.values**2, self.shape[1])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
