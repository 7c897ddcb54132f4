"""What the operators of this subpackage share: tables, scratch storage, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from ..sources.storage import stored

__all__ = ["Bloom", "WORD", "arrow_map", "chunks_by_bytes", "partitions", "release", "small_batches", "spread", "stored", "table", "text_bytes", "tidy"]

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df`` after Arrow batches of its session were limited to ``rows``, since texts are wide: a worker holds a few MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(key, rows)
    return df


def release() -> None:
    """Gives memory that Arrow and numpy have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and ``release`` at its end: Python workers stay alive between stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and the rows' ends with a leading 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``each`` applied to every Arrow batch, where rows don't depend on one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def chunks_by_bytes(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    start, n = 0, len(ends) - 1
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


class Bloom:
    """Bloom filter over 64-bit integers with a fixed number of bits."""

    SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, bits: int = 1 << 23):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits >> 3, np.uint8)

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for seed in self.SEEDS:
            h = keys.astype(np.int64).view(np.uint64) * np.uint64(seed)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield (h >> np.uint64(17)) & self.mask

    def add(self, keys: np.ndarray) -> None:
        for p in self._places(keys):
            np.bitwise_or.at(self.words, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7))).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for p in self._places(keys):
            hit &= (self.words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit

    def test(self, spark: SparkSession) -> Callable[[Column], Column]:
        """The filter as a function of a long column; other columns of the row don't reach Python."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("boolean")
        def hit(keys: pa.Array) -> pa.Array:
            return pa.array(shared.value.has(keys.to_numpy(zero_copy_only=False)))

        return hit

    @classmethod
    def of(cls, df: DataFrame, column: str, most: int = 1 << 29) -> "Bloom":
        """Built on the executors from a stored table, about 16 bits a key and ``most`` bits (64 MB) at most.

        Only the bits reach the driver, one partial filter after another. A filter at its
        bound lets more through; the exact join behind it drops that.
        """
        bits = 1 << 20
        while bits < min(16 * df.count(), most):
            bits *= 2

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = cls(bits), False
            for b in batches:
                keys = b.column(0).drop_null().to_numpy(zero_copy_only=False)
                if len(keys):
                    own.add(keys)
                    seen = True
            if seen:
                yield pa.record_batch({"bits": pa.array([own.words.tobytes()], pa.binary())})

        spark = df.sparkSession
        parts = df.select(F.col(column).cast("long")).coalesce(min(8, partitions(spark))).mapInArrow(build, "bits binary")
        out = cls(bits)
        for row in parts.toLocalIterator():
            out.words |= np.frombuffer(row.bits, np.uint8)
        return out
