"""Shared helpers: Arrow text access, vectorised tokenising and hashing, shared-folder tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.shipping import ship
from locusframe.tables import materialise as materialise
from locusframe.tables import scratch as scratch

#: ASCII white space that ends a word: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one Arrow batch at most: batches of texts or sets stay small in the JVM and in the workers.
BATCH_ROWS = 1024
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: What this worker keeps for the next task of the same operator: one object, by its key.
_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget_but(key: str | None) -> None:
    if key not in _held:
        _held.clear()


def give_back() -> None:
    """Hand freed memory back to the system: workers live on, and would add what each stage once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow with this package at hand in the workers. keeps: the key of what run takes from held()."""
    ship(df.sparkSession)
    if not 0 < int(df.sparkSession.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_ROWS_SETTING, str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_but(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column back to back, and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes: first row, row after the last, bytes, offsets."""
    buf, offs = text_views(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


_TABLES = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(odd)) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_POWERS = [Powers(0x5851F42D4C957F2D), Powers(0x2545F4914F6CDD1D)]


class PrefixHash:
    """Prefix sums of a polynomial in random byte values: the hash of any slice takes two look-ups.

    kind 0 and kind 1 have bases and byte values of their own; together they are 128 bits. Values of
    64 bits (hashes of words) are taken as they stand."""

    def __init__(self, buf: np.ndarray, kind: int = 0) -> None:
        self.powers = _POWERS[kind]
        self.powers.reach(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        values = buf if buf.dtype == np.uint64 else _TABLES[kind][buf]
        np.cumsum(values * self.powers.up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.powers.down[start]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each row (n + 1 values)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Bloom:
    """A bit array of fixed size (8 MB at most on the driver and in each worker) over 64-bit keys."""

    BITS = 26

    def __init__(self, keys: DataFrame, column: str) -> None:
        mask = (1 << self.BITS) - 1
        places = keys.select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, self.BITS).bitwiseAND(mask))).alias("p"))
        rows = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("b")).toArrow()  # 2^20 rows of 12 bytes at most
        words = np.zeros(1 << (self.BITS - 6), np.int64)
        words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(words)
        ship(keys.sparkSession)

    def drop(self) -> None:
        """Free the executors' and the driver's copies, once nothing lazy refers to the test any more."""
        self.shared.destroy()

    def may_have(self, column: str) -> Column:
        shared, bits = self.shared, self.BITS

        @F.pandas_udf("boolean")
        def test(key: pd.Series) -> pd.Series:
            words, k = shared.value, key.to_numpy(np.int64).view(np.uint64)
            out = np.ones(len(k), bool)
            for p in (k & np.uint64((1 << bits) - 1), (k >> np.uint64(bits)) & np.uint64((1 << bits) - 1)):
                out &= (words.view(np.uint64)[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            return pd.Series(out)

        return test(F.col(column))
