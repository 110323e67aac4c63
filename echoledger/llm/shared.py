"""What the operators share: intermediate tables, Arrow text buffers and word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one vectorised step works on; its temporary arrays take some 60 times as much.
STEP_BYTES = 1 << 19

_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="llm-tables-"))
    return _LOCAL_ROOT[0]


class Tables:
    """Written intermediate tables of one run; a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables whose last reader has ended."""
        for df in tables:
            self.delete(df._written_at)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (double underscores for dots) while eager jobs run; the former ones come back."""
    old = {k.replace("__", "."): None for k in values}
    for k in old:
        old[k] = spark.conf.get(k, None)
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def commonest(counts: DataFrame, most: int, *columns: str) -> list:
    """Rows of the commonest words, `most` at most: all whose count reaches a bound, found from a histogram of counts."""
    histogram = sorted(((r["c"], r["count"]) for r in counts.groupBy("c").count().collect()), reverse=True)
    total, bound = 0, None
    for c, n in histogram:
        total += n
        if total > most:
            break
        bound = c
    return counts.where(F.col("c") >= bound).select(*columns, "c").collect() if bound is not None else []


def documents_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that others, whatever their names, do not meet the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64[n + 1], bytes uint8) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of whole texts, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes between words: ASCII white space.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words that hold letters and digits only: all other ASCII.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 1)
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 21:
            _POWERS[key] = have
    return have[:n]


def words(offsets: np.ndarray, data: np.ndarray, i: int, j: int, between: np.ndarray = SPACES):
    """Words of rows i to j, A-Z lower-cased: (first word of each row int64[j - i + 1], hashes uint64, starts, ends).

    Starts and ends are bytes of `data` from offsets[i] on. A word never crosses a row.
    """
    low, high = int(offsets[i]), int(offsets[j])
    text = LOWER[data[low:high]]
    rows = offsets[i : j + 1] - low
    n = len(text)
    if not n:
        none = np.empty(0, np.int64)
        return np.zeros(j - i + 1, np.int64), np.empty(0, np.uint64), none, none
    inside = ~between[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = rows[:-1][rows[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = rows[1:][rows[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(j - i + 1, np.int64), np.empty(0, np.uint64), starts, ends
    value = _CODES[text] * powers(_BASE, n)
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, starts) * powers(_INVERSE, n)[starts])
    return np.searchsorted(starts, rows), hashes, starts, ends


def word_hash(word: str | bytes) -> int:
    """The hash that words() gives this word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(mix(np.add.reduce(_CODES[LOWER[raw]] * powers(_BASE, len(raw)), keepdims=True))[0])

