"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; long texts make Spark's default of 10,000 rows too large.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a temporary
    folder is made, and set, in local mode alone: elsewhere each machine would have its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back, cutting lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub(r'[^A-Za-z0-9]+', '-', tag)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what :func:`materialise` wrote, once everything that reads it has been written itself."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches, for this session from here on; a row that is larger by itself is a batch alone."""
    units = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
        if not 0 < int(number) << units[unit] <= most:
            spark.conf.set(key, str(most))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches; what it freed goes back to the system at its end, as the worker lives on through other tasks and operators."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
            if trim:
                trim(0)

    return whole


def partitions(df: DataFrame, each: int = 16 << 20) -> int:
    """Shuffle partitions for what a table read from files gives: one for every ``each`` bytes of it, the session's number at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(size // each, 200_000)) if size < 1 << 55 else least  # beyond that, nothing is known


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Bits for each id of a filter, and bits of the largest one (32 MB, 16 million ids): more ids get none.
FILTER_EACH, FILTER_MOST = 16, 1 << 28


def id_filter(ids: DataFrame, column: str) -> np.ndarray | None:
    """A Bloom filter (two bits an id, from either half) of a hashed id column, as 64-bit words, sized by the ids' number.

    What passes it wrongly finds nothing in the join that follows.  None beyond ``FILTER_MOST``: everything passes then,
    which costs a shuffle of all rows and changes no result.
    """
    n = ids.count()
    if n * FILTER_EACH > FILTER_MOST:
        return None
    bits = max(1 << 16, 1 << (n * FILTER_EACH - 1).bit_length())
    at = F.explode(F.expr(f"array({column} & {bits - 1}L, shiftrightunsigned({column}, 32) & {bits - 1}L)"))
    words = ids.select(at.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toPandas()  # at most FILTER_MOST / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def in_filter(words: np.ndarray | None, hashed: np.ndarray) -> np.ndarray:
    if words is None:
        return np.ones(len(hashed), bool)
    last = np.uint64(64 * len(words) - 1)
    h = hashed.view(np.uint64)
    hit = np.ones(len(h), bool)
    for at in (h & last, (h >> np.uint64(32)) & last):
        at = at.astype(np.int64)
        hit &= (words[at >> 6] >> (at & 63)) & 1 == 1
    return hit


def passing(df: DataFrame, words: np.ndarray | None, hashed: Column) -> Column:
    """Whether a row's hashed id may be among those of the filter."""
    if words is None:
        return F.lit(True)
    sent = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def found(at):
        import pandas as pd

        return pd.Series(in_filter(sent.value, at.to_numpy(np.int64)))

    return found(hashed)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; one long row is a range alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each start and length."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
