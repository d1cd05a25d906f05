"""What the training-data operators share: scratch tables, byte-level numpy helpers, key mixing."""

from __future__ import annotations

import contextlib
import gc
import uuid
import weakref

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import shared_folder as scratch_root

#: Words: runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Where the result of each table() lies.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(df: DataFrame, name: str, release_shuffles: bool = True) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends at files that outlive executors.

    Spark keeps a finished job's shuffle files until its driver collects garbage, which a driver with little to do hardly
    does; it is asked to here, so that a chain of steps holds one step's files at a time. Steps that move little needn't.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark/{uuid.uuid4().hex}-{name}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    if release_shuffles:
        gc.collect()
        spark._jvm.System.gc()
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table() that no later step reads."""
    discard(df.sparkSession, _paths.pop(df))


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with a column for each of sums {name: column}: the sum of column over the rows before, in that order.

    Rows go to tasks by ranges of the order; the one window over everything has a row a task.
    """
    dealt = table(df.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()), "ranges", release_shuffles=False)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_task").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    starts = totals.select("_task", *[F.coalesce(F.sum(f"_all_{n}").over(before.orderBy("_task")), F.lit(0)).alias(f"_from_{n}") for n in sums])
    own = [(F.coalesce(F.sum(c).over(before.partitionBy("_task").orderBy(*order)), F.lit(0)) + F.col(f"_from_{n}")).alias(n) for n, c in sums.items()]
    return dealt.join(F.broadcast(starts), "_task").select(*[c for c in df.columns], *own)  # as many as shuffle partitions


def bucketed(df: DataFrame, name: str, n: int, column: str, by: str | None = None) -> tuple[DataFrame, str]:
    """(df, path) written in the shared folder in n buckets by column, in folders by the column by.

    Tables that are bucketed alike are grouped and joined by that column without moving them again.
    """
    spark = df.sparkSession
    name = f"tidemark_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/tidemark/{name}"
    writer = df.write.format("parquet").option("path", path).bucketBy(n, column)
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    gc.collect()
    spark._jvm.System.gc()
    return spark.table(name), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete files that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str = "text"):
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def seeded_words(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same in every process."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def release() -> None:
    """Give memory that is free back to the system: workers live on between tasks, and so do their allocators' holdings."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(f):
    """A grouped function of one or two arguments that gives back free memory when it is done."""

    def freeing(*a):
        try:
            return f(*a)
        finally:
            release()

    return (lambda rows: freeing(rows)) if f.__code__.co_argcount == 1 else (lambda key, rows: freeing(key, rows))  # Spark counts arguments


def byte_batches(batches, size_of, most_bytes: int, most_rows: int = 4096):
    """Arrow batches dealt anew: at most most_rows rows and about most_bytes by size_of(batch) (a numpy array) each.

    Rows of several batches come together where they are small, so a batch's size doesn't depend on the session's limits.
    """
    import pyarrow as pa

    held, total, rows = [], 0, 0

    def whole():
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        sizes = np.asarray(size_of(batch), dtype=np.int64)
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if rows and (total + n > most_bytes or rows >= most_rows):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield whole()
                release()
                held, total, rows, start = [], 0, 0, i
            total, rows = total + n, rows + 1
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield whole()
        release()


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_runs(off: np.ndarray, most_bytes: int) -> list[tuple[int, int]]:
    """Runs (first, end) of texts of about most_bytes; a longer text is a run of its own."""
    out, first = [], 0
    while first < len(off) - 1:
        end = max(first + 1, int(np.searchsorted(off, off[first] + most_bytes, side="right")) - 1)
        out.append((first, end))
        first = end
    return out


def pack(x) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=8).compress(bytes(x))


def unpack(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, which compress better."""
    return pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), end to end."""
    total = int(lengths.sum())
    out = np.ones(total, dtype=np.int64)
    full = lengths > 0
    lengths, starts = lengths[full], starts[full]
    if total:
        at = np.cumsum(lengths) - lengths
        out[at] = starts
        out[at[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)
