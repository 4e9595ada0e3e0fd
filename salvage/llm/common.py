"""What the corpus operators share: their view of the documents, written tables, cutting Arrow batches to size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvage.session import scratch_dir

# Bytes of text that a Python worker turns over at once.
PIECE_BYTES = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty); every other column is left behind, whatever its name."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *extra,
    )


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back, so that lost executors cost no more than a read.

    The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES, text: str = "text") -> Iterator[pa.Table]:
    """The batches cut and joined to tables of at most ``limit`` bytes of text, or one longer document."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + (not held), int(np.searchsorted(ends, done + limit - size, "right")))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - done
                start, done = stop, int(ends[stop - 1])
            if start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A column of a table from ``pieces`` as one array."""
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length - 1`` of every pair, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of every string, the same on every machine."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64, n + 1, 8 * strings.offset)
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(4096, _ODD, np.uint64), dtype=np.uint64)
    mixed = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * powers[(np.arange(len(raw)) - np.repeat(starts, sizes)) % 4096]))
    return (mixed[starts + sizes] - mixed[starts]) * _ODD
