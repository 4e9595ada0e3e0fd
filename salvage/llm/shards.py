"""Shards by jump consistent hashing: the key and the number of shards decide, without a ring table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salvage.llm.common import documents, written

SHARDS = 16

# Fixed values of the published algorithm: the multiplier of its generator.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once: jumps go on until they leave the range."""
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(open_):
            state[open_] = state[open_] * _MULTIPLIER + np.uint64(1)
            step = (at[open_] + 1) * (2.0**31 / ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
            stays = step < shards
            open_ = open_[stays]
            at[open_] = step[stays].astype(np.int64)
    return at


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``shard`` and ``grown_shard`` (with one shard more) follow from ``doc_id`` and the number of shards alone, so
    that adding a shard moves only the rows which that shard takes. ``slot`` numbers the rows of a shard without gaps
    from 0: every input partition counts its rows of each shard, the sums of the counts before it give its
    first slot, and rows are ranked inside the partition by id, checksum and size. So nothing is gathered per shard,
    and a repeated key spreads over the partitions it came in.

    Null texts have size 1 and the checksum of nothing. Null ids are keyed as 0. Repeated rows get a slot each. No
    rows, no result; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            shard = [pa.array(jump(keys, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *shard], names=[*batch.schema.names, "shard", "grown_shard"])

    text = F.col("text").cast("binary")
    rows = documents(docs).select(
        "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = rows.mapInArrow(work, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    placed = written(placed.withColumn("part", F.spark_partition_id()), "sharded")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(first, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).alias("slot"), "grown_shard"
    )
