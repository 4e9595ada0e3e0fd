"""Token-id files: documents in ascending order of their ids, entropy-coded sections, read back in parallel."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salvage.llm import rans
from salvage.llm.common import documents, one_array, pieces
from salvage.llm.words import text_encoder, with_end

END_ID = 0
FILES = "part int, seq int, doc_ids array<long>, lengths array<long>, n_tokens long, section binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID) -> None:
    """Encodes every whole text (null: empty), ends each document with ``end``, and writes the ids to ``path``.

    A range shuffle brings the documents into ascending order over the files; null ids come first. A file holds
    sections of about 8 MiB of text or one longer document, each with its own frequency table and the ids and
    lengths of its documents. Texts move once, ids not at all. Spark's writer commits a file whole, so a task that
    runs again leaves no half section behind. Repeated rows are written as often as they come; no rows make empty
    files; other columns are ignored.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = text_encoder(tokenizer, True), TaskContext.get().partitionId()
        for seq, table in enumerate(pieces(batches)):
            ids, lengths = with_end(*encoder(one_array(table.column("text"))), end)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "doc_ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "n_tokens": pa.array([len(ids)], pa.int64()),
                    "section": pa.array([rans.encode(ids)], pa.binary()),
                }
            )

    # The checksum deals equal ids, such as missing ones, over several ranges.
    ordered = documents(docs).repartitionByRange("doc_id", F.crc32(F.col("text").cast("binary"))).sortWithinPartitions("doc_id")
    ordered.mapInArrow(work, FILES).write.mode("errorifexists").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``, all from the decoded sections.

    ``start`` counts the ids of all documents before it: section sizes are summed over files, then inside a file,
    then inside a section, so that no task sees more than a section. Sections are decoded where they are read; only the
    numbers they yield meet the sums. A damaged section fails the task.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths = (batch.column(c)[row].values for c in ("doc_ids", "lengths"))
                lengths = lengths.to_numpy()
                ids = rans.decode(batch.column("section")[row].as_py()).astype("<u4")
                if len(ids) != lengths.sum():
                    raise ValueError("a section does not hold the ids of its documents")
                ends, raw = np.cumsum(lengths), memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": doc_ids,
                        "inside": pa.array(ends - lengths),
                        "n_tokens": pa.array(lengths),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                        "part": pa.array(np.full(len(lengths), batch.column("part")[row].as_py(), np.int32)),
                        "seq": pa.array(np.full(len(lengths), batch.column("seq")[row].as_py(), np.int32)),
                    }
                )

    files = spark.read.schema(FILES).parquet(path)
    sizes = files.select("part", "seq", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    by_file = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    by_file = by_file.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_first"))
    firsts = (
        sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(by_file, "part")
        .select("part", "seq", (F.col("file_first") + F.col("inside")).alias("first"))
    )
    read = files.select("doc_ids", "lengths", "section", "part", "seq").mapInArrow(
        work, "doc_id long, inside long, n_tokens long, ids_crc32 long, part int, seq int"
    )
    return read.join(firsts, ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def decode_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document in the files."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = batch.column("lengths")[row].values.to_numpy()
                ids = rans.decode(batch.column("section")[row].as_py()).astype(np.int64)
                offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.ListArray.from_arrays(offsets, ids)], names=["doc_id", "ids"]
                )

    return spark.read.schema(FILES).parquet(path).mapInArrow(work, "doc_id long, ids array<long>")
