"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvage.llm.common import documents, written

# Characters of the normalised text that the second step hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def text_digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text_sha256``, the lowercase hex digest of the normalised text in UTF-8."""
    return documents(docs).select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))


def _shared(members: DataFrame, *keys: str) -> DataFrame:
    """The keys of two members or more."""
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``text_sha256`` (as in ``text_digests``), ``kept``.

    Texts are equal when their normalised forms are; a null text counts as empty. The row with the most characters
    in its original text stays, of several the one with the smallest id.

    Each step only goes on with the documents whose group still has two members or more, and moves nothing but
    numbers: lengths and hashes of prefixes from one scan, then full hashes from a second, computed only for the
    documents that survived both. Groups are reduced to one row and written before they meet their members again: so
    counting starts on the map side, and the adaptive join, which splits only what comes straight from a shuffle, can
    split the rows of a large group.

    ``doc_id`` names a document: repeated rows of one id and text are members each, and stay or go together. Null
    ids are members like others, after all other ids where lengths tie, and are kept where they win. No rows in,
    no rows out; other columns are ignored.
    """
    docs = documents(docs)
    bare = normalised(F.col("text"))
    sizes = written(
        docs.select(
            "doc_id",
            F.length("text").alias("chars"),
            F.octet_length(bare).alias("bytes"),
            F.xxhash64(F.substring(bare, 1, prefix)).alias("head"),
        ),
        "text-sizes",
    )
    same_length = written(_shared(sizes, "bytes"), "shared-lengths")
    by_length = written(sizes.join(same_length, "bytes", "left_semi"), "same-length")
    same_head = written(_shared(by_length, "bytes", "head"), "shared-heads")
    by_head = by_length.join(same_head, ["bytes", "head"], "left_semi")
    survivors = written(by_head.select("doc_id").distinct(), "survivors")

    # Null ids cannot be looked up, so all rows without an id are hashed in full.
    hashed = docs.join(survivors, docs["doc_id"].eqNullSafe(survivors["doc_id"]), "left_semi").select(
        "doc_id",
        F.length("text").alias("chars"),
        F.octet_length(bare).alias("bytes"),
        F.sha2(bare.cast("binary"), 256).alias("hash"),
    )
    hashed = written(hashed, "full-hashes")
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("best")
    groups = written(hashed.groupBy("bytes", "hash").agg(F.count(F.lit(1)).alias("group_size"), best), "groups")
    grouped = hashed.join(groups, ["bytes", "hash"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("hash").alias("text_sha256")
    )
    digests = docs.select("doc_id", F.sha2(bare.cast("binary"), 256).alias("text_sha256"))
    alone = digests.join(survivors, digests["doc_id"].eqNullSafe(survivors["doc_id"]), "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    return grouped.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def without_copies(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The documents that stay, columns as they came. Rows without an id cannot be told apart and stay."""
    gone = exact_groups(docs, prefix).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
