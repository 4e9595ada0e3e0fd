"""Ranked lexical search: a K2-treap over the grid of terms and documents, one for each shard of the corpus.

A shard is ``SHARD_BYTES`` of neighbouring text or one longer document. Its tree holds the impact of every term in every document;
weights of terms come from the whole corpus when the tree is asked, so the index serves any items. Items are asked in
blocks of ``BLOCK_BYTES`` of terms: a block goes to every shard, every shard returns the best documents of each item, and the
best of all shards are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salvage.llm.common import documents, pieces, written
from salvage.llm.treap import Treap, build, search

SHARD_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
BEST = 10

# Every byte that is not part of a term becomes a space; A-Z in lower case.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

_INDEX = "shard long, doc_ids array<long>, terms binary, held binary, size long, levels array<long>, masks binary, maxima binary"
_FOUND = "item long, item_id long, doc_id long, score long"


def terms(text: str) -> list[bytes]:
    """The maximal runs of digits, letters and characters beyond ASCII, A-Z in lower case, in UTF-8."""
    return text.encode().translate(_PLAIN).split()


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and that of all their terms with repeats."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(terms(t)) for t in batch.column("text").to_pylist()]
            sums = [len(counts) - counts.count(0), sum(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()) for s in sums], names=["n", "l"])

    sums = documents(docs).mapInArrow(work, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return sums[0] or 0, sums[1] or 0


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], size, "zstd", asbytes=True) if size else b""


def index(docs: DataFrame, size: tuple[int, int] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its documents in the order of their ids, its terms by falling number of documents that hold
    them, these numbers, and the tree of impacts. Written to the shared folder.

    ``size`` is the ``corpus_size`` that impacts are reckoned with, by default that of ``docs``.
    """
    n, total = size or corpus_size(docs)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for table in pieces(batches, shard_bytes):
            table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end"))
            known: dict[bytes, int] = {}
            codes, counts = [], []
            for text in table.column("text").to_pylist():
                own = [known.setdefault(t, len(known)) for t in terms(text)]
                codes.append(np.array(own, np.int64))
                counts.append(len(own))
            yield _shard(shard, table.column("doc_id").to_pylist(), known, codes, counts, n, total)
            shard += 1

    return written(documents(docs).mapInArrow(work, _INDEX), "term-document-grid")


def _shard(
    shard: int, doc_ids: list, known: dict[bytes, int], codes: list[np.ndarray], counts: list[int], n: int, total: int
) -> pa.RecordBatch:
    width = max(1, len(counts))
    doc = np.repeat(np.arange(len(counts)), counts)
    held, times = np.unique(np.concatenate(codes) * width + doc if codes else np.zeros(0, np.int64), return_counts=True)
    term, doc = np.divmod(held, width)
    spread = np.bincount(term, minlength=len(known))
    names = list(known)
    order = sorted(range(len(names)), key=lambda i: (-spread[i], names[i]))
    row = np.empty(len(names), np.int64)
    row[order] = np.arange(len(names))
    length = np.array([10 + 90 * c * n // max(1, total) for c in counts], np.int64)
    impacts = 1_000_000_000 * times // (1000 * times + 8 * length[doc])
    there = impacts > 0
    levels, masks, maxima = build(row[term[there]], doc[there], impacts[there], max(1, len(names)), width)
    values = [
        shard, doc_ids, _packed(b" ".join(names[i] for i in order)), _packed(spread[order].astype("<i4").tobytes()), len(names),
        levels, _packed(masks), _packed(maxima),
    ]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])


def _rows_of(wanted: pa.Array, row: dict) -> np.ndarray:
    """The shard's row of every wanted term, -1 for terms it does not hold."""
    names = pa.array(_unpacked(row["terms"]).split(), pa.binary())
    return pc.index_in(wanted, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def holders(grid: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the wanted terms; terms of no document are left out."""
    asked = pa.array(wanted, pa.binary())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = _rows_of(asked, row)
                here = np.flatnonzero(rows >= 0)
                held = np.frombuffer(_unpacked(row["held"]), "<i4")[rows[here]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(held)], names=["term", "held"])

    counted = grid.select("terms", "held").mapInArrow(work, "term long, held long").groupBy("term").agg(F.sum("held").alias("n"))
    # At most one row for each term of a block.
    return {wanted[r.term]: r.n for r in counted.collect()}


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items by their ids, with the different terms of all texts of an id, in blocks."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for item_id, own in groupby(rows.orderBy("item_id").toLocalIterator(), key=lambda r: r.item_id):
        found = sorted({t for r in own for t in terms(r.text or "")})
        block.append((item_id, found))
        size += sum(map(len, found))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _asked(grid: DataFrame, block: list[tuple[int | None, list[bytes]]], n: int, best: int) -> DataFrame:
    """The best documents of every item of a block in every shard."""
    wanted = sorted({t for _, own in block for t in own})
    held = holders(grid, wanted)
    wanted = [t for t in wanted if t in held]
    place = {t: i for i, t in enumerate(wanted)}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) for t in wanted], np.int64)
    items = [(item_id, np.array([place[t] for t in own if t in place], np.int64)) for item_id, own in block]
    asked = pa.array(wanted, pa.binary())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                rows = _rows_of(asked, row)
                own = [t[rows[t] >= 0] for _, t in items]
                tree = Treap(row["levels"], _unpacked(row["masks"]), _unpacked(row["maxima"]))
                found = search(tree, [(rows[t], weights[t]) for t in own], best)
                lines = [
                    (i, items[i][0], row["doc_ids"][column], -score) for i, top in enumerate(found) for score, column in top
                ]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*lines)], names=["item", "item_id", "doc_id", "score"])

    return grid.mapInArrow(work, _FOUND)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of every item with a score above 0, the highest first.

    Equal scores go by ascending ``doc_id``, a null id last. A null or empty text has no terms; documents without a term
    are not counted, items without one have no rows. Repeated rows are documents of their own; the rows of one
    ``item_id``, null included, are one item with the terms of all. No documents or no items, no result rows. Whole texts count,
    however long; other columns are ignored.
    """
    size = corpus_size(docs)
    grid = index(docs, size, shard_bytes)
    schema = "item_id long, rank int, doc_id long, score long"
    result = None
    for block in _blocks(items, block_bytes):
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = _asked(grid, block, size[0], best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        found = written(found.select("item_id", "rank", "doc_id", "score"), "ranked-items")
        result = found if result is None else result.union(found)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result
