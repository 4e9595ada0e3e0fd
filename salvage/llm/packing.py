"""Packing by lexical retrieval: windows are filled with the documents most like the one that opens them."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvage.llm.common import documents, one_array, pieces, ragged
from salvage.llm.words import text_encoder, with_end

WINDOW = 2048
END_ID = 1
K1, B = 1.2, 0.75
# Terms in more than this share of a shard's documents are kept as a row of weights, all others as postings.
COMMON = 1 / 4

PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Index:
    """A BM25 inverted index over the documents of one shard, with token ids as terms.

    It holds every term of two documents or more. Rows of common terms take at most ``1 / common`` times the room of their
    postings and are summed without looking anything up.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, common: float = COMMON) -> None:
        docs = len(counts)
        width = int(ids.max()) + 1 if len(ids) else 1
        keys = np.sort(np.repeat(np.arange(docs, dtype=np.int64), counts) * width + ids)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(keys)))
        doc, term = np.divmod(keys[new], width)
        spread = np.bincount(term, minlength=width)
        used = spread[term] > 1
        doc, term, times = doc[used], term[used], times[used]
        self.terms = term
        self.term_starts = np.searchsorted(doc, np.arange(docs + 1))
        idf = np.log1p((docs - spread + 0.5) / (spread + 0.5))
        longer = 1 - B + B * counts / max(1.0, counts.mean() if docs else 1.0)
        weights = idf[term] * times * (K1 + 1) / (times + K1 * longer[doc])
        hot = np.flatnonzero((spread > 1) & (spread > common * docs))
        self.row = np.full(width, -1)
        self.row[hot] = np.arange(len(hot))
        self.rows = np.zeros((len(hot), docs))
        whole = self.row[term] >= 0
        self.rows[self.row[term[whole]], doc[whole]] = weights[whole]
        doc, term, weights = doc[~whole], term[~whole], weights[~whole]
        order = np.argsort(term, kind="stable")
        self.posted = doc[order]
        self.posting_starts = np.searchsorted(term[order], np.arange(width + 1))
        self.weights = weights[order]
        self.docs = docs

    def scores(self, seed: int) -> np.ndarray:
        """The score of every document for the terms of ``seed``."""
        terms = self.terms[self.term_starts[seed] : self.term_starts[seed + 1]]
        starts = self.posting_starts[terms]
        at = ragged(starts, self.posting_starts[terms + 1] - starts)
        rows = self.row[terms]
        asked = np.zeros(len(self.rows))
        asked[rows[rows >= 0]] = 1
        return np.bincount(self.posted[at], self.weights[at], self.docs) + asked @ self.rows


def pack_shard(ids: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)``.

    A seed document opens a window; its unused neighbours follow, best score first (ties: the earlier document), then
    unused documents in their order once none shares a term. What does not fit is cut, and the rest seeds the next
    window. Only the last window of a shard may stay short.
    """
    index, sizes = Index(ids, counts), counts.tolist()
    unused = np.ones(len(sizes), bool)
    pieces_, sequence, offset, following = [], 0, 0, 0
    ranked: list[int] = []
    doc, start = -1, 0
    while True:
        if doc < 0:  # the next document for the open window, or a seed if there is none
            while ranked and not unused[ranked[-1]]:
                ranked.pop()
            if ranked:
                doc = ranked.pop()
            else:
                while following < len(sizes) and not unused[following]:
                    following += 1
                if following == len(sizes):
                    return pieces_
                doc = following
            unused[doc], start = False, 0
        length = min(sizes[doc] - start, window - offset)
        pieces_.append((doc, start, length, sequence, offset))
        start, offset = start + length, offset + length
        if start == sizes[doc]:
            if not ranked and offset < window:  # else nothing follows in this window
                scores = index.scores(doc)
                scores[~unused] = 0
                near = np.flatnonzero(scores)
                # Best last; only as many as could still be needed before the next seed.
                best = near[np.argsort(-scores[near], kind="stable")] if len(near) <= 64 else _top(scores, near, 64)
                ranked = best[::-1].tolist()
            doc = -1
        if offset == window:
            sequence, offset, ranked = sequence + 1, 0, []


def _top(scores: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best of ``near``; when they are used up the window asks again with its latest document."""
    least = np.partition(scores[near], len(near) - k)[len(near) - k]
    top = near[scores[near] >= least]
    return top[np.argsort(-scores[top], kind="stable")]


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Shards are made where the documents lie, of about 8 MiB of text or one longer document; each has its own
    inverted index, and nothing is shuffled. A sequence never leaves its shard: at most one window in a thousand or so
    is short. ``sequence_id`` is the input partition times 2^32 plus a count.

    Every id is in exactly one piece; pieces of a sequence follow each other without gaps. A null or empty text is its
    end id alone. Repeated rows are packed as often as they come, null ids like others. No rows, no pieces; other columns
    are ignored.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, first = text_encoder(tokenizer, False), TaskContext.get().partitionId() << 32
        for table in pieces(batches):
            ids, counts = with_end(*encoder(one_array(table.column("text"))), end)
            placed = np.array(pack_shard(ids, counts, window), np.int64).reshape(-1, 5)
            doc, start, length, sequence, offset = placed.T
            begins = (np.cumsum(counts) - counts)[doc] + start
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    one_array(table.column("doc_id")).take(pa.array(doc)),
                    pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                    pa.array(counts[doc]), pa.array(sequence + first), pa.array(offset),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            first += int(sequence.max()) + 1 if len(sequence) else 0

    return documents(docs).mapInArrow(work, PACKED)


def fill(packed_: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, ids and padding of a packing."""
    by_sequence = packed_.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return by_sequence.agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("ids"), F.sum(window - F.col("n")).alias("padding")
    )
