"""Near-duplicate documents by SimHash: a byte-position inverted index with count filtering.

A fingerprint is eight bytes at eight positions. Two fingerprints that differ in at most 4 bits have at
least 4 bytes in common at the same positions. The index files every fingerprint under the bytes it
has at sets of positions; pairs that meet in a posting have their shared positional bytes tallied, those that reach
four are verified bit by bit.

* The postings are triples of positions, chosen so that any four positions contain one of them (``TRIPLES``): every
  pair with four shared bytes meets.
* A posting longer than ``LONGEST`` is refined: its fingerprints are filed again under each fourth position.
* A refined posting that is still too long is dense: its members are linked through midpoints. Two fingerprints
  differ in at most 4 bits exactly if some value lies within 2 bits of both, so linking each member with the values
  within 2 bits of it (over the four bytes that are not fixed) links the same members and makes a fixed number of
  rows for each, never all pairs.

So every member of a posting meets at most ``LONGEST`` others or a fixed number of midpoints: the work grows with the
number of different fingerprints. Copies of a fingerprint are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvage.llm.common import documents, pieces, written
from salvage.llm.components import components

BITS = 4
SHINGLE = 4
LONGEST = 128
_BYTES = 8


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed integer; 0 for a text without words.

    Words are the runs of other characters than ``[\\x20\\x09-\\x0D]``, with A-Z in lower case. A text with fewer
    than ``width`` words has one shingle, all of it. A bit is 1 if it is set in over half of the hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    hashed = xxhash.xxh64_intdigest
    hashes = [hashed(joined[a : b - 1], 42) for a, b in zip(starts, starts[min(width, len(words)) :])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, _BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long, of every document."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            bits = [fingerprint(t, width) for t in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(bits, pa.int64())], names=["doc_id", "bits"]
            )

    return documents(docs).mapInArrow(work, "doc_id long, bits long")


def _triples() -> list[tuple[int, ...]]:
    """Triples of the eight positions of which every four positions contain one.

    The positions are cut into three groups A, B, C in a ring. Taken are the triples inside a group and those with
    two positions in a group and one in the next: four positions either put three into a group, or two into one and
    one or two into the others, and one of those others is next in the ring or has two itself.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    taken = []
    for triple in combinations(range(_BYTES), 3):
        counts = [sum(group[p] == g for p in triple) for g in range(3)]
        if 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
            taken.append(triple)
    return taken


TRIPLES = _triples()


def _mask(positions: Iterable[int]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _postings(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Fingerprints under the bytes they have at each set of positions, with the length of the posting."""
    filed = nodes.select(
        "bits",
        F.explode(
            F.array(*[F.struct(F.lit(_mask(s)).alias("mask"), F.col("bits").bitwiseAND(F.lit(_mask(s))).alias("held")) for s in sets])
        ).alias("key"),
    ).select("bits", "key.mask", "key.held")
    return _measured(filed)


def _measured(filed: DataFrame) -> DataFrame:
    sizes = filed.groupBy("mask", "held").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return filed.join(sizes, ["mask", "held"])


def _shared_bytes(a: Column, b: Column) -> Column:
    """The tally: how many bytes two fingerprints share at the same positions."""
    apart = a.bitwiseXOR(b)
    return reduce(
        lambda x, y: x + y,
        [(apart.bitwiseAND(F.lit(_mask([p]))) == 0).cast("int") for p in range(_BYTES)],
    )


def _pairs(filed: DataFrame) -> DataFrame:
    """Verified links of fingerprints that meet in a posting."""
    left = filed.select("mask", "held", F.col("bits").alias("a"))
    right = filed.select("mask", "held", F.col("bits").alias("b"))
    return (
        left.join(right, ["mask", "held"])
        .where(F.col("a") < F.col("b"))
        .where(_shared_bytes(F.col("a"), F.col("b")) >= _BYTES - BITS)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
        .select("a", "b")
    )


def _midpoints(dense: DataFrame) -> DataFrame:
    """Links of the members of dense postings with the least member near each midpoint."""
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    signed = np.array(flips, np.uint64).view(np.int64)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, mask in zip(batch.column("bits").to_pylist(), batch.column("mask").to_pylist()):
                free = signed[(signed & np.int64(mask)) == 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(free), bits)),
                        pa.array(np.full(len(free), mask)),
                        pa.array(np.int64(bits) ^ free),
                    ],
                    names=["bits", "mask", "mid"],
                )

    near = dense.select("bits", "mask").mapInArrow(work, "bits long, mask long, mid long")
    least = near.groupBy("mask", "mid").agg(F.min("bits").alias("a"), F.max("bits").alias("most")).where("a < most")
    return near.join(least, ["mask", "mid"]).where("a < bits").select("a", F.col("bits").alias("b"))


def links(nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Links ``a < b`` whose closure joins exactly the fingerprints (column ``bits``, different) that differ in at
    most four bits."""
    filed = written(_postings(nodes, TRIPLES), "postings")
    long = filed.where(F.col("size") > longest)
    fourth = F.explode(F.array(*[F.lit(_mask([p])) for p in range(_BYTES)]))
    refined = (
        long.select("bits", F.col("mask").alias("three"), fourth.alias("one"))
        .where(F.col("three").bitwiseAND(F.col("one")) == 0)
        .select("bits", F.col("three").bitwiseOR(F.col("one")).alias("mask"))
        .distinct()
        .select("bits", "mask", F.col("bits").bitwiseAND(F.col("mask")).alias("held"))
    )
    refined = written(_measured(refined), "refined-postings")
    found = [_pairs(filed.where(F.col("size") <= longest)), _pairs(refined.where(F.col("size") <= longest))]
    found.append(_midpoints(refined.where(F.col("size") > longest)))
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, longest: int = LONGEST) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links, the document's own included.
    Null and empty texts have fingerprint zero and are linked like any other; rows with a null id belong to the
    component of their fingerprint, and have a null component if no row with an id does. Repeated rows come back as
    often as they came. No rows, no result rows. Other columns are ignored.
    """
    marked = written(fingerprints(docs, width), "fingerprints")
    nodes = written(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    joined = components(links(nodes, longest))
    rooted = nodes.join(joined.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    # Both written, so that the adaptive join can split a large component.
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id. Columns as they came.

    Documents without an id that share a component with one that has an id go; those of a component without any id
    stay.
    """
    found = near_duplicates(docs, **options)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
