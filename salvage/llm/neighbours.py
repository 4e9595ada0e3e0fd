"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and assigned to
the nearest signed axis. Several tables with rotations of their own hold every vector under its axis; a query probes
the axes nearest to it in every table, and what it meets there is ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salvage.llm.common import written

NEIGHBOURS = 20
TABLES = 10
PROBES = 14
DEPTH = 1
SEED = 7
# Members of a bucket that one task compares with the bucket's queries; larger buckets are split.
BUCKET_ROWS = 4096
_ROUNDS = 3


class CrossPolytope:
    """Hash functions of all tables for one dimension, the same on every machine."""

    def __init__(self, dim: int, tables: int = TABLES, depth: int = DEPTH, seed: int = SEED) -> None:
        self.dim, self.tables, self.depth = dim, tables, depth
        self.width = 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice((-1.0, 1.0), (tables, depth, _ROUNDS, self.width))
        self.buckets = (2 * self.width) ** depth

    def _axes(self, vectors: np.ndarray, table: int, part: int) -> np.ndarray:
        """How near every signed axis is to each vector: the rotated components, then their negatives."""
        turned = np.zeros((len(vectors), self.width))
        turned[:, : self.dim] = vectors
        for signs in self.signs[table, part]:
            turned *= signs
            turned = hadamard(turned)
        return np.concatenate((turned, -turned), axis=1)

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector."""
        found = np.zeros(len(vectors), np.int64)
        for part in range(self.depth):
            found = found * 2 * self.width + self._axes(vectors, table, part).argmax(axis=1)
        return found

    def probes(self, vectors: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` nearest buckets of each vector, nearest first."""
        nearness, codes = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), np.int64)
        for part in range(self.depth):
            axes = self._axes(vectors, table, part)
            keep = np.argsort(-axes, axis=1, kind="stable")[:, : min(count, axes.shape[1])]
            nearness = (nearness[:, :, None] + np.take_along_axis(axes, keep, 1)[:, None, :]).reshape(len(vectors), -1)
            codes = (codes[:, :, None] * 2 * self.width + keep[:, None, :]).reshape(len(vectors), -1)
            best = np.argsort(-nearness, axis=1, kind="stable")[:, :count]
            nearness, codes = np.take_along_axis(nearness, best, 1), np.take_along_axis(codes, best, 1)
        return codes


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Hadamard transform of every row, scaled so that lengths stay; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def nearest(
    embeddings: DataFrame,
    k: int = NEIGHBOURS,
    every: int = 20,
    tables: int = TABLES,
    probes: int = PROBES,
    depth: int = DEPTH,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose ``vec_id`` is divisible by ``every``.

    Candidates are all rows but the query's own; ``score`` is the inner product of the original vectors in double
    precision, ties go to the smaller id. Vectors that are null, zero, or hold a null or infinite component take no
    part, nor do those without an id or of another length than most: no inner product is defined for them. Repeated rows of one id and
    vector count once. No usable rows, no result; other columns are ignored.

    Equal vectors are one node of the index: only the ``k + 1`` smallest ids of each can be among anyone's nearest, so
    no others are carried along, and queries with equal vectors are searched once. Buckets over ``bucket_rows`` members
    are split, and their queries copied to every part; each part passes on its best ``k + 1`` only. A query that meets
    no more than ``k`` nodes is compared with all of them, so small tables are searched exactly. The vectors a query meets are a fixed share of all rows for given parameters; ``depth`` 2 squares the number of
    buckets for larger tables. Vectors are expected to be of similar length, as embeddings are: the hash sees their
    direction only.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    dim = common["dim"]
    rows = rows.where(F.size("vector") == dim).withColumn("hash", F.xxhash64("vector"))

    # Copies are thinned out where they lie before they are brought together.
    def thinned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for batch in batches:
            order = pc.sort_indices(batch.column("vec_id"))
            hashes, ids = batch.column("hash").to_numpy(), batch.column("vec_id").to_numpy()
            if len(seen) > 1 << 18:
                seen.clear()
            keep = []
            for i in order.to_pylist():
                held = seen.setdefault(int(hashes[i]), [])
                if len(held) <= k or ids[i] < held[-1]:
                    held.append(int(ids[i]))
                    held.sort()
                    del held[k + 1 :]
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    copies = rows.select("vec_id", "hash", "vector").mapInArrow(thinned, rows.select("vec_id", "hash", "vector").schema)
    same = Window.partitionBy("hash", "vector").orderBy("vec_id")
    members = copies.dropDuplicates(["hash", "vector", "vec_id"]).select(
        "*", F.row_number().over(same).alias("place"), F.min("vec_id").over(same).alias("node")
    )
    members = written(members.where(F.col("place") <= k + 1), "vector-members")
    nodes = members.where("place = 1").select("node", "vector")
    # Every query's node: its vector's smallest id.
    asking = written(
        rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "hash", "vector").distinct()
        .join(members.where("place = 1").select("hash", "vector", "node"), ["hash", "vector"])
        .select("query_id", "node", "vector"),
        "vector-queries",
    )
    queries = asking.select("node", "vector").dropDuplicates(["node"])

    polytope = CrossPolytope(dim, tables, depth)

    def filed(probing: int):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    unit = _unit(_matrix(part.column("vector")))
                    for table in range(tables):
                        codes = polytope.probes(unit, table, probing) if probing else polytope.bucket(unit, table)[:, None]
                        row = np.repeat(np.arange(len(part)), codes.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("node").take(pa.array(row)),
                                part.column("vector").take(pa.array(row)),
                                pa.array(np.full(len(row), table, np.int32)),
                                pa.array(codes.reshape(-1)),
                            ],
                            names=["node", "vector", "tbl", "bucket"],
                        )

        return work

    kind = nodes.schema["vector"].dataType.simpleString()
    schema = f"node long, vector {kind}, tbl int, bucket long"
    index = nodes.select("node", "vector").mapInArrow(filed(0), schema)
    asked = queries.select("node", "vector").mapInArrow(filed(probes), schema)
    # At most tables x buckets rows.
    parts = index.groupBy("tbl", "bucket").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("parts"))
    parts = written(parts, "bucket-parts")
    index = index.join(parts, ["tbl", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    asked = asked.join(parts, ["tbl", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["tbl", "bucket", "part"]

    def compared(queries_: pa.Table, members_: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries_.num_rows or not members_.num_rows:
            return empty
        members_ = members_.sort_by("node").combine_chunks()
        node, there = members_.column("node").to_numpy(), _matrix(members_.column("vector").combine_chunks())
        found = [empty]
        for at in range(0, queries_.num_rows, 256):
            some = queries_.slice(at, 256).combine_chunks()
            scores = _matrix(some.column("vector").combine_chunks()) @ there.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            found.append(
                pa.table(
                    {
                        "query": np.repeat(some.column("node").to_numpy(), best.shape[1]),
                        "node": node[best].reshape(-1),
                        "score": np.take_along_axis(scores, best, 1).reshape(-1),
                    }
                )
            )
        return pa.concat_tables(found)

    def best_met(asked_: DataFrame, index_: DataFrame, *group_: str) -> DataFrame:
        met = (
            asked_.select("node", "vector", *group_).groupBy(*group_)
            .cogroup(index_.select("node", "vector", *group_).groupBy(*group_))
            .applyInArrow(compared, "query long, node long, score double")
        )
        by_query = Window.partitionBy("query").orderBy(F.desc("score"), "node")
        met = met.groupBy("query", "node").agg(F.max("score").alias("score"))
        return met.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1).drop("place")

    best = written(best_met(asked, index, *group), "nearest-nodes")
    # Queries whose buckets hold too few nodes, as in small tables, are compared with all nodes, block by block.
    met = best.groupBy(F.col("query").alias("node")).agg(F.count(F.lit(1)).alias("met"))
    short = queries.join(met, "node", "left").where(F.coalesce("met", F.lit(0)) < k + 1).select("node", "vector")
    short = written(short, "short-queries")
    n_short = short.count()
    if n_short:
        blocks, shares = -(-n_short // bucket_rows), -(-nodes.count() // bucket_rows)
        block, share = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("node"), F.lit(shares)).cast("int")
        every_share, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (shares, blocks))
        exact = best_met(
            short.withColumn("block", block).withColumn("share", every_share),
            nodes.withColumn("share", share).withColumn("block", every_block), "block", "share",
        )
        others = best.join(short.select(F.col("node").alias("query")), "query", "left_anti")
        best = written(others.unionByName(exact), "completed-nodes")
    spread = best.join(members.select("node", "vec_id"), "node").select(F.col("query").alias("node"), "vec_id", "score")
    answers = asking.select("query_id", "node").join(spread, "node").where("query_id <> vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
