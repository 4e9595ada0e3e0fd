"""Lookup joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot, and its rows are spread, if it fills more than one shuffle partition's share of the rows; with fewer
# partitions than these, if it holds more than one percent, over parts of a 64th.
LEAST_SHARES, LEAST_SALTS = 100, 64
# More shares than these are not told apart: the sketches' size has a limit, which is ten times as much.
MOST_SHARES = 100_000

# Keys a frequency sketch tracks for each share it looks for, so that its error is well below a share.
_TRACKED_PER_SHARE = 10
# Sketches are merged in this many tasks before the last merge, which then has a fixed size.
_MERGES = 512
_HASH, _SALT, _PARTS = "_hash", "_salt", "_parts"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _hashed(keys: list[str]) -> Column:
    """The hash of a key; null if part of it is missing."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return F.when(present, F.xxhash64(*keys))


def hot_keys(df: DataFrame, *key_sets: list[str], shares: int | None = None, salts: int | None = None) -> DataFrame:
    """``hash`` and ``parts`` of the keys that hold more than one of ``shares`` equal shares of the rows.

    ``shares`` is the number of shuffle partitions (100 at least, ``MOST_SHARES`` at most), so that a key which is not found
    fills about an ordinary partition. ``parts`` says over how many of ``salts`` partitions (as many as shuffle partitions, 64 at
    least) a key's estimated share of the rows would lie if it were spread evenly: all parts together are at most ``salts`` and
    one for each key. Several ``key_sets``, for joins that follow each other, are looked at in one pass and found together:
    a key hot in one of them is spread in all.

    Every task reduces its keys to small frequency sketches, so finding the hot keys moves no keys around.
    The sketch is an estimate. It only says which keys ``lookup_join`` spreads; the result never depends
    on it.
    """
    shares = min(shares or max(LEAST_SHARES, _partitions(df)), MOST_SHARES)
    salts = salts or max(LEAST_SALTS, _partitions(df))
    tracked = F.lit(_TRACKED_PER_SHARE * shares)
    names = [f"{_HASH}{i}" for i in range(len(key_sets))]
    rows = df.select(*[_hashed(keys).alias(name) for name, keys in zip(names, key_sets)])
    by_task = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(_MERGES)).alias("_merge")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.call_function("approx_top_k_accumulate", F.col(name), tracked).alias(name) for name in names],
    )
    whole = by_task.groupBy(F.lit(0).alias("_all")).agg(
        F.sum("_n").alias("_n"),
        *[F.call_function("approx_top_k_combine", F.col(name), tracked).alias(name) for name in names],
    )
    tops = [F.call_function("approx_top_k_estimate", F.col(name), F.lit(shares)) for name in names]
    found = whole.select("_n", F.explode(F.concat(*tops)).alias("top")).where(
        F.col("top.item").isNotNull() & (F.col("top.count") * shares > F.col("_n"))
    )
    parts = F.greatest(F.ceil(F.col("top.count") * salts / F.col("_n")).cast("int"), F.lit(2))
    found = found.select(F.col("top.item").alias("hash"), parts.alias("parts"))
    # A key of several sets is there several times, but must meet a row once.
    return found if len(names) == 1 else found.groupBy("hash").agg(F.max("parts").alias("parts"))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on ``keys``, spreading the rows of hot left keys over as many parts as they fill.

    The salt is the number of the input partition, so a task that is run again picks the same one
    whatever order its rows come in, and even exact copies of a row are spread. Only right rows of hot
    keys are copied, once for each part of their key. Left rows with a missing key match nothing and are spread in the same way
    instead of meeting in one task. Which side is broadcast, if any, is left to its size; only the list of hot keys, at
    most ``MOST_SHARES`` pairs of numbers for each key set, goes to every task.

    ``hot`` hands in ``hot_keys`` where they can be had more cheaply than from ``left`` itself.
    """
    if hot is None:
        hot = hot_keys(left, keys)
    marks = F.broadcast(hot.select(F.col("hash").alias(_HASH), F.col("parts").alias(_PARTS)))
    salts, here = max(LEAST_SALTS, _partitions(left)), F.spark_partition_id()
    salt = F.when(F.col(_HASH).isNull(), F.pmod(here, F.lit(salts))).otherwise(F.pmod(here, F.coalesce(_PARTS, F.lit(1))))
    marked = left.withColumn(_HASH, _hashed(keys)).join(marks, _HASH, "left")
    salted_left = marked.withColumn(_SALT, salt).select(*[F.col(f"`{c}`") for c in left.columns], _SALT)
    copies = F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1)
    salted_right = right.withColumn(_HASH, _hashed(keys)).join(marks, _HASH, "left").withColumn(_SALT, F.explode(copies))
    salted_right = salted_right.select(*[F.col(f"`{c}`") for c in right.columns], _SALT)
    return salted_left.join(salted_right, [*keys, _SALT], how).drop(_SALT)
