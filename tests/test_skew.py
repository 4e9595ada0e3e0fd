import pytest
from pyspark.sql import functions as F

from salvage.operators.scope import select_objects, selected_names
from salvage.operators.skew import hot_keys, lookup_join


@pytest.fixture(scope="module")
def rows(spark):
    third = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 40))
    return spark.range(0, 6000, 1, 16).select(third.alias("k"), (F.col("id") % 7).alias("v"))


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("unused", 4), (None, 5)], "k string, w int")


def hashes(hot):
    return {r["hash"] for r in hot.collect()}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(no_broadcast, rows, names, how):
    got = sorted(map(str, lookup_join(rows, names, ["k"], how).collect()))
    want = sorted(map(str, rows.join(names, ["k"], how).collect()))
    assert got == want and got


def test_two_key_columns(no_broadcast, rows, names):
    left = rows.withColumn("w", (F.col("v") % 2 + 1).cast("int"))
    got = sorted(map(str, lookup_join(left, names, ["k", "w"], "left_semi").collect()))
    assert got == sorted(map(str, left.join(names, ["k", "w"], "left_semi").collect())) and got


def test_empty_sides(no_broadcast, rows, names):
    assert lookup_join(rows.where("v < 0"), names, ["k"]).count() == 0
    assert lookup_join(rows, names.where("w < 0"), ["k"]).count() == 6000


def test_hot_keys_are_found_and_spread(no_broadcast, rows, names):
    hot = hashes(hot_keys(rows, ["k"]))
    assert rows.select(F.xxhash64(F.lit("hot")).alias("h")).first()["h"] in hot and len(hot) <= 100
    joined = lookup_join(rows, names, ["k"], "left")
    sizes = joined.groupBy(F.spark_partition_id(), "k").count().where("k = 'hot'").collect()
    assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 2000
    missing = joined.groupBy(F.spark_partition_id(), "k").count().where("k IS NULL").collect()
    assert len(missing) > 4


def test_hot_keys_of_two_joins_are_found_in_one_pass(no_broadcast, rows):
    left = rows.withColumn("w", F.when(F.col("v") < 5, F.lit("also")))
    hot = hot_keys(left, ["k"], ["w"])
    found = hashes(hot)
    assert None not in found
    for name in ("hot", "also"):
        assert left.select(F.xxhash64(F.lit(name)).alias("h")).first()["h"] in found
    assert hot._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1


def test_shares_follow_the_shuffle_partitions(no_broadcast, rows):
    # A key just above and just below one share of the rows.
    left = rows.where("k = 'k1' OR v < 2")
    key = left.select(F.xxhash64(F.lit("k1")).alias("h")).first()["h"]
    share = left.where("k = 'k1'").count() / left.count()
    assert key not in hashes(hot_keys(left, ["k"], shares=int(0.9 / share)))
    assert key in hashes(hot_keys(left, ["k"], shares=int(1.2 / share) + 1))


def test_parts_follow_the_share_of_a_key(no_broadcast, rows, names):
    left = rows.where("k = 'hot' OR v < 3")
    n = left.count()
    found = {r["hash"]: r["parts"] for r in hot_keys(left, ["k"], salts=1000).collect()}
    sizes = {r["h"]: r["count"] for r in left.groupBy(F.xxhash64("k").alias("h"), "k").count().where("k IS NOT NULL").collect()}
    assert found and all(abs(parts - sizes[h] * 1000 / n) <= 1 for h, parts in found.items())
    assert sum(found.values()) <= 1000 + len(found)
    # A right row is copied once for each part of its key.
    no_broadcast.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        parts = {r["hash"]: r["parts"] for r in hot_keys(left, ["k"]).collect()}
        joined = lookup_join(left, names, ["k"], "right").where("k = 'hot'")
        copies = joined.where("v IS NULL").count() + joined.where("v IS NOT NULL").select(F.spark_partition_id()).distinct().count()
        assert copies <= parts[left.select(F.xxhash64(F.lit("hot")).alias("h")).first()["h"]]
    finally:
        no_broadcast.conf.set("spark.sql.shuffle.partitions", "8")


def test_more_shuffle_partitions_than_sketches_tell_apart(no_broadcast, rows, names):
    no_broadcast.conf.set("spark.sql.shuffle.partitions", "200000")
    try:
        joined = lookup_join(rows, names, ["k"])
        assert "200000" in joined._jdf.queryExecution().executedPlan().toString()
        hot = hot_keys(rows, ["k"])
        no_broadcast.conf.set("spark.sql.shuffle.partitions", "8")
        parts = hot.where(F.col("hash") == F.xxhash64(F.lit("hot"))).first()["parts"]
        assert abs(parts - 200_000 / 3) < 1000
    finally:
        no_broadcast.conf.set("spark.sql.shuffle.partitions", "8")


def test_names_on_the_driver_are_tested_alike(spark):
    names = ["a", "B", "c"]
    frame = spark.createDataFrame([("a",), ("b",), ("a",)], "n string")
    assert selected_names(spark, names, frame) == {"a"} == selected_names(spark, names, ["a", "b"])
    assert selected_names(spark, names, None) == set(names)


def test_selection_by_frame_equals_selection_by_list(no_broadcast, rows):
    wanted = ["hot", "k1", "nowhere"]
    frame = no_broadcast.createDataFrame([(n,) for n in [*wanted, "hot"]], "anything string")
    got = sorted(map(str, select_objects(rows, frame, "k").collect()))
    assert got == sorted(map(str, select_objects(rows, wanted, "k").collect())) and got
    assert select_objects(rows, None, "k") is rows and select_objects(rows, [], "k") is rows
    assert select_objects(rows, frame.where("false"), "k") is rows
    assert selected_names(no_broadcast, ["a", "b"], frame.where("false")) == {"a", "b"} == selected_names(no_broadcast, ["a", "b"], [])
