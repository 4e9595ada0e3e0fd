from types import SimpleNamespace

import pytest

from salvage.functions.text import redact_secrets
from salvage.functions.values import normalize_values
from salvage.operators import corpus
from salvage.session import scratch_dir
from salvage.streaming.corpus_stream import stream_queries, write_query_models

SCHEMA = "query_id bigint, name string, sql string"
ROWS = [(1, "Été", "SELECT a FROM [T 1]"), (2, "b", None), (3, "c", "UPDATE x SET pwd=1;")]


def test_models_on_arrival_once_each(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(source)
    for more in ([], [(4, "d", "drop table y")]):
        if more:
            spark.createDataFrame(more, SCHEMA).write.mode("append").parquet(source)
        write_query_models(stream_queries(spark, source, SCHEMA), out, progress, ("query_id",)).awaitTermination()
    got = {r["query_id"]: (r["slug"], r["type"], r["dependencies"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: ("été", "select", ["T 1"]), 2: ("b", "unknown", []), 3: ("c", "update", ["x SET pwd"]), 4: ("d", "ddl", []),
    }


@pytest.mark.parametrize(
    "operator",
    [
        corpus.classify_queries, corpus.dialect_warnings, corpus.query_dependencies, corpus.dependency_edges,
        corpus.translate_queries, normalize_values, lambda df: redact_secrets(df, ["sql"]),
    ],
)
def test_stateless_operators_take_a_stream_unchanged(spark, tmp_path, operator):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame(ROWS, SCHEMA)
    batch.write.parquet(source)
    streamed = operator(stream_queries(spark, source, SCHEMA))
    streamed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, operator(batch).collect()))


def test_scratch_follows_the_cluster_setting(spark):
    def session(master, **conf):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    named = session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/"})
    assert scratch_dir(named, "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session("yarn"), "x")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
