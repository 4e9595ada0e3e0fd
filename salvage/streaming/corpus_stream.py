"""Query texts as they arrive.

The corpus operators keep no state between rows, so they take a streaming DataFrame as it is; this adds
only the source and the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from salvage.operators.corpus import query_models


def stream_queries(spark: SparkSession, path: str, schema: str, source: str = "parquet") -> DataFrame:
    """New files of saved queries below ``path``."""
    return spark.readStream.format(source).schema(schema).load(path)


def write_query_models(
    queries: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ()
) -> StreamingQuery:
    """The model of every query that is there or has arrived since the last run, then stop.

    ``checkpoint`` belongs in storage that outlives the executors; with it each file is written once.
    """
    return (
        query_models(queries, keys)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
