"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import cache, reduce
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

PARALLEL_JOBS = 8


def build_session(app_name: str = "salvage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Times are rendered in UTC and adaptive execution is on, so that shuffle partitions are sized and
    skewed join partitions split at run time. Settings in ``conf`` win over these.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="salvage-", ignore_cleanup_errors=True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name for intermediate tables, under the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local session without that setting gets a
    temporary folder of this machine, which ends with the process; on a cluster the executors could not see
    such a folder, so there the missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _local_folder().name
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows the driver already holds, as a relation of the plan: no job and no Python worker to read them."""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(kind)
    arrays = [
        pa.array([list(v.items()) if isinstance(v, dict) else v for v in values], to_arrow_type(field.dataType))
        for field, values in zip(kind, columns)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=kind.names), kind)


def side_by_side(work: Callable[[Any], Any], items: Iterable[Any], parallelism: int = PARALLEL_JOBS) -> list:
    """Submit one Spark job per item from a few threads, results in item order.

    For many small tables: one job at a time would leave a cluster waiting for the last task of each.
    """
    items = list(items)
    with ThreadPoolExecutor(max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name, paired up level by level, so the plan of a thousand tables is ten levels deep."""
    level = list(frames)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [reduce(DataFrame.unionByName, pair) for pair in pairs]
    return level[0]
