"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salvage.plans.oracles import ORACLES  # noqa: E402
from salvage.plans.queries import QUERIES  # noqa: E402
from salvage.plans.shapes import GIVEN  # noqa: E402

DATA = "/root/testdata"


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    return sorted(df.columns), _rows(df.columns, df.collect())


def oracle_rows(name, sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = [item[0] for item in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def difference(spark, name, sf_dir):
    """None if both sides agree, else what differs."""
    got_columns, got = spark_rows(spark, name, sf_dir)
    want_columns, want = oracle_rows(name, sf_dir)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first: {got[:1]} / {want[:1]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} rows differ, such as {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from salvage.session import build_session

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    session = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for query in names or QUERIES:
        start = time.time()
        try:
            if query in ORACLES:
                result = difference(session, query, f"{DATA}/sf{sf}") or "ok"
            else:
                result = f"rows only: {len(spark_rows(session, query, f'{DATA}/sf{sf}')[1])}"
        except Exception as error:
            result = "ERROR " + str(error)[:1500]
        bad += result != "ok" and not result.startswith("rows only")
        print(f"{query:28s} {time.time() - start:6.2f}s {result[:1500]}", flush=True)
    print("bad:", bad)
