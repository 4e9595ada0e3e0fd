"""The given tables in the shapes the operators work on.

Each shape is SQL that means the same in Spark and in the engine that checks the results: ``{name}`` stands
for a given table. The shapes grow with the tables they read. ``links`` sends a third of its rows to one
path on purpose, so the lookups are always run on skewed input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

SHAPES = {
    "part_queries": """
SELECT p_partkey AS query_id, 'q ' || p_type || '/' || CAST(p_partkey AS VARCHAR(20)) AS name,
CASE p_partkey % 16
WHEN 0 THEN 'SELECT * FROM [' || p_name || '] WHERE size > 3'
WHEN 1 THEN 'SELECT IIf([size]=1,''y'',''z'') FROM [' || p_brand || ']'
WHEN 2 THEN chr(10) || ' UPDATE ' || p_name || ' SET a = Nz([a],0)'
WHEN 3 THEN 'INSERT INTO [' || p_name || '] SELECT a FROM ' || p_type || ' INNER JOIN [Order Details] ON x.id=y.id'
WHEN 4 THEN 'DELETE FROM [' || p_type || '] WHERE d < #2024-01-01#'
WHEN 5 THEN 'SELECT a FROM [' || p_name || '] WHERE b Like ''*x*'' AND Switch(a,b)'
WHEN 6 THEN 'TRANSFORM Sum(a) SELECT b FROM ' || p_type || ' GROUP BY b PIVOT c'
WHEN 7 THEN '(SELECT a FROM A) UNION (SELECT DLookup(''a'',''T'') FROM B)'
WHEN 8 THEN 'PARAMETERS p Text, q Long; SELECT Format$(Now(),''x'') FROM [P ' || p_name || ']'
WHEN 9 THEN 'CREATE TABLE ' || p_name || ' (a Long)'
WHEN 10 THEN 'pass-through to ' || p_brand
WHEN 11 THEN 'ALTER TABLE [' || p_name || '] ADD b Text'
WHEN 12 THEN 'drop index i on ' || p_name
WHEN 13 THEN NULL
WHEN 14 THEN '   '
ELSE '' END AS sql FROM {part}""",
    "memo_queries": """
SELECT -1 - doc_id AS query_id, 'memo ' || lang || '/' || source || ' ' || CAST(doc_id AS VARCHAR(20)) AS name,
CASE doc_id % 2 WHEN 0 THEN text ELSE 'SELECT a FROM [' || text || '] WHERE b LIKE ''*c*''' END AS sql
FROM {documents}""",
    "hidden_names": """
SELECT p_partkey AS query_id, CASE p_partkey % 6
WHEN 0 THEN 'SELECT * FROM [' || p_name || '|' || p_brand || '] INNER JOIN [' || p_type || ']'
WHEN 1 THEN 'SELECT ''copied from ' || p_type || ''' FROM ' || p_brand || ' WHERE x = ' || chr(34) || 'join ' || p_name || chr(34)
WHEN 2 THEN 'SELECT a -- from ' || p_name || chr(10) || 'FROM [' || p_name || '-' || CAST(p_size AS VARCHAR(20)) || ']'
WHEN 3 THEN '/* into ' || p_type || chr(10) || ' */ UPDATE [' || p_name || '''s] SET a = ''it''''s from ' || p_brand || ''''
WHEN 4 THEN 'SELECT [from] x FROM ' || p_type || ' JOIN ' || p_type || ' INTO b' || CAST(p_size AS VARCHAR(20))
ELSE 'FROM ''open from ' || p_name END AS sql FROM {part}""",
    "saved_queries": "SELECT * FROM ({part_queries}) a UNION ALL SELECT * FROM ({memo_queries}) b",
    "dump_files": """
SELECT 'db' || CAST(c_custkey AS VARCHAR(20)) AS source_id,
'/dumps/d' || CAST(CAST(FLOOR(c_custkey / 8.0) AS BIGINT) AS VARCHAR(20)) AS dir,
CASE c_custkey % 8
WHEN 0 THEN 'ledger' || CAST(c_custkey AS VARCHAR(20)) || 'TBL.mdb'
WHEN 1 THEN 'ledger' || CAST(c_custkey - 1 AS VARCHAR(20)) || 'SYS.mdb'
WHEN 2 THEN 'stocktbl' || CAST(c_custkey AS VARCHAR(20)) || '.ACCDB'
WHEN 3 THEN 'stocksys' || CAST(c_custkey - 1 AS VARCHAR(20)) || '.ACCDB'
WHEN 4 THEN 'SysTbl' || CAST(c_custkey AS VARCHAR(20)) || '.mdb'
WHEN 5 THEN 'misc' || CAST(c_custkey AS VARCHAR(20))
WHEN 6 THEN 'lonesys' || CAST(c_custkey AS VARCHAR(20)) || '.mdb'
ELSE lower(c_mktsegment) || CAST(c_custkey AS VARCHAR(20)) || '.accdb' END AS file_name FROM {customer}""",
    "links": """
SELECT o_orderkey AS link_id, '/dumps/d' || g AS source_dir,
CASE o_orderkey % 6
WHEN 0 THEN '/dumps/d' || g || '/ledger' || base || 'TBL.mdb'
WHEN 1 THEN 'C:' || chr(92) || 'old' || chr(92) || 'ledger' || base || 'TBL.mdb'
WHEN 2 THEN '/mnt/gone/ledger' || base || 'SYS.mdb'
WHEN 3 THEN 'D:' || chr(92) || 'gone' || chr(92) || 'missing.mdb'
ELSE '/dumps/d0/ledger0TBL.mdb' END AS linked_path
FROM (SELECT o_orderkey, CAST(CAST(FLOOR(o_custkey / 8.0) AS BIGINT) AS VARCHAR(20)) AS g,
CAST(8 * CAST(FLOOR(o_custkey / 8.0) AS BIGINT) AS VARCHAR(20)) AS base FROM {orders}) o""",
    "failures": """
SELECT event_id, 'db' || CAST(user_id AS VARCHAR(20)) AS source_id, CASE event_id % 6
WHEN 0 THEN 'cannot open C:' || chr(92) || 'data' || chr(92) || event_type || '.mdb'
WHEN 1 THEN 'no file C:' || chr(92) || 'x.accdb for ' || event_type
WHEN 2 THEN event_type || ' failed'
WHEN 3 THEN 'C:' || chr(92) || ' only'
WHEN 4 THEN '/mnt/' || event_type || '.mdb is gone'
ELSE 'time-out after ' || CAST(event_id AS VARCHAR(20)) END AS message FROM {events}""",
    "lake_tables": """
SELECT 'db' || CAST(p_partkey % 100 AS VARCHAR(20)) AS source_id,
CASE WHEN p_partkey % 10 = 0 THEN 'MSys' ELSE '' END || p_name || ' ' || CAST(p_partkey AS VARCHAR(20)) AS name,
replace(lower(CASE WHEN p_partkey % 10 = 0 THEN 'MSys' ELSE '' END || p_name || ' ' || CAST(p_partkey AS VARCHAR(20))), ' ', '-') AS slug,
p_partkey % 10 = 0 AS system_object, p_partkey % 7 = 0 AS linked,
CASE WHEN p_partkey % 50 = 3 THEN CAST(-1 AS BIGINT) ELSE p_partkey * 3 END AS row_count,
p_size AS column_count FROM {part}""",
    "table_selection": """
SELECT DISTINCT p_name || ' ' || CAST(p_partkey AS VARCHAR(20)) AS name FROM {part} WHERE p_brand LIKE 'Brand#1%'""",
    "lake_relationships": """
SELECT 'rel' || CAST(o_orderkey AS VARCHAR(20)) AS name, 't' || CAST(o_custkey % 50 AS VARCHAR(20)) AS from_table,
't' || CAST(o_orderkey % 50 AS VARCHAR(20)) AS to_table, split(o_orderpriority, '-') AS from_columns,
split(o_orderstatus || '-id', '-') AS to_columns, o_orderkey % 2 = 0 AS cascade_deletes,
o_orderkey % 3 = 0 AS cascade_updates FROM {orders}""",
    "end_selection": "SELECT DISTINCT 't' || CAST(s_nationkey AS VARCHAR(20)) AS name FROM {supplier}",
    "lake_keys": """
SELECT 't' || CAST(p_partkey % 50 AS VARCHAR(20)) AS "table", 'ix' || CAST(p_partkey AS VARCHAR(20)) AS name,
p_size % 2 = 0 AS primary_key, p_size % 3 = 0 AS "unique", split(p_name, ' ') AS columns FROM {part}""",
}

# What the two sources of the written lake declare: source, table, name, columns and whether it is a primary key.
DECLARED_KEYS = [
    ("one", "nation", "pk_nation", ("n_nationkey",), True), ("one", "customer", "pk_customer", ("c_custkey",), True),
    ("one", "orders", "pk_orders", ("o_orderkey",), True), ("one", "orders", "uq_orders_customer", ("o_custkey",), False),
    ("one", "events", "pk_events", ("event_id",), True), ("two", "customer", "pk_customer", ("c_custkey",), True),
    ("two", "part", "pk_part", ("p_partkey",), True), ("two", "part", "uq_part_name", ("p_name",), False),
    ("two", "conversations", "uq_conversations", ("conv_id", "turn"), False),
]
# Source, name, child, parent and their columns.
DECLARED_LINKS = [
    ("one", "orders_customer", "orders", "customer", ("o_custkey",), ("c_custkey",)),
    ("one", "customer_nation", "customer", "nation", ("c_nationkey",), ("n_nationkey",)),
    ("one", "nation_customer", "nation", "customer", ("n_nationkey",), ("c_custkey",)),
    # From one format to another.
    ("two", "part_customer", "part", "customer", ("p_partkey",), ("c_custkey",)),
]
# Declared where there is no such table, or column.
UNKNOWN_KEYS = ("two", "orders", "pk_orders", ("o_orderkey",), True), ("one", "nation", "ix_nation", ("n_rank",), False)


def shape_sql(name: str, quote: str = '"') -> str:
    """The text of a shape over the names of given tables."""
    text = re.sub(
        r"\{(\w+)\}",
        lambda match: shape_sql(match[1], quote) if match[1] in SHAPES else match[1],
        SHAPES[name],
    )
    return text.replace('"', quote)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: given(spark, sf_dir, name) for name in GIVEN}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape as a DataFrame; the given tables it names are bound to the query, not registered."""
    text = SHAPES[name]
    used = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
    frames = {u: shape(spark, sf_dir, u) if u in SHAPES else given(spark, sf_dir, u) for u in used}
    text = re.sub(r"\(\{(\w+)\}\)", r"{\1}", text).replace('"', "`")
    return spark.sql(text, **frames)


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property maps of sources, parsed from the JSON the events carry."""
    return given(spark, sf_dir, "events").select(
        F.concat(F.lit("db"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_type").alias("scope"),
        F.from_json("props", "map<string,string>").alias("props"),
    )
