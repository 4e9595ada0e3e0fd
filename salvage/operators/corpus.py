"""Mining a corpus of saved queries.

Input is any DataFrame with ``name`` and ``sql`` columns; further columns, such as the key of the source
a query came from, are carried along. All but the sorted listings are one projection: no shuffle, and
usable on a stream as they are.

Arrays are exploded with ``explode_outer`` and a filter behind it. A plain ``explode`` makes Spark filter out
empty arrays first, and to do so it would mine every text a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvage.functions import sql_text
from salvage.functions.names import slug

DEPENDS_ON = "query-depends-on"
EMPTY_SQL = "-- empty SQL --"
NO_TRANSLATION = "-- no translation --"
TRANSLATION_NOTE = "SQL translation generated conservatively"
SUCCESS_BAR = 0.5

_LOWER, _HEAD, _FOUND, _BLANK = "_lower", "_head", "_found", "_blank"
_CALLS, _WILDCARDS = "_calls", "_wildcards"


def _prepared(
    q: DataFrame, lower: bool = False, mode: str | None = None
) -> DataFrame:
    """Working columns that several outputs of one row share; dropped again by the callers."""
    work: dict[str, Column] = {}
    if lower:
        work[_LOWER] = sql_text.lowered(F.col("sql"))
    if mode:
        work[_FOUND] = sql_text.found_sources(F.coalesce(F.col("sql"), F.lit("")), mode)
    prepared = q.withColumns(work)
    # A second step, so that the trimmed text is computed once and not in every test of it.
    return prepared.withColumn(_HEAD, sql_text.head_of(F.col(_LOWER))) if lower else prepared


def _finished(q: DataFrame) -> DataFrame:
    return q.drop(_LOWER, _HEAD, _FOUND, _BLANK, _CALLS, _WILDCARDS)


def classify_queries(q: DataFrame) -> DataFrame:
    """The class of each query by its text."""
    return _finished(_prepared(q, lower=True).withColumn("type", sql_text.query_class(F.col(_HEAD))))


def dialect_warnings(q: DataFrame) -> DataFrame:
    """Source-dialect constructs as an array of texts."""
    return _finished(
        _prepared(q, lower=True).withColumn("warnings", sql_text.dialect_warnings(F.col(_LOWER)))
    )


def query_dependencies(q: DataFrame, mode: str = "compat") -> DataFrame:
    """D3: the tables a query names, distinct, first seen first."""
    return _finished(
        _prepared(q, mode=mode).withColumn("dependencies", sql_text.dependencies(F.col(_FOUND), mode))
    )


def dependency_edges(q: DataFrame, keys: tuple[str, ...] = (), mode: str = "compat") -> DataFrame:
    """One row per query and table it names."""
    needed = q.select(*keys, "name", "sql")
    edges = query_dependencies(needed, mode).select(
        *keys,
        F.col("name").alias("from"),
        F.explode_outer("dependencies").alias("to"),
        F.lit(DEPENDS_ON).alias("type"),
    )
    return edges.where(F.col("to").isNotNull())


def translate_queries(q: DataFrame, dialect: str = "ANSI") -> DataFrame:
    """Conservative translation. The dialect decides where the text is filed, not the text."""
    blank = F.lit(True) if dialect.upper() == "NONE" else sql_text.is_blank(F.col("sql"))
    lower, calls, wildcards = F.col(_LOWER), F.col(_CALLS), F.col(_WILDCARDS)
    prepared = q.withColumns({_LOWER: sql_text.lowered(F.col("sql")), _BLANK: blank}).withColumns(
        {_CALLS: sql_text.has_untranslated_calls(lower), _WILDCARDS: sql_text.has_wildcards(lower)}
    )
    blank = F.col(_BLANK)
    return _finished(
        prepared.withColumns(
            {
                "translated": sql_text.translated(F.col("sql"), blank),
                "confidence": sql_text.confidence(calls, wildcards, blank),
                "translation_warnings": sql_text.translation_warnings(calls, wildcards, blank),
            }
        )
    )


def translation_status(confidence: Column, bar: float = SUCCESS_BAR) -> Column:
    return F.when(confidence >= bar, "SUCCESS").otherwise("PARTIAL")


def translation_ledger(
    translated: DataFrame, dialect: str, keys: tuple[str, ...] = (), bar: float = SUCCESS_BAR
) -> tuple[DataFrame, DataFrame]:
    """A diagnostic per translation warning, a coverage row per query."""
    diagnostics = translated.select(
        *keys,
        F.lit("QUERY_TRANSLATION_WARNING").alias("code"),
        F.lit("warning").alias("severity"),
        F.explode_outer("translation_warnings").alias("message"),
        F.lit("query").alias("object_type"),
        F.col("name").alias("object_name"),
        F.create_map().cast("map<string,string>").alias("details"),
    ).where(F.col("message").isNotNull())
    coverage = translated.select(
        *keys,
        F.lit("query-translation").alias("category"),
        "name",
        translation_status(F.col("confidence"), bar).alias("status"),
        "confidence",
        F.lit(TRANSLATION_NOTE).alias("reason"),
        F.create_map(F.lit("dialect"), F.lit(dialect.upper())).alias("details"),
    )
    return diagnostics, coverage


def query_models(
    q: DataFrame, keys: tuple[str, ...] = (), mode: str = "compat", ascii_names: bool = False
) -> DataFrame:
    """The normalised model of every query, from one scan in one stage."""
    prepared = _prepared(q.select(*keys, "name", "sql"), lower=True, mode=mode)
    return prepared.select(
        *keys,
        "name",
        slug(F.col("name"), ascii_names).alias("slug"),
        sql_text.query_class(F.col(_HEAD)).alias("type"),
        F.coalesce("sql", F.lit("")).alias("sql"),
        F.array().cast("array<string>").alias("parameters"),
        sql_text.dependencies(F.col(_FOUND), mode).alias("dependencies"),
        sql_text.dialect_warnings(F.col(_LOWER)).alias("warnings"),
    )


def sql_workbench(q: DataFrame, dialect: str = "ANSI", keys: tuple[str, ...] = ()) -> DataFrame:
    """Original and translated text side by side, sorted by name.

    The keys break ties, so many queries of one name still spread over the sorted partitions. Sorting comes
    first: it samples its input, which would otherwise translate every text twice.
    """
    return translate_queries(_by_name(q, keys), dialect).select(
        *keys,
        "name",
        F.when(sql_text.is_blank(F.col("sql")), EMPTY_SQL).otherwise(F.col("sql")).alias("raw"),
        F.coalesce("translated", F.lit(NO_TRANSLATION)).alias("translated"),
        "confidence",
        F.col("translation_warnings").alias("warnings"),
    )


def _by_name(q: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return q.select(*keys, "name", "sql").orderBy(F.lower("name"), "name", *keys)


def parameter_count(sql: Column) -> Column:
    """Number of declarations in a leading ``PARAMETERS [a, b] Text, c Decimal(10,2);`` clause."""
    bare = F.regexp_replace(sql, r"\[[^\]]*\]|\([^)]*\)", "x")
    head = F.regexp_extract(bare, r"(?is)^\s*parameters\s+([^;]*);", 1)
    return F.when(head == "", 0).otherwise(F.size(F.split(head, ",")))


def query_inventory(q: DataFrame, keys: tuple[str, ...] = (), ascii_names: bool = False) -> DataFrame:
    """The saved queries, sorted by name without case."""
    return _prepared(_by_name(q, keys), lower=True).select(
        *keys,
        "name",
        slug(F.col("name"), ascii_names).alias("slug"),
        sql_text.query_class(F.col(_HEAD)).alias("type"),
        parameter_count(F.coalesce("sql", F.lit(""))).alias("parameter_count"),
        F.coalesce("sql", F.lit("")).alias("sql"),
    )
