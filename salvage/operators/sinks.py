"""Exports and their checksums."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from salvage.functions.names import distinct_slugs, safe_columns
from salvage.functions.text import BOM, CHARSETS, WIDE_CHARSET_SETTINGS, wide_charsets
from salvage.functions.values import normalize_values, sorted_keys, stringify
from salvage.options import FORMATS
from salvage.session import PARALLEL_JOBS, local_rows, side_by_side
from salvage.sources.files import hash_files, list_files
from salvage.sources.tables import by_name

# Quoting as in RFC 4180, no trimming, null written as nothing.
_CSV_DIALECT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

LEDGER = (
    "table string, slug string, format string, path string, status string, row_count bigint, reason string"
)
PARTIAL_CODE = "PARQUET_EXPORT_PARTIAL"


def _charset_scope(spark: SparkSession, encoding: str):
    return nullcontext() if CHARSETS[encoding][0] == "UTF-8" else wide_charsets(spark)


def export_csv(df: DataFrame, path: str, encoding: str = "UTF8") -> None:
    """Header, CRLF, doubled quotes, in the given character set.

    The byte order mark goes in front of the first header name, so every part file starts with it.
    """
    with _charset_scope(df.sparkSession, encoding):
        _csv_text(df, encoding).write.mode("overwrite").options(**_csv_form(encoding)).csv(path)


def _csv_text(df: DataFrame, encoding: str) -> DataFrame:
    text = stringify(df)
    if CHARSETS[encoding][1] and text.columns:
        text = text.toDF(BOM + text.columns[0], *text.columns[1:])
    return text


def _csv_form(encoding: str) -> dict[str, str]:
    return {**_CSV_DIALECT, "encoding": CHARSETS[encoding][0], "lineSep": "\r\n"}


def read_csv(spark: SparkSession, path: str, columns: Iterable[str], encoding: str = "UTF8") -> DataFrame:
    """An export back as text columns; empty text comes back as null.

    A charset beyond the standard ones is allowed by a session setting that is read when the plan runs, so
    such a frame belongs to a session of its own.
    """
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in columns)
    options = {**_CSV_DIALECT, "encoding": CHARSETS[encoding][0], "multiLine": "true", "enforceSchema": "true"}
    if CHARSETS[encoding][0] != "UTF-8":
        spark = spark.newSession()
        for key in WIDE_CHARSET_SETTINGS:
            spark.conf.set(key, "true")
    return spark.read.schema(schema).options(**options, mode="FAILFAST").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One object per line, keys sorted and nulls left out at every level."""
    _json_objects(df).write.mode("overwrite").json(path)


def _json_objects(df: DataFrame) -> DataFrame:
    normalized = normalize_values(df)
    plain = normalized.toDF(*[f"_{i}" for i in range(len(normalized.columns))])
    ordered = sorted(enumerate(normalized.schema.fields), key=lambda item: item[1].name)
    return plain.select(*[sorted_keys(F.col(f"_{i}"), field.dataType).alias(field.name) for i, field in ordered])


def export_parquet(df: DataFrame, path: str, typed: bool = False) -> None:
    """Safe column names, original ones as comments; text columns, or the source types if ``typed``."""
    _parquet_columns(df, typed).write.mode("overwrite").option("compression", "snappy").parquet(path)


def _parquet_columns(df: DataFrame, typed: bool) -> DataFrame:
    return safe_columns(df if typed else stringify(df))


def export_partitioned(
    df: DataFrame, path: str, kind: str, places: Iterable[str], encoding: str = "UTF8", typed: bool = False
) -> None:
    """C1-C3 for the rows of many tables of one schema: the text columns ``places``, the last ones, say whose row it is, and
    become folders. An export is the same as that of its table alone, but one job writes them all.
    """
    forms = {
        "CSV": lambda: (_csv_text(df, encoding), _csv_form(encoding)),
        "JSON": lambda: (_json_objects(df), {}),
        "PARQUET": lambda: (_parquet_columns(df, typed), {"compression": "snappy"}),
    }
    with _charset_scope(df.sparkSession, encoding):
        frame, form = forms[kind]()
        frame.write.mode("overwrite").options(**form).partitionBy(*places).format(kind.lower()).save(path)


def _writers(encoding: str, typed: bool) -> dict[str, Callable[[DataFrame, str], None]]:
    return {
        "CSV": lambda df, path: export_csv(df, path, encoding),
        "JSON": export_json,
        "PARQUET": lambda df, path: export_parquet(df, path, typed),
    }


def export_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    out: str,
    formats: Iterable[str] = FORMATS,
    encoding: str = "UTF8",
    typed: bool = False,
    slugs: Mapping[str, str] | None = None,
    parallelism: int = PARALLEL_JOBS,
) -> DataFrame:
    """Every table in every format under ``<out>/data``, one ledger row for each.

    Every write is one shuffle-free job from scan to files. A second format scans the source again: that
    reads compressed columns, where keeping the normalised rows would write and read them uncompressed.
    Jobs of several tables run side by side, as small tables alone would leave a cluster idle. Rows are
    counted while they are written. A write that fails is a ``PARTIAL`` row and does not stop the others.
    """
    slugs = slugs or distinct_slugs(tables)
    writers = _writers(encoding, typed)

    def export(task: tuple[str, str]) -> tuple:
        table, kind = task
        relative = f"data/{slugs[table]}.{kind.lower()}"
        counted = Observation()
        try:
            writers[kind](tables[table].observe(counted, F.count(F.lit(1)).alias("n")), f"{out}/{relative}")
            return table, slugs[table], kind, relative, "SUCCESS", counted.get["n"], None
        except Exception as error:
            reason = str(error) or type(error).__name__
            try:
                _write_sidecar(spark, f"{out}/{relative}.metadata", slugs[table], reason)
            except Exception as second:
                reason = f"{reason} (no sidecar: {str(second) or type(second).__name__})"
            return table, slugs[table], kind, relative, "PARTIAL", None, reason

    tasks = [(table, kind) for table in by_name(tables) for kind in formats]
    # A charset outside the standard ones is a session setting while its write is planned: one at a time.
    alone = CHARSETS[encoding][0] != "UTF-8"
    rows = side_by_side(export, tasks, 1 if alone else parallelism)
    return local_rows(spark, rows, LEDGER)


def _write_sidecar(spark: SparkSession, path: str, slug: str, reason: str) -> None:
    row = [("partial", reason, f"data/{slug}.json")]
    sidecar = local_rows(spark, row, "status string, reason string, rawSourceHint string")
    sidecar.coalesce(1).write.mode("overwrite").json(path)


def export_diagnostics(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A warning per export that failed."""
    failed = ledger.where(F.col("status") != "SUCCESS")
    format_name = F.when(F.col("format") == "PARQUET", "Parquet").otherwise(F.col("format"))
    return failed.select(
        *keys,
        F.concat(F.col("format"), F.lit("_EXPORT_PARTIAL")).alias("code"),
        F.lit("warning").alias("severity"),
        F.concat(format_name, F.lit(" export failed for table "), F.col("table")).alias("message"),
        F.lit("table").alias("object_type"),
        F.col("table").alias("object_name"),
        F.create_map(F.lit("exception"), F.col("reason")).alias("details"),
    )


PARTS = "artifact string, part string, size_bytes bigint, sha256 string, reason string"


def artifact_checksums(spark: SparkSession, *paths: str) -> DataFrame:
    """SHA-256 of every exported part file below the paths; markers and hidden files are not artifacts.

    ``artifact`` is the folder of a part, ``part`` its name; a part that cannot be read has a ``reason`` and no hash.
    """
    files = hash_files(list_files(spark, *paths))
    part = F.substring_index("path", "/", -1)
    visible = ~part.startswith("_") & ~part.startswith(".") | F.col("reason").isNotNull()
    folder = F.col("path").substr(F.lit(1), F.char_length("path") - F.char_length(part) - 1)
    return files.where(visible).select(folder.alias("artifact"), part.alias("part"), "size_bytes", "sha256", "reason")


def hash_tree(parts: DataFrame, *keys: str) -> DataFrame:
    """One hash for all parts of each of ``keys`` (their artifact): ``n_parts``, ``n_bytes`` and ``sha256``.

    The leaves are the parts' hashes, each with its name. They hang on 256 nodes by the name, and a node's hash is that of
    its leaves in order; the root's is that of the nodes. So no list is longer than a 256th of the parts, and a change is found
    by comparing nodes before parts. A tree with an unreadable part has no hash.
    """
    keys = keys or ("artifact",)
    leaf = F.concat_ws(":", "part", "sha256")
    nodes = parts.groupBy(*keys, F.substring(F.sha2("part", 256), 1, 2).alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("sha256").isNull()).alias("lost"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("hash"),
    )
    node = F.concat_ws(":", "node", "hash")
    whole = F.sha2(F.array_join(F.array_sort(F.collect_list(node)), "\n"), 256)
    return nodes.groupBy(*keys).agg(
        F.sum("n").alias("n_parts"), F.sum("bytes").alias("n_bytes"), F.when(F.sum("lost") == 0, whole).alias("sha256")
    )


def changed_parts(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """What became of recorded parts: ``artifact, part, state``, which is ``changed``, ``missing``, ``unreadable`` or ``new``."""
    place = ["artifact", "part"]
    now = present.select(*place, F.col("sha256").alias("_now"), F.lit(True).alias("_there"))
    both = recorded.select(*place, "sha256", F.lit(True).alias("_recorded")).join(now, place, "full")
    state = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_now").isNull(), "unreadable")
        .when(F.col("_recorded").isNull(), "new").when(~F.col("_now").eqNullSafe(F.col("sha256")), "changed")
    )
    return both.select(*place, state.alias("state")).where("state IS NOT NULL")


def with_checksums(exports: DataFrame, parts: DataFrame) -> DataFrame:
    """The ledger of ``export_tables`` with the hash of every artifact that was written whole."""
    # An artifact's folder ends in the ledger's path, whatever the store calls what is before it.
    path = F.concat_ws("/", F.element_at(F.split("artifact", "/"), -2), F.element_at(F.split("artifact", "/"), -1))
    sums = hash_tree(parts).select(path.alias("path"), F.col("sha256").alias("_sum"))
    found = exports.join(sums, "path", "left").withColumn("sha256", F.when(F.col("status") == "SUCCESS", F.col("_sum")))
    return found.select(*exports.columns, "sha256")


def _tagged(value: Column) -> Column:
    # Length in front of each value: neither a separator inside a value nor a null can be mistaken.
    return F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("~"))


def row_digest(cols: list[Column]) -> Column:
    """SHA-256 over a row of text columns."""
    return F.sha2(F.concat(*[_tagged(col) for col in cols]), 256)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a sum of row digests, whatever the row order and the part files.

    Sums combine before the one-row exchange. Sixty bits of each digest are added up as decimals, which
    hold more than 10^19 rows.
    """
    text = stringify(df)
    plain = text.toDF(*[f"_{i}" for i in range(len(text.columns))])
    bits = F.conv(F.substring(row_digest([F.col(c) for c in plain.columns]), 1, 15), 16, 10)
    return plain.select(bits.cast("decimal(20,0)").alias("bits")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("bits").cast("decimal(38,0)"), F.lit(0)).cast("string").alias("h"),
    )
