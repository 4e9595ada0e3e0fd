"""Dump files: facts, classes, siblings and link targets (A1-A5, A10).

File listings are DataFrames with ``dir`` and ``file_name``. Looking a file up is an equi-join on that
pair, so a listing of millions of files needs no driver loop and no file-system call per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvage.operators.skew import hot_keys, lookup_join
from salvage.sources.files import hash_files, list_files

# File classes and what is said about them.
FRONT_END, DATA, UNKNOWN = "likely-front-end", "likely-data", "unknown"
HEADLINES = {
    FRONT_END: "This file looks like a front-end/control database",
    DATA: "This file looks like a data database",
    UNKNOWN: "Database type is not obvious from the filename",
}
TRY_SIBLING = "If extraction fails because of linked tables, try the sibling data file: "
WATCH_LINKS = "Front-end databases often point at linked tables. Keep an eye out for stale paths."
BEST_INPUT = "This is the best input when you want cross-platform schema and table export."
USE_PREFLIGHT = "Use the preflight results below to decide whether this is a front-end shell or a data file."
STALE_PATH = "This looks like a front-end database with a stale linked-table path"
STALE_ON_OPEN = (
    "Database open failed because a linked Access file points to a Windows-only path that is not present here"
)
REMAPPED = "Linked database path was remapped to a local sibling file"
UNRESOLVED = "Linked database could not be resolved: "


def base_name(path: Column, separators: str = r"/\\") -> Column:
    return F.regexp_extract(path, f"[^{separators}]*$", 0)


def extension(file_name: Column) -> Column:
    """Lower-case text after the last dot, ``unknown`` without one."""
    return F.when(file_name.contains("."), F.lower(F.substring_index(file_name, ".", -1))).otherwise("unknown")


def dump_catalog(spark: SparkSession, path: str, hashed: bool = True) -> DataFrame:
    """A1: ``path``, name, extension, size, SHA-256 and ``reason`` of every file below ``path``.

    Executors list the folders and stream each file once, whatever its size and store (``files.py``). A file
    that cannot be read is a row with a reason and without a hash. Without hashing no file is opened.
    """
    listed = list_files(spark, path)
    found = hash_files(listed) if hashed else listed
    name = F.substring_index("path", "/", -1)
    return found.select(
        "path", name.alias("file_name"), extension(name).alias("extension"), "size_bytes", *(["sha256"] if hashed else []), "reason"
    )


def dump_class(file_name: Column) -> Column:
    upper = F.upper(file_name)
    return F.when(upper.contains("SYS"), FRONT_END).when(upper.contains("TBL"), DATA).otherwise(UNKNOWN)


def classify_dumps(files: DataFrame) -> DataFrame:
    """A2: class of each file by its name, with its headline."""
    kind = F.col("classification")
    headline = F.when(kind == FRONT_END, HEADLINES[FRONT_END]).when(kind == DATA, HEADLINES[DATA])
    return files.withColumn("classification", dump_class(F.col("file_name"))).withColumn(
        "headline", headline.otherwise(HEADLINES[UNKNOWN])
    )


def _swapped(name: Column, old: str, new: str) -> Column:
    upper = F.replace(name, F.lit(old.upper()), F.lit(new.upper()))
    return F.replace(upper, F.lit(old), F.lit(new))


def sibling_alternatives(files: DataFrame) -> DataFrame:
    """A3: the front-end or data file beside each file, if it exists, and the advice that follows.

    Most files have no candidate. They get a key that no file name equals (it holds a slash) but that
    differs from file to file, so they do not meet in one shuffle partition as nulls would.
    """
    classed = files if "classification" in files.columns else classify_dumps(files)
    name, kind = F.col("file_name"), F.col("classification")
    candidate = F.when(kind == FRONT_END, _swapped(name, "sys", "tbl")).when(
        kind == DATA, _swapped(name, "tbl", "sys")
    )
    changed = F.when(candidate != name, candidate)
    asked = classed.withColumn("_wanted", F.coalesce(changed, F.concat(F.lit("/"), name)))
    present = files.select("dir", F.col("file_name").alias("_wanted")).distinct().withColumn("_there", F.lit(True))
    found = asked.join(present, ["dir", "_wanted"], "left")
    alternative = F.when(F.col("_there"), F.col("_wanted"))
    advice = (
        F.when((kind == FRONT_END) & F.col("_there"), F.concat(F.lit(TRY_SIBLING), F.col("_wanted")))
        .when(kind == FRONT_END, WATCH_LINKS)
        .when(kind == DATA, BEST_INPUT)
        .otherwise(USE_PREFLIGHT)
    )
    return (
        found.withColumns({"suggested_alternative": alternative, "recommendation": advice})
        .select(*classed.columns, "suggested_alternative", "recommendation")
    )


def resolve_links(links: DataFrame, files: DataFrame, compat: bool = False) -> DataFrame:
    """A4: where each link (``source_dir``, ``linked_path``) leads.

    The full path wins; then the same base name beside the linking file; otherwise the link is unresolved.
    One back-end file is commonly linked from very many places, so both lookups spread hot paths. Base
    names end at either separator; ``compat`` knows ``/`` only.
    """
    listing = files.select("dir", "file_name").distinct()
    path = F.concat_ws("/", "dir", "file_name")
    whole = listing.select(path.alias("linked_path"), F.lit(True).alias("_direct"))
    beside = listing.select(path.alias("_beside"), F.lit(True).alias("_remapped"))
    base = base_name(F.col("linked_path"), "/" if compat else r"/\\")
    asked = links.withColumn("_beside", F.when(base != "", F.concat_ws("/", "source_dir", base)))
    # Hot paths of both lookups are counted in one pass on the links as they come.
    hot = hot_keys(asked, ["linked_path"], ["_beside"])
    direct = lookup_join(asked, whole, ["linked_path"], hot=hot)
    both = lookup_join(direct, beside, ["_beside"], hot=hot)
    return both.select(
        *links.columns,
        F.when(F.col("_direct"), F.col("linked_path"))
        .when(F.col("_remapped"), F.col("_beside"))
        .alias("resolved_path"),
        F.when(F.col("_direct"), "direct")
        .when(F.col("_remapped"), "remapped")
        .otherwise("unresolved")
        .alias("resolution"),
    )


def link_diagnostics(resolved: DataFrame, compat: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """A warning per remapped link and an error per unresolved one."""
    remapped = F.col("resolution") == "remapped"
    details = F.when(
        remapped,
        F.create_map(
            F.lit("originalPath"), F.col("linked_path"), F.lit("resolvedPath"), F.col("resolved_path")
        ),
    ).otherwise(F.create_map(F.lit("linkedPathHint"), F.col("linked_path")))
    return resolved.where(F.col("resolution") != "direct").select(
        *keys,
        F.when(remapped, "LINKED_DB_REMAP").otherwise("DATABASE_OPEN_FAILED").alias("code"),
        F.when(remapped, "warning").otherwise("error").alias("severity"),
        F.when(remapped, REMAPPED).otherwise(F.concat(F.lit(UNRESOLVED), F.col("linked_path"))).alias("message"),
        F.lit("linked-table").alias("object_type"),
        base_name(F.col("linked_path"), "/" if compat else r"/\\").alias("object_name"),
        details.alias("details"),
    )


def _is_stale(message: Column) -> Column:
    return message.contains("C:\\") & (message.contains(".mdb") | message.contains(".accdb"))


def stale_link_hints(messages: DataFrame) -> DataFrame:
    """A5: open failures that point at a path of another machine, and what each failure is reported as."""
    message = F.col("message")
    return messages.withColumn("is_stale_windows_path", F.coalesce(_is_stale(message), F.lit(False))).withColumns(
        {
            "code": F.when(F.col("is_stale_windows_path"), "PREFLIGHT_LINKED_PATH_UNAVAILABLE").otherwise(
                "PREFLIGHT_SCAN_FAILED"
            ),
            "scan_message": F.when(F.col("is_stale_windows_path"), STALE_PATH).otherwise(message),
            "extract_code": F.when(F.col("is_stale_windows_path"), "LINKED_DB_PATH_UNAVAILABLE"),
            "extract_message": F.when(F.col("is_stale_windows_path"), STALE_ON_OPEN).otherwise(message),
        }
    )


def _counted(rows: DataFrame | None, key: str, name: str) -> DataFrame | None:
    return None if rows is None else rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def preflight(
    files: DataFrame,
    tables: DataFrame | None = None,
    queries: DataFrame | None = None,
    failures: DataFrame | None = None,
    key: str = "source_id",
) -> DataFrame:
    """A10: one row per dump file.

    Tables, queries and failures are counted per source before they are joined, so a source that holds most
    of them is one row by then.
    """
    result = sibling_alternatives(classify_dumps(files))
    for counts in (_counted(tables, key, "table_count"), _counted(queries, key, "query_count")):
        if counts is not None:
            result = result.join(counts, key, "left")
    for name in ("table_count", "query_count"):
        value = F.coalesce(name, F.lit(0)) if name in result.columns else F.lit(0)
        result = result.withColumn(name, value.cast("bigint"))
    if failures is None:
        return result.withColumns({"openable": F.lit(True), "first_warning": F.lit(None).cast("string")})
    first = stale_link_hints(failures).groupBy(key).agg(
        F.count(F.lit(1)).alias("_failures"), F.min("scan_message").alias("first_warning")
    )
    return (
        result.join(first, key, "left")
        .withColumn("openable", F.col("_failures").isNull())
        .drop("_failures")
    )
