"""What was recovered and what was not.

``keys`` names columns, such as the source a row comes from, that a function carries through to its result.
With them one ledger covers a whole lake in the same jobs as it covers one source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvage.functions import sql_text
from salvage.operators.corpus import SUCCESS_BAR, TRANSLATION_NOTE, translation_status
from salvage.operators.skew import lookup_join
from salvage.options import FORMATS, UnpackOptions
from salvage.session import local_rows, union_all
from salvage.sources.files import written_once

COVERAGE = "category string, name string, status string, confidence double, reason string, details map<string,string>"
DIAGNOSTICS = (
    "code string, severity string, message string, object_type string, object_name string, "
    "details map<string,string>"
)
COVERAGE_COLUMNS = ["category", "name", "status", "confidence", "reason", "details"]
DIAGNOSTIC_COLUMNS = ["code", "severity", "message", "object_type", "object_name", "details"]

# Confidence and reason per kind of object.
TABLE_CONFIDENCE, TABLE_REASON = 0.95, "Schema and row export completed"
TABLE_PARTIAL_REASON = "Schema read, but not every requested export was written"
TABLE_FAILED_REASON = "Table could not be read"
RELATIONSHIP_CONFIDENCE, RELATIONSHIP_REASON = 0.9, "Relationship extracted"
QUERY_CONFIDENCE, QUERY_REASON = 0.85, "Access SQL preserved and normalized query model written"
DATABASE_REASON = "Database could not be opened"
UNRECOVERED = ("forms", "reports", "macros", "vba")
HELPER_OFF = "Helper-backed recovery was disabled by request; cross-platform file parsing still ran"
HELPER_MISSING = (
    "Cross-platform file parsing ran, but these artifacts were not recoverable without helper-backed extraction"
)
FIDELITY_MISSING = "Full-fidelity extraction requested but Microsoft Access automation is unavailable"
MISSING_ARTIFACTS = "Validation found missing referenced artifacts: "
COUNTED_KINDS = ("tables", "queries", "relationships")
UNCOUNTED_KINDS = ("forms", "reports", "macros", "modules")


def _map(**entries: Column) -> Column:
    return F.create_map(*[part for name, value in entries.items() for part in (F.lit(name), value)])


def table_coverage(
    inventory: DataFrame,
    exports: DataFrame | None = None,
    with_schema: bool = True,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """A row per table. A table with a failed export, or one that cannot be counted, is not a success.

    Exports with a ``sha256`` leave it in the details, as ``csvSha256``, ``jsonSha256`` and ``parquetSha256``.
    """
    failed, sums = F.lit(False), {}
    if exports is not None and "sha256" in exports.columns:
        sums = {f"{kind.lower()}Sha256": F.col(f"_{kind}") for kind in FORMATS}
        by_table = exports.groupBy(*keys, F.col("table").alias("name")).agg(
            F.max(F.col("status") != "SUCCESS").alias("_failed"),
            *[F.max(F.when(F.col("format") == kind, F.col("sha256"))).alias(f"_{kind}") for kind in FORMATS],
        )
        inventory = inventory.join(by_table, [*keys, "name"], "left")
        failed = F.coalesce("_failed", F.lit(False))
    elif exports is not None:
        bad = exports.where(F.col("status") != "SUCCESS").select(*keys, F.col("table").alias("name")).distinct()
        inventory = inventory.join(bad.withColumn("_failed", F.lit(True)), [*keys, "name"], "left")
        failed = F.coalesce("_failed", F.lit(False))
    unreadable = F.col("row_count") < 0
    details = {
        "name": F.col("name"),
        "slug": F.col("slug"),
        "rowCount": F.col("row_count").cast("string"),
    }
    if with_schema:
        details["schemaPath"] = F.concat(F.lit("schema/tables/slug="), F.col("slug"))
    told = _map(**details)
    if sums:
        told = F.map_concat(told, F.map_filter(_map(**sums), lambda _, value: value.isNotNull()))
    return inventory.select(
        *keys,
        F.lit("table").alias("category"),
        "name",
        F.when(unreadable, "FAILED").when(failed, "PARTIAL").otherwise("SUCCESS").alias("status"),
        F.when(unreadable, F.lit(0.0)).otherwise(F.lit(TABLE_CONFIDENCE)).alias("confidence"),
        F.when(unreadable, TABLE_FAILED_REASON)
        .when(failed, TABLE_PARTIAL_REASON)
        .otherwise(TABLE_REASON)
        .alias("reason"),
        told.alias("details"),
    )


def relationship_coverage(rels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return rels.select(
        *keys,
        F.lit("relationship").alias("category"),
        "name",
        F.lit("SUCCESS").alias("status"),
        F.lit(RELATIONSHIP_CONFIDENCE).alias("confidence"),
        F.lit(RELATIONSHIP_REASON).alias("reason"),
        _map(
            fromTable=F.col("from_table"),
            toTable=F.col("to_table"),
            fromColumns=F.to_json("from_columns"),
            toColumns=F.to_json("to_columns"),
        ).alias("details"),
    )


def query_coverage(
    q: DataFrame,
    dialect: str = "NONE",
    bar: float = SUCCESS_BAR,
    mode: str = "compat",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """A row per query and, with a dialect, a second one for its translation, from a single scan.

    Rows are doubled before anything is computed: each computes only its own half, and a caller that needs
    a count or the status alone leaves the rest out of the plan.
    """
    sql, translation = F.col("sql"), F.col("_translation")
    halves = [False] if dialect.upper() == "NONE" else [False, True]
    rows = q.select(*keys, "name", "sql", F.explode(F.array(*map(F.lit, halves))).alias("_translation"))
    lower, blank = F.col("_lower"), F.col("_blank")
    work = rows.withColumns(
        {
            "_lower": sql_text.lowered(sql),
            "_blank": F.when(translation, sql_text.is_blank(sql)),
            "_found": F.when(~translation, sql_text.found_sources(F.coalesce(sql, F.lit("")), mode)),
        }
    ).withColumn("_head", F.when(~translation, sql_text.head_of(lower)))
    confidence = sql_text.confidence(
        sql_text.has_untranslated_calls(lower), sql_text.has_wildcards(lower), blank
    )
    facts = work.select(
        *keys, "name", "_translation", "_head", "_found", F.when(translation, confidence).alias("_confidence")
    )
    return facts.select(
        *keys,
        F.when(translation, "query-translation").otherwise("query").alias("category"),
        "name",
        F.when(translation, translation_status(F.col("_confidence"), bar)).otherwise("SUCCESS").alias("status"),
        F.when(translation, F.col("_confidence")).otherwise(F.lit(QUERY_CONFIDENCE)).alias("confidence"),
        F.when(translation, TRANSLATION_NOTE).otherwise(QUERY_REASON).alias("reason"),
        F.when(translation, _map(dialect=F.lit(dialect.upper())))
        .otherwise(
            _map(
                dependencies=F.to_json(sql_text.dependencies(F.col("_found"), mode)),
                type=sql_text.query_class(F.col("_head")),
            )
        )
        .alias("details"),
    )


def unrecovered_coverage(spark: SparkSession, full_fidelity: str = "AUTO") -> DataFrame:
    """The kinds of object that file parsing alone never recovers."""
    reason = HELPER_OFF if full_fidelity == "OFF" else HELPER_MISSING
    rows = [(kind, "*", "UNSUPPORTED", 0.0, reason, {}) for kind in UNRECOVERED]
    return local_rows(spark, rows, COVERAGE)


def unrecovered_in_each(sources: DataFrame, keys: tuple[str, ...], full_fidelity: str = "AUTO") -> DataFrame:
    """The same rows for every source of a listing."""
    reason = HELPER_OFF if full_fidelity == "OFF" else HELPER_MISSING
    kinds = F.explode(F.array(*map(F.lit, UNRECOVERED)))
    return sources.select(*keys).distinct().select(
        *keys,
        kinds.alias("category"),
        F.lit("*").alias("name"),
        F.lit("UNSUPPORTED").alias("status"),
        F.lit(0.0).alias("confidence"),
        F.lit(reason).alias("reason"),
        F.create_map().cast("map<string,string>").alias("details"),
    )


def failed_database(spark: SparkSession, name: str, error: str) -> DataFrame:
    return local_rows(spark, [("database", name, "FAILED", 0.0, DATABASE_REASON, {"exception": error})], COVERAGE)


def failed_sources(failures: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The same row for every source of a listing with the ``reason`` why it could not be opened."""
    return failures.select(
        *keys,
        F.lit("database").alias("category"),
        F.col(keys[0]).alias("name"),
        F.lit("FAILED").alias("status"),
        F.lit(0.0).alias("confidence"),
        F.lit(DATABASE_REASON).alias("reason"),
        _map(exception=F.col("reason")).alias("details"),
    )


def diagnostics_of(rows: DataFrame, code: Column, severity: str, message: Column, kind: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row of the diagnostics ledger for each of the rows, whose object is named by a column."""
    return rows.select(
        *keys,
        code.alias("code"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.lit(kind).alias("object_type"),
        F.col(name).alias("object_name"),
        F.create_map().cast("map<string,string>").alias("details"),
    )


def coverage_ledger(
    spark: SparkSession,
    inventory: DataFrame | None = None,
    relationships: DataFrame | None = None,
    queries: DataFrame | None = None,
    dialect: str = "NONE",
    exports: DataFrame | None = None,
    full_fidelity: str = "AUTO",
    with_schema: bool = True,
    keys: tuple[str, ...] = (),
    sources: DataFrame | None = None,
) -> DataFrame:
    """one row per object of a source, or with ``keys`` and a listing of ``sources``, of all of them."""
    parts = []
    if inventory is not None:
        parts.append(table_coverage(inventory, exports, with_schema, keys))
    if relationships is not None:
        parts.append(relationship_coverage(relationships, keys))
    if queries is not None:
        parts.append(query_coverage(queries, dialect, keys=keys))
    if sources is None:
        parts.append(unrecovered_coverage(spark, full_fidelity))
    else:
        parts.append(unrecovered_in_each(sources, keys, full_fidelity))
    return union_all(parts)


def coverage_summary(coverage: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """entries per status, and ``total``. Only the few counts are doubled for it, not the entries."""
    counts = coverage.groupBy(*keys, F.lower("status").alias("status")).agg(F.count(F.lit(1)).alias("_n"))
    both = counts.select(*keys, F.explode(F.array("status", F.lit("total"))).alias("status"), "_n")
    return both.groupBy(*keys, "status").agg(F.sum("_n").alias("n"))


def diagnostics_ledger(*parts: DataFrame, stamped: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """warnings and errors of all steps. ``stamped`` adds the time of the run."""
    united = union_all(part.select(*keys, *DIAGNOSTIC_COLUMNS) for part in parts)
    return united.withColumn("timestamp", F.current_timestamp()) if stamped else united


def fidelity_diagnostics(spark: SparkSession, full_fidelity: str) -> DataFrame:
    """Full fidelity needs automation that file parsing cannot offer."""
    rows = (
        [("FULL_FIDELITY_UNAVAILABLE", "warning", FIDELITY_MISSING, "environment", "windows-helper", {})]
        if full_fidelity == "ON"
        else []
    )
    return local_rows(spark, rows, DIAGNOSTICS)


def diagnostic(
    spark: SparkSession, code: str, severity: str, message: str, kind: str, name: str, **details: str
) -> DataFrame:
    """One row of the diagnostics ledger."""
    return local_rows(spark, [(code, severity, message, kind, name, details)], DIAGNOSTICS)


def counts_in_each(
    sources: DataFrame, counted: Mapping[str, DataFrame | None], keys: tuple[str, ...]
) -> DataFrame:
    """F4 for every source of a listing: each kind is counted for all sources in one job."""
    kinds = F.explode(F.array(*map(F.lit, (*COUNTED_KINDS, *UNCOUNTED_KINDS))))
    parts = [sources.select(*keys).distinct().select(*keys, kinds.alias("kind"), F.lit(0).cast("bigint").alias("n"))]
    for kind, rows in counted.items():
        if rows is not None:
            counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            parts.append(counts.select(*keys, F.lit(kind).alias("kind"), "n"))
    return union_all(parts).groupBy(*keys, "kind").agg(F.sum("n").alias("n"))


def inventory_counts(spark: SparkSession, counted: Mapping[str, DataFrame | None]) -> DataFrame:
    """objects by kind; kinds that are never recovered stay at zero."""
    parts = []
    for kind in COUNTED_KINDS:
        rows = counted.get(kind)
        if rows is not None:
            parts.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n"))
    absent = [kind for kind in COUNTED_KINDS if counted.get(kind) is None]
    zeros = local_rows(spark, [(kind, 0) for kind in (*absent, *UNCOUNTED_KINDS)], "kind string, n bigint")
    return union_all([*parts, zeros])


def referenced_artifacts(coverage: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Artifacts that coverage entries say were written."""
    path = F.col("details")["schemaPath"]
    return coverage.where(path.isNotNull()).select(*keys, "category", "name", path.alias("path"))


def missing_artifacts(referenced: DataFrame, present: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """references whose ``path`` is not among the ``path`` values of the listing, per source with ``keys``."""
    place = [*keys, "path"]
    return referenced.join(present.select(*place).distinct(), place, "left_anti").select(
        *keys, "category", "name", "path"
    )


def validation_diagnostics(missing: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One warning with the number of missing artifacts, none if there are none."""
    count = F.col("n").cast("string")
    return missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        *keys,
        F.lit("VALIDATION_MISSING_ARTIFACTS").alias("code"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit(MISSING_ARTIFACTS), count).alias("message"),
        F.lit("validation").alias("object_type"),
        F.lit("artifacts").alias("object_name"),
        _map(count=count).alias("details"),
    )


def object_inventory(coverage: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """one Markdown line per coverage entry, by category and name."""
    line = F.format_string(
        "- `%s` `%s` `%s` confidence=%.2f", F.col("category"), F.col("name"), F.col("status"), F.col("confidence")
    )
    ordered = coverage.orderBy(*keys, "category", "name", "status", "confidence")
    return ordered.select(*keys, line.alias("line"))


def run_summary(coverage: DataFrame, diagnostics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """sizes of the ledgers, exit code and closing status of a run, in one row, or one per source."""
    # Entries are counted beside diagnostics, so both ledgers are reduced in one aggregate.
    entries = coverage.select(*keys, F.lit(True).alias("_entry"), F.lit("").alias("severity"))
    found = diagnostics.select(*keys, F.lit(False).alias("_entry"), "severity")
    entry, error = F.col("_entry"), F.col("severity") == "error"
    sizes = entries.unionByName(found).groupBy(*keys).agg(
        F.count_if(entry).alias("coverage_entries"),
        F.count_if(~entry & ~error).alias("warnings"),
        F.count_if(~entry & error).alias("errors"),
    )
    return sizes.select(
        *keys,
        "coverage_entries",
        "warnings",
        "errors",
        F.when(F.col("errors") == 0, 0).otherwise(2).alias("exit_code"),
        F.when(F.col("errors") > 0, "Completed with issues")
        .when(F.col("warnings") > 0, "Completed with warnings")
        .otherwise("Completed cleanly")
        .alias("status"),
    )


def manifest(options: UnpackOptions, counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """F8: one nested row, or one per source: what was asked for, and what was found. ``counts`` has one row per kind."""
    found = counts.groupBy(*keys).agg(
        F.struct(
            *[
                F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
                for kind in (*COUNTED_KINDS, *UNCOUNTED_KINDS)
            ]
        ).alias("inventory")
    )
    return found.select(
        *keys,
        F.lit(options.input).alias("input"),
        F.lit(options.output).alias("output"),
        F.lit(options.text_encoding).alias("text_encoding"),
        F.struct(
            F.lit(options.extract_schema).alias("schema"),
            F.lit(options.extract_data).alias("data"),
            F.lit(options.extract_queries).alias("queries"),
            F.lit(options.write_docs).alias("docs"),
        ).alias("selected_scopes"),
        _selection(options.selected_tables).alias("selected_tables"),
        _selection(options.selected_queries).alias("selected_queries"),
        "inventory",
    )


def _selection(selection) -> Column:
    # A selection of unknown length is named, not copied into the one manifest row.
    if isinstance(selection, DataFrame):
        return F.array(F.lit("(from a table of names)"))
    return F.array(*[F.lit(name) for name in sorted(set(selection or ()))]).cast("array<string>")


def db_info(files: DataFrame, properties: DataFrame, key: str = "source") -> DataFrame:
    """file facts with the properties of each file, one row per property.

    Long form on purpose: one source may hold a large share of all properties, which one map could not.
    Files without properties keep one row. Properties are parsed once, into a scratch table: finding hot sources, looking files up and
    finding those without properties read that.
    """
    properties = written_once(properties.select(key, "scope", "key", "value"), "db-info")
    facts = [c for c in files.columns if c != key]
    listed = lookup_join(properties, files, [key], "inner").select(key, *facts, "scope", "key", "value")
    bare = files.join(properties.select(key).distinct(), key, "left_anti")
    return listed.unionByName(bare.select(key, *facts), allowMissingColumns=True)


def table_schemas(
    inventory: DataFrame, columns: DataFrame, indexes: DataFrame | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """one nested row per table, of one source or with ``keys`` of many.

    ``created`` and ``updated`` are those of the inventory, if it has any. What is gathered per table is its column list and
    its index list, which are schema-sized: the longest one is as wide as the widest table.
    """
    measured = ("length", "variable_length", "auto_number")
    column = F.struct("position", "name", "slug", "type", *[c for c in measured if c in columns.columns])
    per_table = columns.groupBy(*keys, F.col("table").alias("name")).agg(
        F.array_sort(F.collect_list(column)).alias("columns")
    )
    dates = [
        F.col(c) if c in inventory.columns else F.lit(None).cast("timestamp").alias(c) for c in ("created", "updated")
    ]
    listed = inventory.select(*keys, "name", "slug", "system_object", "row_count", *dates)
    result = listed.join(per_table, [*keys, "name"], "left")
    if indexes is None:
        return result.withColumn(
            "indexes",
            F.array().cast("array<struct<name:string,primary_key:boolean,unique:boolean,columns:array<string>>>"),
        )
    index = F.struct("name", "primary_key", "unique", "columns")
    gathered = indexes.groupBy(*keys, F.col("table").alias("name")).agg(F.array_sort(F.collect_list(index)).alias("indexes"))
    return result.join(gathered, [*keys, "name"], "left")
