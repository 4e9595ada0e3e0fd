"""One whole run over one source or over many (G1)."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvage.functions.names import distinct_slugs
from salvage.functions.text import encode_text
from salvage.operators import audit, corpus, ledger, sinks
from salvage.operators.scope import select_objects
from salvage.options import UnpackOptions
from salvage.session import local_rows, side_by_side, union_all
from salvage.sources import tables as source_tables
from salvage.sources.dumps import STALE_ON_OPEN, dump_catalog, link_diagnostics, resolve_links, stale_link_hints


@dataclass(frozen=True)
class Declarations:
    """What a source says about itself beyond its tables.

    ``queries`` is a corpus (``name``, ``sql``), which may be as large as any table, and so may be ``properties`` (``source``, which
    is the name of a file below the input, ``scope`` and a map ``props``), ``linked_properties`` (``name`` and a map ``properties``) and
    ``links`` (``source_dir``, ``linked_path``), which are looked up among the ``dir, file_name`` of ``dump_files``. The others are
    schema-sized listings.
    """

    queries: DataFrame | None = None
    keys: Iterable[audit.Key] = ()
    relationships: Iterable[audit.Relationship] = ()
    system: Collection[str] = ()
    linked: Collection[str] = ()
    properties: DataFrame | None = None
    linked_properties: DataFrame | None = None
    links: DataFrame | None = None
    dump_files: DataFrame | None = None


@dataclass(frozen=True)
class UnpackResult:
    """Ledgers of a run, read back from what it wrote."""

    output: str
    coverage: DataFrame
    diagnostics: DataFrame
    counts: DataFrame
    manifest: DataFrame

    @property
    def summary(self) -> DataFrame:
        return ledger.run_summary(self.coverage, self.diagnostics)


def unpack(
    spark: SparkSession, options: UnpackOptions, declared: Declarations | None = None
) -> UnpackResult:
    """Inventory and export one source; a failure is a ledger entry, not an exception.

    With ``options.audit`` the declared keys and relationships are checked against the data, and those that do not hold are
    warnings. Links and file properties are looked up where they are declared.

    Every artifact is one Spark write below ``options.output``, and the returned ledgers read the written
    ones, so asking for them again repeats no work.
    """
    options.check_scopes()
    run = _Run(spark, options, declared or Declarations())
    try:
        run.tables()
        run.links()
        run.info()
        run.queries()
    except Exception as error:
        run.failed(error)
    return run.close()


class _Run:
    def __init__(self, spark: SparkSession, options: UnpackOptions, declared: Declarations) -> None:
        self.spark, self.options, self.declared = spark, options, declared
        self.step = "tables"
        self.coverage: list[DataFrame] = []
        self.diagnostics = [ledger.fidelity_diagnostics(spark, options.full_fidelity)]
        self.counted: dict[str, DataFrame] = {}
        self.exported: list[str] = []

    def _path(self, name: str) -> str:
        return f"{self.options.output.rstrip('/')}/{name}"

    def _write(self, *artifacts: tuple) -> None:
        """Write independent artifacts, each a frame, its place and how it is written, side by side."""

        def write(artifact: tuple) -> None:
            df, name, kind, *partitions = artifact
            df.write.mode("overwrite").partitionBy(*partitions).format(kind).save(self._path(name))

        side_by_side(write, artifacts, self.options.parallel_jobs)

    def tables(self) -> None:
        options, declared = self.options, self.declared
        if not (options.extract_schema or options.extract_data):
            return
        failures: dict[str, str] = {}
        unknown: dict[str, str] = {}
        hidden = () if options.include_system_objects else declared.system
        tables = source_tables.load_tables(
            self.spark, options.input, options.selected_tables, failures, source_tables.READERS, hidden, unknown
        )
        dates: dict[str, tuple] = {}
        rows, broken = source_tables.readable_tables(tables, options.parallel_jobs, dates)
        failures.update(broken)
        readable = {name: tables[name] for name in rows}
        slugs = distinct_slugs([*rows, *failures])
        listing = local_rows(
            self.spark,
            [
                (
                    name,
                    slugs[name],
                    name in declared.system,
                    name in declared.linked,
                    rows.get(name, source_tables.UNREADABLE),
                    len(readable[name].columns) if name in readable else 0,
                    *dates.get(name, (None, None)),
                )
                for name in source_tables.by_name(slugs)
            ],
            "name string, slug string, system_object boolean, linked boolean, row_count bigint, column_count int, "
            "created timestamp, updated timestamp",
        )
        self.counted["tables"] = listing
        for name, message in failures.items():
            self.diagnostics.append(
                ledger.diagnostic(self.spark, "PREFLIGHT_SCAN_FAILED", "warning", message, "table", name)
            )

        for name, message in unknown.items():
            self.diagnostics.append(ledger.diagnostic(self.spark, "TABLE_FORMAT_UNKNOWN", "warning", message, "file", name))

        exports = None
        if options.extract_data:
            self.step = "data"
            exports = sinks.export_tables(
                self.spark, readable, options.output.rstrip("/"), options.formats,
                options.text_encoding, options.typed_parquet, slugs, options.parallel_jobs,
            )
            exports = self._checked(exports)
            self.diagnostics.append(sinks.export_diagnostics(exports))
        if options.extract_schema:
            self.step = "schema"
            self._schema(readable, listing)
        if options.audit:
            self.step = "audit"
            self._audit(readable)
        self.coverage.append(ledger.table_coverage(listing, exports, options.extract_schema))

    def _checked(self, exports: DataFrame) -> DataFrame:
        """The exports with their checksums; hashes of all parts and the ledger are written, and read back."""
        self.exported = written = [self._path(r.path) for r in exports.where("status = 'SUCCESS'").select("path").collect()]
        if written:
            self._write((sinks.artifact_checksums(self.spark, *written), "data-checksums", "json"))
            parts = self.spark.read.schema(sinks.PARTS).json(self._path("data-checksums"))
            exports = sinks.with_checksums(exports, parts)
        self._write((exports, "data-ledger", "json"))
        return self.spark.read.schema(exports.schema).json(self._path("data-ledger"))

    def _schema(self, readable: Mapping[str, DataFrame], listing: DataFrame) -> None:
        declared = self.declared
        key_rows = [(k.table, k.name, k.primary_key, k.unique, list(k.columns)) for k in declared.keys]
        keys = local_rows(self.spark, key_rows, audit.KEYS)
        columns = source_tables.column_inventory(readable)
        schemas = ledger.table_schemas(listing, columns, keys)
        selected = self.options.selected_tables
        self._write(
            (schemas, "schema/tables", "json", "slug"),
            (audit.linked_tables(listing, declared.linked_properties), "schema/linked-tables", "json"),
            (audit.system_objects(listing), "schema/system-objects", "json"),
            (audit.declared_keys(keys, selected), "schema/indexes", "json"),
        )

        self.step = "relationships"
        rel_rows = [
            (
                r.name, r.from_table, r.to_table, list(r.from_columns), list(r.to_columns),
                r.cascade_deletes, r.cascade_updates,
            )
            for r in declared.relationships
        ]
        try:
            rels = audit.declared_relationships(local_rows(self.spark, rel_rows, audit.RELATIONSHIPS), selected)
            self._write(
                (rels, "schema/relationships", "json"), (audit.constraints(rels), "schema/constraints", "json")
            )
            self.counted["relationships"] = rels
            self.coverage.append(ledger.relationship_coverage(rels))
        except Exception as error:
            self.diagnostics.append(
                ledger.diagnostic(
                    self.spark, "RELATIONSHIP_EXTRACTION_PARTIAL", "warning", str(error), "relationship", "*"
                )
            )

    def _audit(self, readable: Mapping[str, DataFrame]) -> None:
        """Declared keys and relationships against the data; one that names a missing table or column is a warning of its own."""
        def columns(table: str) -> set[str]:
            return set(readable[table].columns) if table in readable else set()

        keys = [k for k in self.declared.keys if set(k.columns) <= columns(k.table) and k.columns]
        rels = [
            r for r in self.declared.relationships
            if set(r.from_columns) <= columns(r.from_table) and set(r.to_columns) <= columns(r.to_table) and r.from_columns
        ]
        unknown = [("key", k.name) for k in self.declared.keys if k not in keys]
        unknown += [("relationship", r.name) for r in self.declared.relationships if r not in rels]
        for kind, name in unknown:
            self.diagnostics.append(
                ledger.diagnostic(self.spark, "AUDIT_NOT_POSSIBLE", "warning", "A table or column it names is not there", kind, name)
            )
        found = {}
        if keys:
            found["keys"] = audit.audit_keys(readable, keys), "KEY_DOES_NOT_HOLD", "key"
        if rels:
            found["relationships"] = audit.audit_relationships(readable, rels), "RELATIONSHIP_DOES_NOT_HOLD", "name"
        self._write(*[(rows, f"audit/{what}", "json") for what, (rows, _, _) in found.items()])
        for what, (rows, code, name) in found.items():
            broken = self.spark.read.schema(rows.schema).json(self._path(f"audit/{what}")).where("NOT holds")
            message = F.concat(F.lit("The data does not keep to "), F.col(name))
            self.diagnostics.append(ledger.diagnostics_of(broken, F.lit(code), "warning", message, what.rstrip("s"), name))

    def links(self) -> None:
        declared = self.declared
        if declared.links is None or declared.dump_files is None:
            return
        self.step = "links"
        resolved = resolve_links(declared.links, declared.dump_files)
        self._write((resolved, "links", "json"))
        self.diagnostics.append(link_diagnostics(self.spark.read.schema(resolved.schema).json(self._path("links"))))

    def info(self) -> None:
        """Size, hash and properties of every file of the source."""
        if self.declared.properties is None:
            return
        self.step = "info"
        files = dump_catalog(self.spark, self.options.input).withColumnRenamed("file_name", "source")
        files = files.select("source", "extension", "size_bytes", "sha256")
        self._write((ledger.db_info(files, audit.property_rows(self.declared.properties)), "db-info", "json"))

    def queries(self) -> None:
        options = self.options
        if not options.extract_queries or self.declared.queries is None:
            return
        self.step = "queries"
        chosen = select_objects(self.declared.queries.select("name", "sql"), options.selected_queries)
        models = corpus.query_models(chosen)
        text = models.select("name", "slug", "sql")
        artifacts = [
            (encode_text(text, "sql", options.text_encoding, "content").drop("sql"), "queries/raw", "parquet"),
            (models, "queries/model", "json"),
            (corpus.dependency_edges(chosen), "queries/dependency-graph", "json"),
        ]
        if options.translate_sql != "NONE":
            translated = corpus.translate_queries(chosen, options.translate_sql)
            written = encode_text(
                translated.where(F.col("translated").isNotNull()).select("name", "translated"),
                "translated", options.text_encoding, "content",
            )
            artifacts.append(
                (written.drop("translated"), f"queries/translated/{options.translate_sql.lower()}", "parquet")
            )
        self._write(*artifacts)
        # Only now is it known that the corpus can be read.
        if options.translate_sql != "NONE":
            self.diagnostics.append(corpus.translation_ledger(translated, options.translate_sql)[0])
        self.counted["queries"] = chosen
        self.coverage.append(ledger.query_coverage(chosen, options.translate_sql))

    def failed(self, error: Exception) -> None:
        name = self.options.input.rstrip("/").rsplit("/", 1)[-1]
        message = str(error) or type(error).__name__
        hint = stale_link_hints(local_rows(self.spark, [(message,)], "message string")).first()
        if hint["is_stale_windows_path"]:
            self.diagnostics.append(
                ledger.diagnostic(
                    self.spark, "LINKED_DB_PATH_UNAVAILABLE", "warning",
                    "Detected a stale Windows linked-table path during open", "database", name,
                    linkedPathHint=message,
                )
            )
        self.diagnostics.append(
            ledger.diagnostic(
                self.spark, "DATABASE_OPEN_FAILED", "error",
                STALE_ON_OPEN if hint["is_stale_windows_path"] else message,
                "database", name, step=self.step,
            )
        )
        self.coverage.append(ledger.failed_database(self.spark, name, message))

    def close(self) -> UnpackResult:
        spark, options = self.spark, self.options
        self.coverage.append(ledger.unrecovered_coverage(spark, options.full_fidelity))
        self._write((union_all(self.coverage), "coverage", "json"))
        coverage = spark.read.schema(ledger.COVERAGE).json(self._path("coverage"))
        if options.validate:
            referenced, present = ledger.referenced_artifacts(coverage), self._present()
            if self.exported:
                parts = spark.read.schema(sinks.PARTS).json(self._path("data-checksums"))
                referenced = referenced.unionByName(_part_references(parts))
                present = present.unionByName(self._files("data").select(_within("path", 3).alias("path")))
            missing = ledger.missing_artifacts(referenced, present)
            self.diagnostics.append(ledger.validation_diagnostics(missing))
        diagnostics = ledger.diagnostics_ledger(*self.diagnostics, stamped=True)
        counts = ledger.inventory_counts(spark, self.counted)
        made = ledger.manifest(options, counts)
        artifacts = [
            (diagnostics, "diagnostics", "json", "severity"),
            (counts, "inventory", "json"),
            (made, "manifest", "json"),
        ]
        if options.write_docs:
            artifacts += [
                (ledger.object_inventory(coverage), "docs/object-inventory", "text"),
                (ledger.coverage_summary(coverage), "docs/coverage-summary", "json"),
            ]
        self._write(*artifacts)
        written = spark.read.schema(ledger.DIAGNOSTICS + ", timestamp timestamp").json(self._path("diagnostics"))
        return UnpackResult(
            options.output,
            coverage,
            written,
            spark.read.schema("kind string, n bigint").json(self._path("inventory")),
            spark.read.schema(made.schema).json(self._path("manifest")),
        )

    def _present(self) -> DataFrame:
        """Folders below the output that hold a part file, relative to it."""
        if not self.options.extract_schema or "tables" not in self.counted:
            return local_rows(self.spark, [], "path string")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("schema/tables"))
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return local_rows(self.spark, [], "path string")
        folder = F.regexp_extract("path", r"(schema/tables/[^/]+)/[^/]*$", 1)
        return self._files("schema/tables").select(folder.alias("path"))

    def _files(self, name: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self._path(name))


def _within(path: str, steps: int) -> Column:
    """The last steps of a path, whatever its store is called."""
    return F.array_join(F.slice(F.split(path, "/"), -steps, steps), "/")


def _part_references(parts: DataFrame) -> DataFrame:
    """The recorded part files of all exports as references that validation looks for."""
    return parts.select(
        F.lit("export").alias("category"), F.element_at(F.split("artifact", "/"), -1).alias("name"),
        _within("artifact", 2).alias("folder"), "part",
    ).select("category", "name", F.concat_ws("/", "folder", "part").alias("path"))


def unpack_many(
    spark: SparkSession,
    sources: Mapping[str, UnpackOptions],
    declared: Mapping[str, Declarations] | None = None,
    parallelism: int = 4,
) -> dict[str, UnpackResult]:
    """Unpack several sources side by side; each writes to its own output and fails on its own.

    A run that cannot even write its ledgers, or whose selection is empty, comes back as a failed source whose ledgers
    were never written.
    """
    declared = declared or {}

    def one(item: tuple[str, UnpackOptions]) -> tuple[str, UnpackResult]:
        source_id, options = item
        try:
            return source_id, unpack(spark, options, declared.get(source_id))
        except Exception as error:
            return source_id, _never_ran(spark, options, str(error) or type(error).__name__)

    alone = any(options.text_encoding in ("WINDOWS_31J", "SHIFT_JIS") for options in sources.values())
    return dict(side_by_side(one, sources.items(), 1 if alone else parallelism))


def _never_ran(spark: SparkSession, options: UnpackOptions, message: str) -> UnpackResult:
    name = options.input.rstrip("/").rsplit("/", 1)[-1]
    error = ledger.diagnostic(spark, "DATABASE_OPEN_FAILED", "error", message, "database", name, step="run")
    counts = ledger.inventory_counts(spark, {})
    return UnpackResult(
        options.output,
        ledger.failed_database(spark, name, message),
        ledger.diagnostics_ledger(error, stamped=True),
        counts,
        ledger.manifest(options, counts),
    )


def labelled(results: Mapping[str, UnpackResult]) -> DataFrame:
    """Coverage of many sources as one ledger, each row with its source."""
    return union_all(
        result.coverage.withColumn("source_id", F.lit(source)) for source, result in results.items()
    )
