"""One whole run over a lake of many sources, in a number of jobs that does not grow with them (G1).

The same work as ``unpack`` for each source, but every step covers all sources: one listing, one scan of counts for each format, one
export for each format and *shape* of table (tables with the same columns, as the copies of one application have them), and ledgers
whose rows carry their ``source_id`` and are written partitioned by it; only the texts of the corpus are not, which would shuffle them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salvage.functions.names import slugged
from salvage.functions.text import encode_text
from salvage.operators import audit, corpus, ledger, sinks
from salvage.operators.scope import drop_system, select_objects
from salvage.options import UnpackOptions
from salvage.plans.lake_audit import LakeTables, audit_lake_keys, audit_lake_relationships
from salvage.session import local_rows, side_by_side
from salvage.sources import lake as lakes
from salvage.sources.dumps import link_diagnostics, resolve_links, stale_link_hints
from salvage.sources.files import literal, qualified, written_once
from salvage.sources.tables import READERS, UNREADABLE, column_inventory

LAKE = ("source_id",)
# Folders of the exports that say whose rows they hold; a table with a column of that name gets underscores behind it.
PLACES = ("lake_source", "lake_table")
# Tables of one shape that one scan reads; the names of their folders go through the driver, as its file index does.
TABLES_AT_ONCE = 10_000
# Artifacts that hold texts of the corpus.
CORPUS = "queries/"
NOTHING_WRITTEN = "no rows came out"


@dataclass(frozen=True)
class LakeDeclarations:
    """What the sources say about themselves beyond their tables; every listing has a ``source_id`` and may be of any length.

    ``queries`` has ``name, sql``; ``keys`` and ``relationships`` have the columns of ``audit.KEYS`` and ``audit.RELATIONSHIPS``;
    ``flags`` has ``name, system_object, linked`` of the tables that are either; ``links`` has ``source_dir, linked_path``, which are
    looked up among the ``dir, file_name`` of ``dump_files`` (which needs no source).
    """

    queries: DataFrame | None = None
    keys: DataFrame | None = None
    relationships: DataFrame | None = None
    flags: DataFrame | None = None
    links: DataFrame | None = None
    dump_files: DataFrame | None = None


@dataclass(frozen=True)
class LakeResult:
    """Ledgers of a run over a lake, read back from what it wrote."""

    output: str
    coverage: DataFrame
    diagnostics: DataFrame
    counts: DataFrame
    manifest: DataFrame
    exports: DataFrame | None
    key_audits: DataFrame | None = None
    relationship_audits: DataFrame | None = None

    @property
    def summary(self) -> DataFrame:
        return ledger.run_summary(self.coverage, self.diagnostics, LAKE)


def unpack_lake(spark: SparkSession, options: UnpackOptions, declared: LakeDeclarations | None = None) -> LakeResult:
    """Inventory and export all sources below ``options.input``; what fails is a row of a ledger, not an exception.

    A broken table fails alone: one that cannot be counted is left out of the exports, and an export that fails is
    halved until what fails is a single table, so each such table costs a few jobs more. Rows that come out of an export are counted
    against those that went in, for Parquet and JSON; CSV, which only a parser can count, must have come out at all.
    Exports lie in ``data/<format>/<shape>/lake_source=<source>/lake_table=<file name>``; tables without rows leave none. Names that share a
    slug within a source get ``~2``, ``~3``, ... A folder of an earlier run that this one does not write again stays; the ledger names
    those of this run.
    """
    options.check_scopes()
    run = _LakeRun(spark, options, declared or LakeDeclarations())
    run.tables()
    run.relationships()
    run.links()
    run.queries()
    return run.close()


class _LakeRun:
    def __init__(self, spark: SparkSession, options: UnpackOptions, declared: LakeDeclarations) -> None:
        self.spark, self.options, self.declared = spark, options, declared
        self.root = qualified(spark, options.input).rstrip("/")
        self.files = written_once(lakes.lake_files(spark, options.input), "lake-files")
        opened = (F.col("name") != "") | F.col("reason").isNull()
        self.closed = self.files.where(~opened).select(*LAKE, "reason").distinct()
        self.sources = self.files.select(*LAKE).distinct()
        self.coverage: list[DataFrame] = [ledger.failed_sources(self.closed, LAKE)]
        self.diagnostics: list[DataFrame] = [
            ledger.diagnostics_of(self.closed, F.lit("DATABASE_OPEN_FAILED"), "error", F.col("reason"), "database", "source_id", LAKE)
        ]
        self.counted: dict[str, DataFrame] = {}
        self.exports: DataFrame | None = None
        self.audits: dict[str, DataFrame] = {}

    def _path(self, name: str) -> str:
        return f"{self.options.output.rstrip('/')}/{name}"

    def _write(self, *artifacts: tuple) -> None:
        def write(artifact: tuple) -> None:
            df, name, kind = artifact
            if name.startswith(CORPUS):
                # Texts of any length stay where they are: no shuffle, and the source is a column, as one task may hold many.
                df.write.mode("overwrite").format(kind).save(self._path(name))
            else:
                # A source with a third of all rows fills several files, many small ones share a task.
                df.hint("rebalance", *LAKE).write.mode("overwrite").partitionBy(*LAKE).format(kind).save(self._path(name))

        side_by_side(write, artifacts, self.options.parallel_jobs)

    def _read(self, name: str, schema, kind: str = "json") -> DataFrame:
        return self.spark.read.schema(schema).format(kind).load(self._path(name))

    # Tables

    def tables(self) -> None:
        options = self.options
        if not (options.extract_schema or options.extract_data):
            return
        listing = self._listing()
        tables = listing.where(F.col("shape").isNotNull() & (F.col("row_count") >= 0))
        tables = tables.select("shape", "format", "folder", F.col("row_count") > 0).collect()
        frames, lost = self._opened(tables)
        # A shape that no reader opens takes its tables with it.
        why = local_rows(self.spark, list(lost.items()), "folder string, _why string")
        readable = F.col("_why").isNull()
        listing = listing.join(why, "folder", "left").withColumns({
            "row_count": F.when(readable, F.col("row_count")).otherwise(F.lit(UNREADABLE).cast("bigint")),
            "reason": F.coalesce("_why", "reason"),
        }).drop("_why")
        columns = column_inventory({label: frame for label, (frame, _) in frames.items()})
        shaped = columns.withColumnRenamed("table", "_label").withColumn("shape", F.substring_index("_label", "-", 1))
        # Labels of one shape read alike.
        shaped = shaped.where(F.col("_label").endswith("-0")).drop("_label")
        listing = written_once(listing, "lake-tables")
        self.counted["tables"] = listing
        broken = stale_link_hints(listing.where("row_count < 0").withColumn("message", F.coalesce("reason", F.lit(lakes.NOT_COUNTED))))
        self.diagnostics.append(ledger.diagnostics_of(broken, F.col("code"), "warning", F.col("scan_message"), "table", "name", LAKE))

        if options.extract_data:
            self._export(listing, frames)
            self.diagnostics.append(sinks.export_diagnostics(self.exports, LAKE))
        entries = ledger.table_coverage(listing, self.exports, with_schema=False, keys=LAKE)
        if options.extract_schema:
            described = listing.where("row_count >= 0").select(*LAKE, F.col("name").alias("table"), "shape").join(shaped, "shape").drop("shape")
            schemas = ledger.table_schemas(listing, described, self.declared.keys, LAKE)
            self._write(
                (schemas, "schema/tables", "json"), (audit.linked_tables(listing, keys=LAKE), "schema/linked-tables", "json"),
                (audit.system_objects(listing, LAKE), "schema/system-objects", "json"),
            )
            place = F.create_map(F.lit("schemaPath"), F.concat(F.lit("schema/tables/source_id="), F.col("source_id")))
            entries = entries.withColumn("details", F.map_concat("details", place))
        self.coverage.append(entries)
        if options.audit:
            self._audit(listing, {label.split("-")[0]: set(frame.columns) for label, (frame, _) in frames.items()})

    def _audit(self, listing: DataFrame, columns: dict[str, set[str]]) -> None:
        """Declared keys and relationships of all sources against their tables."""
        options, declared = self.options, self.declared
        readable = listing.where("shape IS NOT NULL AND row_count >= 0").select(
            *LAKE, F.col("name").alias("table"), "shape", "format", "folder"
        )
        lake = LakeTables(readable, columns, self._foldered, options.parallel_jobs)
        asked = {
            "keys": (declared.keys, audit.declared_keys, audit_lake_keys, "KEY_DOES_NOT_HOLD", "key"),
            "relationships": (
                declared.relationships, audit.declared_relationships, audit_lake_relationships, "RELATIONSHIP_DOES_NOT_HOLD", "name",
            ),
        }
        for what, (declarations, chosen, checked, code, name) in asked.items():
            if declarations is None:
                continue
            rows = checked(lake, chosen(declarations, options.selected_tables, LAKE))
            self._write((rows, f"audit/{what}", "json"))
            self.audits[what] = rows = self._read(f"audit/{what}", rows.schema).select(rows.columns)
            bad = rows.where("reason IS NOT NULL OR NOT holds").withColumn(
                "_message", F.coalesce("reason", F.concat(F.lit("The data does not keep to "), F.col(name)))
            )
            codes = F.when(F.col("reason").isNull(), code).otherwise("AUDIT_NOT_POSSIBLE")
            self.diagnostics.append(ledger.diagnostics_of(bad, codes, "warning", F.col("_message"), what.rstrip("s"), name, LAKE))

    def _foldered(self, kind: str, folders: list[str]) -> tuple[DataFrame, str]:
        """The rows of tables, with the folder of each row in the last column."""
        frame, places = self._placed(self._rows(kind, folders))
        folder = "_".join(["lake_folder", *places])
        return frame.select("*", F.concat_ws("/", F.lit(self.root), *places).alias(folder)).drop(*places), folder

    def _listing(self) -> DataFrame:
        """Every table that is asked for, with its shape and flags, under a name and a slug of its own."""
        spark, options, flags = self.spark, self.options, self.declared.flags
        found = lakes.lake_table_inventory(spark, options.input, self.files).where("name <> '' OR reason IS NULL")
        shapes = lakes.lake_shapes(spark, options.input, self.files)
        found = found.join(shapes, [*LAKE, "name", "format"], "left")
        # One base name in two formats makes two tables, the later one under its full name.
        again = F.row_number().over(Window.partitionBy(*LAKE, "name").orderBy("format")) > 1
        found = found.withColumn("_again", again)
        found = found.withColumn("name", F.when(F.col("_again") & F.col("format").isNotNull(), F.concat_ws(".", "name", "format")).otherwise(F.col("name")))
        if flags is None:
            found = found.withColumns({"system_object": F.lit(False), "linked": F.lit(False)})
        else:
            known = flags.groupBy(*LAKE, "name").agg(F.bool_or("system_object").alias("_system"), F.bool_or("linked").alias("_linked"))
            found = found.join(known, [*LAKE, "name"], "left").withColumns(
                {"system_object": F.coalesce("_system", F.lit(False)), "linked": F.coalesce("_linked", F.lit(False))}
            )
        found = slugged(found.drop("slug"), "name")
        turn = F.row_number().over(Window.partitionBy(*LAKE, "slug").orderBy(F.lower("name"), "name"))
        found = found.withColumn("_turn", turn)
        found = found.withColumn("slug", F.when(F.col("_turn") > 1, F.concat_ws("~", "slug", "_turn")).otherwise(F.col("slug")))
        chosen = drop_system(select_objects(found, options.selected_tables), options.include_system_objects)
        return written_once(chosen.drop("_again", "_turn", "_system", "_linked"), "lake-listing")

    def _opened(self, tables: list) -> tuple[dict[str, tuple[DataFrame, list[str]]], dict[str, str]]:
        """A frame over all tables of a shape, and their folders, by label; and the reasons of folders that no reader opens."""
        shapes: dict[tuple[str, str], tuple[list[str], list[str]]] = {}
        for shape, kind, folder, has_rows in tables:
            shapes.setdefault((shape, kind), ([], []))[0 if has_rows else 1].append(folder)
        parts = []
        for (shape, kind), (filled, empty) in sorted(shapes.items()):
            # Tables without rows are only asked for their columns, and one tells those of all.
            chunks = [sorted(filled)[i : i + TABLES_AT_ONCE] for i in range(0, len(filled), TABLES_AT_ONCE)] or [[]]
            parts += [(f"{shape}-{i}", kind, chunk or empty[:1], chunk, empty if not i else []) for i, chunk in enumerate(chunks)]

        def opened(part: tuple) -> DataFrame | str:
            try:
                return self._rows(part[1], part[2])
            except Exception as error:
                return str(error) or type(error).__name__

        frames, lost = {}, {}
        for (label, _, _, filled, empty), frame in zip(parts, side_by_side(opened, parts, self.options.parallel_jobs)):
            if isinstance(frame, str):
                lost |= dict.fromkeys([*filled, *empty], frame)
            else:
                frames[label] = frame, filled
        return frames, lost

    def _rows(self, kind: str, folders: list[str]) -> DataFrame:
        return self.spark.read.format(kind).options(**READERS[kind]).load([literal(folder) for folder in folders])

    def _export(self, listing: DataFrame, frames: dict[str, tuple[DataFrame, list[str]]]) -> None:
        """Every format of every shape is one write from scan to files, without a shuffle; several run side by side."""
        options, spark = self.options, self.spark
        formats = dict(listing.where("shape IS NOT NULL").select("shape", "format").distinct().collect())
        tasks = [(label, frame, folders, kind) for label, (frame, folders) in frames.items() if folders for kind in options.formats]

        def export(task: tuple) -> list[tuple[str, str, str]]:
            label, frame, folders, kind = task
            try:
                if frame is None:
                    frame = self._rows(formats[label.split("-")[0]], folders)
                placed, places = self._placed(frame)
                target = self._path(f"data/{kind.lower()}/{label}")
                sinks.export_partitioned(placed, target, kind, places, options.text_encoding, options.typed_parquet)
                return []
            except Exception as error:
                # What the plan itself does not allow, it allows no half either.
                if len(folders) == 1 or isinstance(error, AnalysisException):
                    return [(folder, kind, str(error) or type(error).__name__) for folder in folders]
            half = len(folders) // 2
            return export((label + "a", None, folders[:half], kind)) + export((label + "b", None, folders[half:], kind))

        alone = options.text_encoding in ("WINDOWS_31J", "SHIFT_JIS")
        failed = [row for rows in side_by_side(export, tasks, 1 if alone else options.parallel_jobs) for row in rows]
        failed = local_rows(spark, failed, "folder string, format string, _why string")
        sums, written = self._written({kind for _, _, _, kind in tasks})
        asked = listing.where("row_count >= 0").select(
            *LAKE, F.col("name").alias("table"), "slug", "folder", F.col("row_count").alias("_rows"),
            F.explode(F.array(*map(F.lit, options.formats))).alias("format"),
        )
        asked = asked.withColumn("_entry", F.substring_index("folder", "/", -1))
        place = [*LAKE, "_entry", "format"]
        found = asked.join(failed, ["folder", "format"], "left").join(sums, place, "left").join(written, place, "left")
        counted = F.when(F.col("format") == "CSV", F.col("_rows")).otherwise(F.coalesce("_n", F.lit(0)))
        reason = F.coalesce(
            "_why",
            F.when((F.col("_rows") > 0) & F.col("path").isNull(), NOTHING_WRITTEN),
            F.when(counted != F.col("_rows"), F.concat_ws(" ", counted, F.lit("of"), "_rows", F.lit("rows came out"))),
        )
        exports = found.select(
            *LAKE, "table", "slug", "format", "path", F.when(reason.isNull(), "SUCCESS").otherwise("PARTIAL").alias("status"),
            F.when(reason.isNull(), F.col("_rows")).alias("row_count"), reason.alias("reason"), F.when(reason.isNull(), F.col("sha256")).alias("sha256"),
        )
        self._write((exports, "data-ledger", "json"))
        self.exports = self._read("data-ledger", exports.schema)

    def _placed(self, frame: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows with the source and the file name of their table, in columns behind all others."""
        taken, places = {name.lower() for name in frame.columns}, []
        for place in PLACES:
            while place in taken:
                place += "_"
            places.append(place)
        path = lakes.inside(lakes.scanned_path(frame.metadataColumn("_metadata")["file_path"]), self.root)
        entry = F.substring_index(F.substring_index(path, "/", 2), "/", -1)
        return frame.select("*", F.substring_index(path, "/", 1).alias(places[0]), entry.alias(places[1])), places

    def _written(self, kinds: Iterable[str]) -> tuple[DataFrame, DataFrame]:
        """Hash trees and row counts of what was exported, by source, file name and format."""
        spark, place = self.spark, [*LAKE, "_entry", "format"]
        if not kinds:
            none = local_rows(spark, [], "source_id string, _entry string, format string, path string, sha256 string, _n bigint")
            return none.drop("_n"), none.select(*place, "_n")
        data = self._path("data")
        parts = sinks.artifact_checksums(spark, data)
        self._write_parts(parts)
        parts = spark.read.schema(sinks.PARTS).json(self._path("data-checksums"))
        steps = F.split("artifact", "/")
        sums = self._owners(sinks.hash_tree(parts), "artifact").select(
            *place, F.array_join(F.slice(steps, -5, 5), "/").alias("path"), "sha256"
        )
        counts = [
            lakes.row_counts(spark, f"{data}/{kind.lower()}", (kind.lower(),)) for kind in sorted(kinds) if kind != "CSV"
        ]
        if not counts:
            return sums, local_rows(spark, [], "source_id string, _entry string, format string, _n bigint")
        # Written, as what is asked of a folder below would be asked of every row of every export if it came before the counting.
        rows = written_once(ledger.union_all(counts), "lake-export-counts")
        folder = F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
        rows = rows.groupBy(folder.alias("artifact")).agg(F.sum("n").alias("_n"))
        return sums, self._owners(rows, "artifact").select(*place, "_n")

    def _write_parts(self, parts: DataFrame) -> None:
        parts.write.mode("overwrite").json(self._path("data-checksums"))

    @staticmethod
    def _owners(artifacts: DataFrame, path: str) -> DataFrame:
        """Source, file name and format of an exported folder, of this run's labels, by the steps of its path."""
        steps = F.split(path, "/")

        def value(step: int) -> Column:
            escaped = F.expr(f"substr(element_at(split({path}, '/'), {step}), instr(element_at(split({path}, '/'), {step}), '=') + 1)")
            return F.when(escaped.contains("%"), F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))).otherwise(escaped)

        return artifacts.withColumns(
            {"source_id": value(-2), "_entry": value(-1), "format": F.upper(F.element_at(steps, -4))}
        )

    # What the sources declare

    def relationships(self) -> None:
        options, declared = self.options, self.declared
        if not options.extract_schema:
            return
        if declared.keys is not None:
            self._write((audit.declared_keys(declared.keys, options.selected_tables, LAKE), "schema/indexes", "json"))
        if declared.relationships is None:
            return
        rels = audit.declared_relationships(declared.relationships, options.selected_tables, LAKE)
        if self._guarded("RELATIONSHIP_EXTRACTION_PARTIAL", "relationship", (rels, "schema/relationships", "json"), (rels, "schema/constraints", "json")):
            rels = self._read("schema/relationships", rels.schema)
            self.counted["relationships"] = rels
            self.coverage.append(ledger.relationship_coverage(rels, LAKE))

    def links(self) -> None:
        """Where the linked files are now; a link that leads to a sibling, or nowhere, is a diagnostic of its source."""
        if self.declared.links is None or self.declared.dump_files is None:
            return
        resolved = resolve_links(self.declared.links, self.declared.dump_files)
        if self._guarded("LINK_RESOLUTION_FAILED", "linked-table", (resolved, "links", "json")):
            self.diagnostics.append(link_diagnostics(self._read("links", resolved.schema), keys=LAKE))

    def queries(self) -> None:
        options = self.options
        if not options.extract_queries or self.declared.queries is None:
            return
        chosen = select_objects(self.declared.queries.select(*LAKE, "name", "sql"), options.selected_queries)
        models = corpus.query_models(chosen, LAKE)
        raw = encode_text(models.select(*LAKE, "name", "slug", "sql"), "sql", options.text_encoding, "content").drop("sql")
        artifacts = [
            (raw, "queries/raw", "parquet"), (models, "queries/model", "json"), (corpus.dependency_edges(chosen, LAKE), "queries/dependency-graph", "json"),
        ]
        if options.translate_sql != "NONE":
            translated = corpus.translate_queries(chosen, options.translate_sql)
            text = translated.where(F.col("translated").isNotNull()).select(*LAKE, "name", "translated")
            text = encode_text(text, "translated", options.text_encoding, "content").drop("translated")
            artifacts.append((text, f"queries/translated/{options.translate_sql.lower()}", "parquet"))
        if not self._guarded("QUERY_EXTRACTION_FAILED", "query", *artifacts):
            return
        if options.translate_sql != "NONE":
            self.diagnostics.append(corpus.translation_ledger(translated, options.translate_sql, LAKE)[0])
        self.counted["queries"] = chosen
        self.coverage.append(ledger.query_coverage(chosen, options.translate_sql, keys=LAKE))

    def _guarded(self, code: str, kind: str, *artifacts: tuple) -> bool:
        """Write artifacts of all sources; if that fails, it is an error of every source."""
        try:
            self._write(*artifacts)
            return True
        except Exception as error:
            rows = self.sources.withColumn("_object", F.lit("*"))
            message = F.lit(str(error) or type(error).__name__)
            self.diagnostics.append(ledger.diagnostics_of(rows, F.lit(code), "error", message, kind, "_object", LAKE))
            return False

    # Ledgers

    def close(self) -> LakeResult:
        spark, options = self.spark, self.options
        self.coverage.append(ledger.unrecovered_in_each(self.sources, LAKE, options.full_fidelity))
        entries = [part.select(*LAKE, *ledger.COVERAGE_COLUMNS) for part in self.coverage]
        self._write((ledger.union_all(entries), "coverage", "json"))
        coverage = self._read("coverage", "source_id string, " + ledger.COVERAGE)
        if options.full_fidelity == "ON":
            asked = self.sources.withColumn("_object", F.lit("windows-helper"))
            code = F.lit("FULL_FIDELITY_UNAVAILABLE")
            self.diagnostics.append(
                ledger.diagnostics_of(asked, code, "warning", F.lit(ledger.FIDELITY_MISSING), "environment", "_object", LAKE)
            )
        if options.validate and options.extract_schema:
            # A table's schema is a row of its source's folder.
            written = self._read("schema/tables", "source_id string, name string").withColumn("category", F.lit("table"))
            referenced = ledger.referenced_artifacts(coverage, LAKE)
            missing = referenced.join(written.select(*LAKE, "category", "name").distinct(), [*LAKE, "category", "name"], "left_anti")
            self.diagnostics.append(ledger.validation_diagnostics(missing, LAKE))
        diagnostics = ledger.diagnostics_ledger(*self.diagnostics, stamped=True, keys=LAKE)
        counts = ledger.counts_in_each(self.sources, self.counted, LAKE)
        self._write((diagnostics, "diagnostics", "json"), (counts, "inventory", "json"))
        counts = self._read("inventory", "source_id string, kind string, n bigint")
        made = ledger.manifest(options, counts, LAKE)
        artifacts = [(made, "manifest", "json")]
        if options.write_docs:
            lines = ledger.object_inventory(coverage, LAKE)
            artifacts += [(lines, "docs/object-inventory", "json"), (ledger.coverage_summary(coverage, LAKE), "docs/coverage-summary", "json")]
        self._write(*artifacts)
        return LakeResult(
            options.output,
            coverage,
            self._read("diagnostics", "source_id string, " + ledger.DIAGNOSTICS + ", timestamp timestamp"),
            counts,
            self._read("manifest", made.schema),
            self.exports,
            self.audits.get("keys"),
            self.audits.get("relationships"),
        )
