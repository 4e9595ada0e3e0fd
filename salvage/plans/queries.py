"""The registered queries: each operator over the given tables, whole.

A query takes the session and the folder of the given tables. Arrays and maps are rendered as text in the
last step, so that results compare as plain rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvage.functions import text, values
from salvage.functions.names import safe_columns, slugged
from salvage.operators import audit, corpus, ledger, scope, sinks
from salvage.options import EVERYTHING, SCHEMA_ONLY
from salvage.plans.shapes import DECLARED_KEYS, DECLARED_LINKS, UNKNOWN_KEYS, given, given_tables, properties, shape
from salvage.plans.lake_run import LakeDeclarations, unpack_lake
from salvage.plans.unpack import Declarations, unpack
from salvage.session import local_rows, scratch_dir, union_all
from salvage.sources import dumps, tables
from salvage.sources import lake as lakes
from salvage.sources.files import hash_files_again
from salvage.streaming.corpus_stream import stream_queries, write_query_models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIALECT = "POSTGRES"

KEYS = [
    audit.Key("region", "pk_region", ("r_regionkey",), True),
    audit.Key("nation", "pk_nation", ("n_nationkey",), True),
    audit.Key("customer", "pk_customer", ("c_custkey",), True),
    audit.Key("supplier", "pk_supplier", ("s_suppkey",), True),
    audit.Key("part", "pk_part", ("p_partkey",), True),
    audit.Key("orders", "pk_orders", ("o_orderkey",), True),
    audit.Key("lineitem", "pk_lineitem", ("l_orderkey", "l_linenumber"), True),
    audit.Key("lineitem", "ix_lineitem_part", ("l_partkey",), False, False),
    audit.Key("events", "pk_events", ("event_id",), True),
    audit.Key("documents", "pk_documents", ("doc_id",), True),
    audit.Key("documents", "uq_documents_text", ("text",), False, True),
    audit.Key("pages", "pk_pages", ("page_id",), True),
    audit.Key("benchmark", "pk_benchmark", ("item_id",), True),
    audit.Key("labels", "pk_labels", ("doc_id",), True),
    audit.Key("embeddings", "pk_embeddings", ("vec_id",), True),
    audit.Key("conversations", "pk_conversations", ("conv_id", "turn"), True),
]
RELATIONSHIPS = [
    audit.Relationship("nation_region", "nation", "region", ("n_regionkey",), ("r_regionkey",)),
    audit.Relationship("customer_nation", "customer", "nation", ("c_nationkey",), ("n_nationkey",)),
    audit.Relationship("supplier_nation", "supplier", "nation", ("s_nationkey",), ("n_nationkey",)),
    audit.Relationship("orders_customer", "orders", "customer", ("o_custkey",), ("c_custkey",)),
    audit.Relationship("lineitem_orders", "lineitem", "orders", ("l_orderkey",), ("o_orderkey",), True),
    audit.Relationship("lineitem_part", "lineitem", "part", ("l_partkey",), ("p_partkey",)),
    audit.Relationship("lineitem_supplier", "lineitem", "supplier", ("l_suppkey",), ("s_suppkey",)),
    audit.Relationship("labels_documents", "labels", "documents", ("doc_id",), ("doc_id",)),
    # Not true of the data: documents without a label.
    audit.Relationship("documents_labels", "documents", "labels", ("doc_id",), ("doc_id",)),
]
AWKWARD = {
    "orders": ["order key", "order-key", "1st status", "total", "Total", "order key_2"],
    "customer": ["c custkey", "c-custkey", "顧客", "", "c_custkey"],
}


def query(function: Query) -> Query:
    QUERIES[function.__name__.removeprefix("run_of_")] = function
    return function


def _joined(col: str) -> Column:
    return F.array_join(col, ",")


# Sources and catalog


@query
def dump_catalog(spark, sf):
    return dumps.dump_catalog(spark, sf).select("file_name", "extension", "size_bytes", "sha256")


@query
def dump_hashes(spark, sf):
    """Every file's hash from the catalog beside one that a second reader took; a table's files are one row."""
    found = dumps.dump_catalog(spark, sf).withColumn("hash_form", F.col("sha256").rlike("^[0-9a-f]{64}$"))
    again = hash_files_again(spark, sf).select(F.regexp_replace("path", "^file:/+", "/").alias("place"), "again", "length")
    found = found.withColumn("place", F.regexp_replace("path", "^file:/+", "/")).join(again, "place", "full")
    table = F.regexp_extract(F.coalesce("place", F.lit("")), r"([^/]+)\.parquet", 1)
    return found.groupBy(table.alias("table_name")).agg(
        F.bool_and(F.coalesce("hash_form", F.lit(False))).alias("hash_form"),
        F.bool_and(F.coalesce(F.col("sha256") == F.col("again"), F.lit(False))).alias("agrees"),
        F.bool_and(F.coalesce(F.col("size_bytes") == F.col("length"), F.lit(False))).alias("same_size"),
    )


def _written_lake(spark, sf) -> str:
    """The given tables as a lake of two sources, with a table in each format."""
    lake = scratch_dir(spark, "lake")
    for name in ("nation", "customer", "orders", "events"):
        given(spark, sf, name).write.parquet(f"{lake}/one/{name}.parquet")
    given(spark, sf, "customer").where("c_custkey % 2 = 0").write.parquet(f"{lake}/two/customer.parquet")
    given(spark, sf, "conversations").write.options(header=True, escape='"').csv(f"{lake}/two/conversations.csv")
    given(spark, sf, "part").write.json(f"{lake}/two/part.json")
    return lake


@query
def lake_tables_inventory(spark, sf):
    found = lakes.lake_table_inventory(spark, _written_lake(spark, sf))
    return found.select("source_id", "name", "slug", "format", "row_count", (F.col("size_bytes") > 0).alias("has_bytes"), "reason")


@query
def lake_columns(spark, sf):
    return lakes.lake_columns(spark, _written_lake(spark, sf)).select("source_id", "table", "position", "name", "slug")


@query
def dump_classes(spark, sf):
    return dumps.classify_dumps(shape(spark, sf, "dump_files"))


@query
def dump_siblings(spark, sf):
    return dumps.sibling_alternatives(shape(spark, sf, "dump_files")).select(
        "source_id", "dir", "file_name", "suggested_alternative", "recommendation"
    )


@query
def link_resolution(spark, sf):
    return dumps.resolve_links(shape(spark, sf, "links"), shape(spark, sf, "dump_files"))


@query
def stale_links(spark, sf):
    return dumps.stale_link_hints(shape(spark, sf, "failures"))


@query
def table_inventory(spark, sf):
    return tables.table_inventory(tables.load_tables(spark, sf))


@query
def column_inventory(spark, sf):
    return tables.column_inventory(given_tables(spark, sf), measured=True).select(
        "table", "position", "name", "length", "auto_number"
    )


@query
def query_inventory(spark, sf):
    return corpus.query_inventory(shape(spark, sf, "saved_queries"), ("query_id",))


@query
def preflight(spark, sf):
    queries = shape(spark, sf, "saved_queries").select(
        F.concat(F.lit("db"), F.pmod("query_id", F.lit(60)).cast("string")).alias("source_id")
    )
    return dumps.preflight(
        shape(spark, sf, "dump_files"), shape(spark, sf, "lake_tables"), queries, shape(spark, sf, "failures")
    )


# Projections, filters, normalisation


@query
def normalize_events(spark, sf):
    return values.normalize_values(given(spark, sf, "events"))


@query
def normalize_embeddings(spark, sf):
    normalized = values.normalize_values(given(spark, sf, "embeddings"))
    return normalized.select(
        "vec_id", "label", F.posexplode("embedding").alias("position", "value")
    ).withColumn("value", F.col("value").cast("double"))


@query
def normalize_nested(spark, sf):
    nested = given(spark, sf, "events").select(
        "event_id",
        F.array(F.encode("event_type", "UTF-8"), F.encode("props", "UTF-8")).alias("blobs"),
        F.create_map("user_id", "ts").alias("seen"),
        F.struct("ts", F.col("value").cast("int").alias("whole")).alias("pair"),
    )
    return values.stringify(nested)


@query
def stringify_orders(spark, sf):
    return values.stringify(given(spark, sf, "orders"))


@query
def run_of_safe_columns(spark, sf):
    orders = given(spark, sf, "orders")
    return safe_columns(orders.toDF(*AWKWARD["orders"]))


@query
def slug_parts(spark, sf):
    names = given(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" / ", "p_type", "p_name", "p_brand").alias("name")
    )
    texts = given(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("name"))
    return slugged(names.unionByName(texts), "name").select("id", "slug")


@query
def selected_tables(spark, sf):
    return scope.select_objects(shape(spark, sf, "lake_tables"), shape(spark, sf, "table_selection"))


@query
def visible_tables(spark, sf):
    return scope.drop_system(shape(spark, sf, "lake_tables"))


@query
def relationships_in_scope(spark, sf):
    return scope.relationships_in_scope(
        shape(spark, sf, "lake_relationships"), shape(spark, sf, "end_selection")
    ).select("name", "from_table", "to_table")


@query
def redact_documents(spark, sf):
    secret = given(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("PassWord="), F.col("source"), F.lit(";User ID="), F.col("lang"), F.lit(";"), F.col("text"),
            F.lit(";pwd=x"), F.col("text"),
        ).alias("text"),
    )
    return text.redact_secrets(secret, ["text"])


# Sinks


@query
def csv_roundtrip(spark, sf):
    documents = given(spark, sf, "documents")
    path = scratch_dir(spark, "csv")
    sinks.export_csv(documents, path)
    return sinks.read_csv(spark, path, documents.columns)


@query
def csv_bom_roundtrip(spark, sf):
    turns = given(spark, sf, "conversations")
    path = scratch_dir(spark, "csv-bom")
    sinks.export_csv(turns, path, "UTF8_BOM")
    return sinks.read_csv(spark, path, turns.columns, "UTF8_BOM")


@query
def csv_charset_roundtrip(spark, sf):
    documents = given(spark, sf, "documents")
    path = scratch_dir(spark, "csv-charset")
    sinks.export_csv(documents, path, "WINDOWS_31J")
    return sinks.read_csv(spark, path, documents.columns, "WINDOWS_31J")


@query
def json_roundtrip(spark, sf):
    events = given(spark, sf, "events")
    path = scratch_dir(spark, "json")
    sinks.export_json(events, path)
    return spark.read.schema(
        "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
    ).json(path)


@query
def parquet_roundtrip(spark, sf):
    path = scratch_dir(spark, "parquet")
    sinks.export_parquet(given(spark, sf, "customer").toDF(*AWKWARD["customer"]), path)
    return spark.read.parquet(path)


@query
def export_ledger(spark, sf):
    return sinks.export_tables(spark, given_tables(spark, sf), scratch_dir(spark, "export"))


@query
def encode_texts(spark, sf):
    frames = []
    documents = given(spark, sf, "documents").select("doc_id", "text")
    for encoding in text.CHARSETS:
        encoded = text.encode_text(documents, "text", encoding)
        frames.append(
            text.decode_text(encoded, "bytes", encoding, "decoded").select(
                F.lit(encoding).alias("encoding"),
                "doc_id",
                F.octet_length("bytes").cast("bigint").alias("n_bytes"),
                "decoded",
            )
        )
    return union_all(frames)


@query
def artifact_checksums(spark, sf):
    out = scratch_dir(spark, "checksums")
    sinks.export_tables(spark, given_tables(spark, sf), out, ("JSON",))
    return sinks.artifact_checksums(spark, f"{out}/data")


@query
def export_checksums(spark, sf):
    """The hash tree of every export, beside one over hashes that another reader took of the same files."""
    out = scratch_dir(spark, "hash-tree")
    exports = sinks.export_tables(spark, given_tables(spark, sf), out)
    parts = sinks.artifact_checksums(spark, f"{out}/data")
    found = sinks.with_checksums(exports, parts).select("table", "format", "path", "sha256")
    steps = F.split("path", "/")
    again = hash_files_again(spark, f"{out}/data").select(
        F.concat_ws("/", F.element_at(steps, -3), F.element_at(steps, -2)).alias("path"), F.element_at(steps, -1).alias("part"),
        F.col("length").alias("size_bytes"), F.col("again").alias("sha256"),
    )
    twice = sinks.hash_tree(again, "path").select("path", F.col("sha256").alias("again"), "n_bytes")
    return found.join(twice, "path", "left").select(
        "table", "format", F.coalesce(F.col("sha256") == F.col("again"), F.lit(False)).alias("agrees"), (F.col("n_bytes") > 0).alias("has_bytes")
    )


@query
def fingerprint_saved_queries(spark, sf):
    return sinks.content_fingerprint(shape(spark, sf, "saved_queries"))


@query
def fingerprint_roundtrip(spark, sf):
    """The fingerprint of exported rows read back, which must equal that of the source."""
    path = scratch_dir(spark, "fingerprint")
    events = given(spark, sf, "events")
    sinks.export_parquet(events, path)
    return sinks.content_fingerprint(spark.read.parquet(path))


# Saved-query corpus


@query
def query_types(spark, sf):
    return corpus.classify_queries(shape(spark, sf, "saved_queries")).select("query_id", "type")


@query
def query_warnings(spark, sf):
    found = corpus.dialect_warnings(shape(spark, sf, "saved_queries"))
    return found.select("query_id", F.explode_outer("warnings").alias("warning")).where("warning IS NOT NULL")


@query
def query_dependencies(spark, sf):
    found = corpus.query_dependencies(shape(spark, sf, "saved_queries"))
    return found.select("query_id", F.array_join("dependencies", "|").alias("dependencies"))


@query
def query_dependencies_strict(spark, sf):
    found = corpus.query_dependencies(shape(spark, sf, "hidden_names"), "strict")
    return found.select("query_id", F.posexplode_outer("dependencies").alias("place", "name"))


@query
def dependency_edges(spark, sf):
    return corpus.dependency_edges(shape(spark, sf, "saved_queries"), ("query_id",))


@query
def query_translations(spark, sf):
    translated = corpus.translate_queries(shape(spark, sf, "saved_queries"), DIALECT)
    return translated.select(
        "query_id", "translated", "confidence", F.array_join("translation_warnings", "|").alias("warnings")
    )


@query
def translation_ledger(spark, sf):
    translated = corpus.translate_queries(shape(spark, sf, "saved_queries"), DIALECT)
    diagnostics, coverage = corpus.translation_ledger(translated, DIALECT, ("query_id",))
    return diagnostics.select(
        "query_id", "code", F.col("severity").alias("status"), F.col("message").alias("text"),
        F.lit(None).cast("double").alias("confidence"),
    ).unionByName(
        coverage.select(
            "query_id", F.col("category").alias("code"), "status", F.col("details")["dialect"].alias("text"),
            "confidence",
        )
    )


@query
def query_models(spark, sf):
    return _flat_models(corpus.query_models(shape(spark, sf, "saved_queries"), ("query_id",)))


def _flat_models(models: DataFrame) -> DataFrame:
    return models.select(
        "query_id", "name", "slug", "type", "sql",
        F.size("parameters").alias("n_parameters"),
        F.array_join("dependencies", "|").alias("dependencies"),
        F.array_join("warnings", "|").alias("warnings"),
    )


@query
def sql_workbench(spark, sf):
    bench = corpus.sql_workbench(shape(spark, sf, "saved_queries"), DIALECT, ("query_id",))
    return bench.withColumn("warnings", F.array_join("warnings", "|"))


@query
def streamed_query_models(spark, sf):
    """The corpus written out by Spark, then read as a stream and mined on arrival."""
    base = scratch_dir(spark, "stream")
    shape(spark, sf, "saved_queries").write.parquet(f"{base}/in")
    arriving = stream_queries(spark, f"{base}/in", "query_id bigint, name string, sql string")
    write_query_models(arriving, f"{base}/out", f"{base}/progress", ("query_id",)).awaitTermination()
    return _flat_models(spark.read.parquet(f"{base}/out"))


# Declared structure and audits


@query
def declared_keys(spark, sf):
    listing = audit.declared_keys(shape(spark, sf, "lake_keys"), shape(spark, sf, "end_selection"))
    return listing.withColumn("columns", _joined("columns"))


@query
def key_audit(spark, sf):
    return audit.audit_keys(given_tables(spark, sf), KEYS)


@query
def declared_relationships(spark, sf):
    listing = audit.declared_relationships(shape(spark, sf, "lake_relationships"), shape(spark, sf, "end_selection"))
    return listing.withColumns({"from_columns": _joined("from_columns"), "to_columns": _joined("to_columns")})


@query
def constraints(spark, sf):
    listing = audit.constraints(shape(spark, sf, "lake_relationships"))
    return listing.withColumns({"from_columns": _joined("from_columns"), "to_columns": _joined("to_columns")})


@query
def relationship_audit(spark, sf):
    return audit.audit_relationships(given_tables(spark, sf), RELATIONSHIPS)


@query
def linked_tables(spark, sf):
    return audit.linked_tables(shape(spark, sf, "lake_tables")).select("name", "type")


@query
def system_objects(spark, sf):
    return audit.system_objects(shape(spark, sf, "lake_tables"))


@query
def property_rows(spark, sf):
    return audit.property_rows(properties(spark, sf), ordered=True)


# Ledgers


def _coverage(spark, sf) -> DataFrame:
    return ledger.coverage_ledger(
        spark,
        shape(spark, sf, "lake_tables"),
        shape(spark, sf, "lake_relationships"),
        shape(spark, sf, "saved_queries"),
        DIALECT,
    )


def _flat_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.select(
        "category", "name", "status", "confidence", "reason",
        *[F.col("details")[key].alias(key) for key in ("schemaPath", "rowCount", "type", "dialect", "fromTable")],
    )


def _diagnostics(spark, sf) -> DataFrame:
    links = dumps.resolve_links(shape(spark, sf, "links"), shape(spark, sf, "dump_files"))
    translated = corpus.translate_queries(shape(spark, sf, "saved_queries"), DIALECT)
    return ledger.diagnostics_ledger(
        dumps.link_diagnostics(links),
        corpus.translation_ledger(translated, DIALECT)[0],
        ledger.validation_diagnostics(missing_artifacts(spark, sf)),
        ledger.fidelity_diagnostics(spark, "ON"),
    )


@query
def coverage_ledger(spark, sf):
    return _flat_coverage(_coverage(spark, sf))


@query
def coverage_summary(spark, sf):
    return ledger.coverage_summary(_coverage(spark, sf))


LAKE = ("source_id",)


def _lake_queries(spark, sf) -> DataFrame:
    of_source = F.concat(F.lit("db"), F.pmod("query_id", F.lit(100)).cast("string")).alias("source_id")
    return shape(spark, sf, "saved_queries").select(of_source, "name", "sql")


def _lake_relationships(spark, sf) -> DataFrame:
    number = F.substring_index("name", "rel", -1).cast("bigint")
    of_source = F.concat(F.lit("db"), F.pmod(number, F.lit(100)).cast("string")).alias("source_id")
    return shape(spark, sf, "lake_relationships").select(of_source, "*")


def _lake_coverage(spark, sf) -> DataFrame:
    inventory, rels = shape(spark, sf, "lake_tables"), _lake_relationships(spark, sf)
    return ledger.coverage_ledger(spark, inventory, rels, _lake_queries(spark, sf), DIALECT, keys=LAKE, sources=inventory)


@query
def lake_coverage(spark, sf):
    """Coverage of every source of a lake at once, summed up per source."""
    return ledger.coverage_summary(_lake_coverage(spark, sf), LAKE)


@query
def lake_counts(spark, sf):
    inventory = shape(spark, sf, "lake_tables")
    counted = {
        "tables": scope.drop_system(inventory), "queries": _lake_queries(spark, sf), "relationships": _lake_relationships(spark, sf)
    }
    return ledger.counts_in_each(inventory, counted, LAKE)


@query
def lake_objects(spark, sf):
    inventory = shape(spark, sf, "lake_tables")
    return ledger.object_inventory(ledger.table_coverage(inventory, keys=LAKE), LAKE)


@query
def lake_summary(spark, sf):
    """Closing status of every source of a lake at once."""
    listed = shape(spark, sf, "lake_tables")
    written = listed.where("column_count % 9 <> 0").select(
        *LAKE, F.concat(F.lit("schema/tables/slug="), F.col("slug")).alias("path")
    )
    referenced = ledger.referenced_artifacts(ledger.table_coverage(listed, keys=LAKE), LAKE)
    missing = ledger.missing_artifacts(referenced, written, LAKE)
    diagnostics = ledger.diagnostics_ledger(ledger.validation_diagnostics(missing, LAKE), keys=LAKE)
    return ledger.run_summary(_lake_coverage(spark, sf), diagnostics, LAKE)


@query
def diagnostics_ledger(spark, sf):
    details = F.col("details")
    return _diagnostics(spark, sf).withColumns(
        {"details": details["resolvedPath"], "count": details["count"]}
    )


@query
def inventory_counts(spark, sf):
    return ledger.inventory_counts(
        spark,
        {
            "tables": scope.drop_system(shape(spark, sf, "lake_tables")),
            "queries": shape(spark, sf, "saved_queries"),
            "relationships": shape(spark, sf, "lake_relationships"),
        },
    )


@query
def missing_artifacts(spark, sf):
    listed = shape(spark, sf, "lake_tables")
    written = listed.where("column_count % 9 <> 0").select(
        F.concat(F.lit("schema/tables/slug="), F.col("slug")).alias("path")
    )
    return ledger.missing_artifacts(ledger.referenced_artifacts(ledger.table_coverage(listed)), written)


@query
def object_inventory(spark, sf):
    return ledger.object_inventory(_coverage(spark, sf))


@query
def run_summary(spark, sf):
    return ledger.run_summary(_coverage(spark, sf), _diagnostics(spark, sf))


@query
def manifest(spark, sf):
    made = ledger.manifest(EVERYTHING.at("lake", "out"), inventory_counts(spark, sf))
    return made.select(
        "input", "output", "text_encoding", "selected_scopes.*",
        F.size("selected_tables").alias("n_selected_tables"),
        F.size("selected_queries").alias("n_selected_queries"),
        F.col("inventory.tables"), F.col("inventory.relationships"), F.col("inventory.forms"),
        F.col("inventory.queries").alias("n_queries"),
    )


@query
def db_info(spark, sf):
    files = shape(spark, sf, "dump_files").select(
        F.col("source_id").alias("source"), "file_name", dumps.extension(F.col("file_name")).alias("extension")
    )
    return ledger.db_info(files, audit.property_rows(properties(spark, sf)))


@query
def table_schemas(spark, sf):
    found = given_tables(spark, sf)
    keys = spark.createDataFrame(
        [(k.table, k.name, k.primary_key, k.unique, list(k.columns)) for k in KEYS], audit.KEYS
    )
    nested = ledger.table_schemas(tables.table_inventory(found), tables.column_inventory(found), keys)
    return nested.select(
        "name", "slug", "system_object", "row_count",
        F.array_join("columns.name", ",").alias("columns"),
        F.array_join("indexes.name", ",").alias("indexes"),
    )


# Whole runs


def _unpacked(spark, sf, options) -> DataFrame:
    declared = Declarations(
        queries=shape(spark, sf, "saved_queries"), keys=KEYS, relationships=RELATIONSHIPS, linked=("labels",)
    )
    result = unpack(spark, options.at(sf, scratch_dir(spark, "unpack")), declared)
    return _flat_coverage(result.coverage)


@query
def run_of_unpack(spark, sf):
    return _unpacked(spark, sf, EVERYTHING)


def _lake_run(spark, sf):
    """A run over the written lake, which has a table without a footer, with corpora and relationships of both sources."""
    lake = _written_lake(spark, sf)
    given(spark, sf, "part").select("p_name").write.text(f"{lake}/two/broken.parquet")

    def source(number):
        return F.when(number % 2 == 0, "one").otherwise("two").alias("source_id")

    number = F.substring_index("name", "rel", -1).cast("bigint")
    declared = LakeDeclarations(
        queries=shape(spark, sf, "saved_queries").select(source(F.abs("query_id")), "name", "sql"),
        relationships=shape(spark, sf, "lake_relationships").select(source(number), "*"),
    )
    return unpack_lake(spark, EVERYTHING.at(lake, scratch_dir(spark, "lake-run")), declared)


@query
def unpack_of_lake(spark, sf):
    """Coverage of every object of a whole lake by one run."""
    return _lake_run(spark, sf).coverage.select(
        "source_id", "category", "name", "status", "confidence", F.col("details")["rowCount"].alias("rowCount"),
        (F.col("details")["csvSha256"].isNotNull() & F.col("details")["jsonSha256"].isNotNull()).alias("hashed"),
    )


@query
def unpack_schema_only(spark, sf):
    return _unpacked(spark, sf, SCHEMA_ONLY)


@query
def unpack_translated(spark, sf):
    """Coverage of a whole run that also translates, with all its details; lists are joined, hashes only told to be there."""
    declared = Declarations(queries=shape(spark, sf, "saved_queries"), keys=KEYS, relationships=RELATIONSHIPS)
    options = replace(EVERYTHING, translate_sql=DIALECT, export_data="PARQUET")
    details, names = F.col("details"), "array<string>"
    return unpack(spark, options.at(sf, scratch_dir(spark, "unpack")), declared).coverage.select(
        "category", "name", "status", "confidence", "reason",
        *[details[key].alias(key) for key in ("slug", "schemaPath", "rowCount", "type", "dialect", "fromTable", "toTable")],
        *[F.array_join(F.from_json(details[key], names), "|").alias(key) for key in ("dependencies", "fromColumns", "toColumns")],
        details["parquetSha256"].rlike("^[0-9a-f]{64}$").alias("hashed"),
    )


@query
def unpack_with_failures(spark, sf):
    """Both ledgers of a run in which a table has no footer, links lead elsewhere or nowhere, and declarations do not hold."""
    source = scratch_dir(spark, "failing")
    for name in ("nation", "orders"):
        given(spark, sf, name).write.parquet(f"{source}/{name}.parquet")
    given(spark, sf, "part").select("p_name").write.text(f"{source}/broken.parquet")
    declared = Declarations(
        queries=shape(spark, sf, "saved_queries"), links=shape(spark, sf, "links"), dump_files=shape(spark, sf, "dump_files"),
        keys=[audit.Key("orders", "pk_orders", ("o_orderkey",), True), audit.Key("orders", "uq_orders_customer", ("o_custkey",))],
        relationships=[audit.Relationship("orders_customer", "orders", "customer", ("o_custkey",), ("c_custkey",))],
    )
    options = replace(EVERYTHING, translate_sql=DIALECT, full_fidelity="ON", audit=True, export_data="JSON")
    result = unpack(spark, options.at(source, scratch_dir(spark, "unpack")), declared)
    covered = result.coverage.select(F.lit("coverage").alias("ledger"), F.col("category").alias("kind"), "name", "status", "confidence", "reason")
    # What an engine says about a broken file is its own affair.
    message = F.when(F.col("code") != "PREFLIGHT_SCAN_FAILED", F.col("message"))
    told = result.diagnostics.select(
        F.lit("diagnostics").alias("ledger"), F.col("code").alias("kind"), F.col("object_name").alias("name"), F.col("severity").alias("status"),
        F.lit(None).cast("double").alias("confidence"), message.alias("reason"),
    )
    return covered.unionByName(told)


def _lake_audits(spark, sf):
    keys = [(s, table, name, primary, True, list(columns)) for s, table, name, columns, primary in (*DECLARED_KEYS, *UNKNOWN_KEYS)]
    rels = [(s, name, child, parent, list(a), list(b), False, False) for s, name, child, parent, a, b in DECLARED_LINKS]
    declared = LakeDeclarations(
        keys=local_rows(spark, keys, "source_id string, " + audit.KEYS),
        relationships=local_rows(spark, rels, "source_id string, " + audit.RELATIONSHIPS),
    )
    options = replace(SCHEMA_ONLY, audit=True).at(_written_lake(spark, sf), scratch_dir(spark, "lake-audit"))
    return unpack_lake(spark, options, declared)


@query
def lake_key_audit(spark, sf):
    """Declared keys of all sources of a written lake against its tables."""
    return _lake_audits(spark, sf).key_audits


@query
def lake_relationship_audit(spark, sf):
    return _lake_audits(spark, sf).relationship_audits
