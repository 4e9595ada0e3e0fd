import pytest

from salvage.operators import ledger
from salvage.options import SCHEMA_ONLY, UnpackOptions


def coverage(spark, *rows):
    return spark.createDataFrame([("table", n, s, c, "", {}) for n, s, c in rows], ledger.COVERAGE)


def diagnostics(spark, *severities):
    return spark.createDataFrame([("C", s, "m", "t", "n", {}) for s in severities], ledger.DIAGNOSTICS)


def test_table_coverage_is_honest(spark):
    inventory = spark.createDataFrame(
        [("a", "a", 3), ("b", "b", 2), ("c", "c", -1)], "name string, slug string, row_count bigint"
    )
    exports = spark.createDataFrame(
        [("a", "SUCCESS"), ("b", "SUCCESS"), ("b", "PARTIAL"), ("b", "PARTIAL")], "table string, status string"
    )
    rows = {r["name"]: r for r in ledger.table_coverage(inventory, exports).collect()}
    assert {n: (r["status"], r["confidence"]) for n, r in rows.items()} == {
        "a": ("SUCCESS", 0.95), "b": ("PARTIAL", 0.95), "c": ("FAILED", 0.0),
    }
    assert rows["a"]["details"] == {"name": "a", "slug": "a", "rowCount": "3", "schemaPath": "schema/tables/slug=a"}
    assert "schemaPath" not in ledger.table_coverage(inventory, with_schema=False).first()["details"]


@pytest.mark.parametrize("dialect,n", [("NONE", 1), ("mysql", 2)])
def test_query_coverage(spark, dialect, n):
    q = spark.createDataFrame([("q", "select nz(a) from [T]")], "name string, sql string")
    rows = sorted(ledger.query_coverage(q, dialect).collect())
    assert len(rows) == n
    assert tuple(rows[0])[:4] == ("query", "q", "SUCCESS", 0.85)
    assert rows[0]["details"] == {"dependencies": '["T"]', "type": "select"}
    if n == 2:
        assert tuple(rows[1])[:4] == ("query-translation", "q", "PARTIAL", 0.25)
        assert rows[1]["details"] == {"dialect": "MYSQL"}


def test_query_coverage_unescapes_names_in_strict_mode_only(spark):
    q = spark.createDataFrame([("q", "SELECT a FROM [A|B] JOIN c")], "name string, sql string")
    compat, strict = ledger.query_coverage(q), ledger.query_coverage(q, mode="strict")
    assert "lambda" not in compat._jdf.queryExecution().executedPlan().toString()
    assert compat.first()["details"]["dependencies"] == '["A","c"]'
    assert strict.first()["details"]["dependencies"] == '["A|B","c"]'


def test_counting_query_coverage_parses_no_sql(spark, tmp_path):
    spark.createDataFrame([("q", "select 1 from a")], "name string, sql string").write.parquet(str(tmp_path / "q"))
    counted = ledger.query_coverage(spark.read.parquet(str(tmp_path / "q")), "ANSI").groupBy().count()
    assert "ReadSchema: struct<>" in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.first()[0] == 2


def test_unrecovered_objects_say_why(spark):
    reasons = {m: ledger.unrecovered_coverage(spark, m).first()["reason"] for m in ("OFF", "AUTO", "ON")}
    assert reasons == {"OFF": ledger.HELPER_OFF, "AUTO": ledger.HELPER_MISSING, "ON": ledger.HELPER_MISSING}


def test_summary_counts_and_total(spark):
    rows = coverage(spark, ("a", "SUCCESS", 1.0), ("b", "FAILED", 0.0), ("c", "SUCCESS", 1.0))
    assert dict(map(tuple, ledger.coverage_summary(rows).collect())) == {"success": 2, "failed": 1, "total": 3}


@pytest.mark.parametrize(
    "severities,code,status",
    [
        ([], 0, "Completed cleanly"),
        (["warning"], 0, "Completed with warnings"),
        (["warning", "error", "error"], 2, "Completed with issues"),
    ],
)
def test_run_summary(spark, severities, code, status):
    row = ledger.run_summary(coverage(spark, ("a", "SUCCESS", 1.0)), diagnostics(spark, *severities)).first()
    assert (row["coverage_entries"], row["warnings"], row["errors"]) == (1, severities.count("warning"), severities.count("error"))
    assert (row["exit_code"], row["status"]) == (code, status)


def test_object_inventory_lines(spark):
    lines = [r["line"] for r in ledger.object_inventory(coverage(spark, ("b", "SUCCESS", 0.95), ("a", "FAILED", 0.0))).collect()]
    assert lines == ["- `table` `a` `FAILED` confidence=0.00", "- `table` `b` `SUCCESS` confidence=0.95"]


def test_missing_artifacts(spark):
    inventory = spark.createDataFrame([("a", "a", 3), ("b", "b", 2)], "name string, slug string, row_count bigint")
    referenced = ledger.referenced_artifacts(ledger.table_coverage(inventory))
    present = spark.createDataFrame([("schema/tables/slug=a",)] * 2, "path string")
    missing = ledger.missing_artifacts(referenced, present)
    assert [tuple(r) for r in missing.collect()] == [("table", "b", "schema/tables/slug=b")]
    warning = ledger.validation_diagnostics(missing).first()
    assert (warning["message"], warning["details"]) == (ledger.MISSING_ARTIFACTS + "1", {"count": "1"})
    assert ledger.validation_diagnostics(missing.where("name = 'z'")).isEmpty()


def test_sources_keep_apart(spark):
    inventory = spark.createDataFrame(
        [("s", "a", "a", 1), ("t", "a", "a", 1)], "source_id string, name string, slug string, row_count bigint"
    )
    exports = spark.createDataFrame([("t", "a", "PARTIAL")], "source_id string, table string, status string")
    coverage = ledger.coverage_ledger(spark, inventory, exports=exports, keys=("source_id",), sources=inventory)
    got = {(r["source_id"], r["status"]): r["n"] for r in ledger.coverage_summary(coverage, ("source_id",)).collect()}
    assert got == {
        ("s", "success"): 1, ("s", "unsupported"): 4, ("s", "total"): 5,
        ("t", "partial"): 1, ("t", "unsupported"): 4, ("t", "total"): 5,
    }
    present = spark.createDataFrame([("s", "schema/tables/slug=a")], "source_id string, path string")
    missing = ledger.missing_artifacts(ledger.referenced_artifacts(coverage, ("source_id",)), present, ("source_id",))
    assert [r["source_id"] for r in missing.collect()] == ["t"]


def test_full_fidelity_cannot_be_served(spark):
    assert ledger.fidelity_diagnostics(spark, "ON").first()["code"] == "FULL_FIDELITY_UNAVAILABLE"
    assert ledger.fidelity_diagnostics(spark, "AUTO").isEmpty()


def test_diagnostics_carry_a_time_only_when_asked(spark):
    rows = diagnostics(spark, "error")
    assert "timestamp" not in ledger.diagnostics_ledger(rows).columns
    assert ledger.diagnostics_ledger(rows, rows, stamped=True).where("timestamp IS NOT NULL").count() == 2


def test_manifest(spark):
    counts = ledger.inventory_counts(spark, {"tables": spark.range(4)})
    row = ledger.manifest(UnpackOptions("in", "out", selected_tables=["b", "a"], text_encoding="utf8_bom"), counts).first()
    assert (row["input"], row["text_encoding"], row["selected_tables"], row["selected_queries"]) == ("in", "UTF8_BOM", ["a", "b"], [])
    assert row["inventory"].asDict() == {
        "tables": 4, "queries": 0, "relationships": 0, "forms": 0, "reports": 0, "macros": 0, "modules": 0,
    }
    scopes = ledger.manifest(SCHEMA_ONLY, counts).first()["selected_scopes"].asDict()
    assert scopes == {"schema": True, "data": False, "queries": False, "docs": True}


def test_db_info_keeps_files_without_properties(no_broadcast):
    files = no_broadcast.createDataFrame([("a", "a.mdb"), ("b", "b.mdb")], "source string, file_name string")
    props = no_broadcast.createDataFrame(
        [("a", "user", "k", "v"), ("a", "user", "l", None), ("ghost", "user", "k", "v")],
        "source string, scope string, key string, value string",
    )
    got = sorted(map(tuple, ledger.db_info(files, props).collect()), key=str)
    assert got == [
        ("a", "a.mdb", "user", "k", "v"), ("a", "a.mdb", "user", "l", None), ("b", "b.mdb", None, None, None),
    ]


def test_table_schemas_are_nested_in_column_order(spark):
    from salvage.operators.audit import KEYS
    from salvage.sources.tables import column_inventory, table_inventory

    found = {"t": spark.createDataFrame([(1, "x")], "z int, a string"), "u": spark.range(2)}
    keys = spark.createDataFrame([("t", "pk", True, True, ["z"])], KEYS)
    rows = {r["name"]: r for r in ledger.table_schemas(table_inventory(found), column_inventory(found), keys).collect()}
    assert [c["name"] for c in rows["t"]["columns"]] == ["z", "a"] and rows["t"]["row_count"] == 1
    assert rows["t"]["indexes"][0]["columns"] == ["z"] and rows["u"]["indexes"] is None
