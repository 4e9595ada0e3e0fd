import glob
import hashlib
import os

import pytest

from salvage.operators import audit, sinks
from salvage.options import EVERYTHING, SCHEMA_ONLY, UnpackOptions
from salvage.plans import unpack as plan
from salvage.plans.unpack import Declarations, labelled, unpack, unpack_many


@pytest.fixture
def source(spark, tmp_path):
    root = tmp_path / "src"
    spark.createDataFrame([(1, "水利"), (2, None)], "id int, `a name` string").write.parquet(str(root / "Main Table.parquet"))
    spark.createDataFrame([(1,), (5,)], "main_id int").write.parquet(str(root / "child.parquet"))
    spark.range(1).write.parquet(str(root / "MSysObjects.parquet"))
    return str(root)


@pytest.fixture
def declared(spark):
    queries = spark.createDataFrame(
        [("Q 1", "SELECT Nz([a]) FROM [Main Table]"), ("Q 2", None), ("q 3", "UPDATE child SET a=1")], "name string, sql string"
    )
    return Declarations(
        queries=queries,
        keys=[audit.Key("Main Table", "pk", ("id",), True)],
        relationships=[audit.Relationship("rel", "child", "Main Table", ("main_id",), ("id",))],
        system=("MSysObjects",),
        linked=("child",),
    )


def statuses(result):
    return {(r["category"], r["name"]): r["status"] for r in result.coverage.collect()}


UNSUPPORTED = {(k, "*"): "UNSUPPORTED" for k in ("forms", "reports", "macros", "vba")}


def test_everything(spark, source, declared, tmp_path):
    out = str(tmp_path / "out")
    result = unpack(spark, EVERYTHING.at(source, out), declared)
    assert statuses(result) == {
        ("table", "Main Table"): "SUCCESS", ("table", "child"): "SUCCESS", ("relationship", "rel"): "SUCCESS",
        ("query", "Q 1"): "SUCCESS", ("query", "Q 2"): "SUCCESS", ("query", "q 3"): "SUCCESS", **UNSUPPORTED,
    }
    assert result.diagnostics.isEmpty()
    assert tuple(result.summary.first()) == (10, 0, 0, 0, "Completed cleanly")
    assert result.manifest.first()["inventory"]["queries"] == 3
    assert dict(map(tuple, result.counts.collect()))["tables"] == 2
    assert sorted(os.listdir(f"{out}/data")) == sorted(
        f"{slug}.{kind}" for slug in ("main-table", "child") for kind in ("csv", "json", "parquet")
    )
    edges = {(r["from"], r["to"]) for r in spark.read.json(f"{out}/queries/dependency-graph").collect()}
    assert edges == {("Q 1", "Main Table"), ("q 3", "child SET a")}
    details = {r["name"]: r["details"] for r in result.coverage.where("category = 'table'").collect()}
    for name, slug in (("Main Table", "main-table"), ("child", "child")):
        trees = {r["artifact"].rsplit("/", 1)[-1]: r["sha256"] for r in sinks.hash_tree(sinks.artifact_checksums(spark, f"{out}/data")).collect()}
        assert {k: details[name][f"{k}Sha256"] for k in ("csv", "json", "parquet")} == {k: trees[f"{slug}.{k}"] for k in ("csv", "json", "parquet")}
    schemas = {r["name"]: r for r in spark.read.json(f"{out}/schema/tables").collect()}
    assert schemas["Main Table"]["slug"] == "main-table" and schemas["Main Table"]["row_count"] == 2
    assert spark.read.json(f"{out}/schema/linked-tables").first()["name"] == "child"
    assert spark.read.json(f"{out}/schema/constraints").first()["name"] == "rel"
    assert spark.read.text(f"{out}/docs/object-inventory").count() == 10
    assert bytes(spark.read.parquet(f"{out}/queries/raw").where("name = 'Q 2'").first()["content"]) == b""
    assert not glob.glob(f"{out}/queries/translated/*")


def test_schema_only(spark, source, declared, tmp_path):
    out = str(tmp_path / "out")
    result = unpack(spark, SCHEMA_ONLY.at(source, out), declared)
    assert {k[0] for k in statuses(result)} == {"table", "relationship", "forms", "reports", "macros", "vba"}
    assert not os.path.exists(f"{out}/data") and not os.path.exists(f"{out}/queries")


def test_translation_selection_and_system_objects(spark, source, declared, tmp_path):
    out = str(tmp_path / "out")
    options = UnpackOptions(
        source, out, full_fidelity="on", include_system_objects=True, export_data="csv", text_encoding="UTF8_BOM",
        translate_sql="postgres", selected_tables=["MSysObjects", "child"], selected_queries=["Q 1"],
    )
    result = unpack(spark, options, declared)
    assert statuses(result) == {
        ("table", "MSysObjects"): "SUCCESS", ("table", "child"): "SUCCESS", ("query", "Q 1"): "SUCCESS",
        ("query-translation", "Q 1"): "PARTIAL", **UNSUPPORTED,
    }
    codes = [(r["code"], r["severity"], r["object_name"]) for r in result.diagnostics.collect()]
    assert sorted(codes) == [
        ("FULL_FIDELITY_UNAVAILABLE", "warning", "windows-helper"), ("QUERY_TRANSLATION_WARNING", "warning", "Q 1"),
    ]
    text = bytes(spark.read.parquet(f"{out}/queries/translated/postgres").first()["content"])
    assert text == '\ufeffSELECT Nz("a") FROM "Main Table"'.encode()
    assert spark.read.json(f"{out}/schema/system-objects").first()["name"] == "MSysObjects"
    assert sorted(os.listdir(f"{out}/data")) == ["child.csv", "msysobjects.csv"]


def test_selection_from_a_frame(spark, source, declared, tmp_path):
    names = spark.createDataFrame([("child",)], "name string")
    queries = spark.createDataFrame([("q 3",), ("Q 2",)], "name string")
    options = UnpackOptions(source, str(tmp_path / "out"), export_data="JSON", selected_tables=names, selected_queries=queries)
    assert statuses(unpack(spark, options, declared)) == {
        ("table", "child"): "SUCCESS", ("query", "q 3"): "SUCCESS", ("query", "Q 2"): "SUCCESS", **UNSUPPORTED,
    }


def test_a_broken_table_is_a_ledger_entry(spark, source, declared, tmp_path):
    with open(f"{source}/torn.parquet", "wb") as file:
        file.write(b"PAR1 not really PAR1")
    result = unpack(spark, EVERYTHING.at(source, str(tmp_path / "out")), declared)
    got = statuses(result)
    assert got["table", "torn"] == "FAILED" and got["table", "child"] == "SUCCESS" and got["query", "Q 1"] == "SUCCESS"
    assert [(r["code"], r["object_name"]) for r in result.diagnostics.collect()] == [("PREFLIGHT_SCAN_FAILED", "torn")]


def test_a_missing_source_is_an_error_not_a_crash(spark, tmp_path):
    result = unpack(spark, EVERYTHING.at(str(tmp_path / "nowhere.mdb"), str(tmp_path / "out")))
    assert statuses(result) == {("database", "nowhere.mdb"): "FAILED", **UNSUPPORTED}
    error = result.diagnostics.first()
    assert (error["code"], error["severity"], error["details"]["step"]) == ("DATABASE_OPEN_FAILED", "error", "tables")
    assert result.summary.first()["exit_code"] == 2


def test_a_stale_link_is_named_as_such(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise OSError("cannot open C:\\share\\data.mdb")

    monkeypatch.setattr(plan.source_tables, "load_tables", fail)
    result = unpack(spark, SCHEMA_ONLY.at("in", str(tmp_path / "out")))
    assert sorted(r["code"] for r in result.diagnostics.collect()) == ["DATABASE_OPEN_FAILED", "LINKED_DB_PATH_UNAVAILABLE"]


def test_a_lost_artifact_is_reported(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(plan._Run, "_present", lambda self: spark.createDataFrame([("schema/tables/slug=child",)], "path string"))
    result = unpack(spark, SCHEMA_ONLY.at(source, str(tmp_path / "out")))
    (warning,) = result.diagnostics.collect()
    assert (warning["code"], warning["details"]["count"]) == ("VALIDATION_MISSING_ARTIFACTS", "2")


def test_a_lost_part_of_an_export_is_reported(spark, source, declared, tmp_path, monkeypatch):
    out, checked = str(tmp_path / "out"), plan._Run._checked

    def loses_a_part(run, exports):
        result = checked(run, exports)
        os.remove(glob.glob(f"{out}/data/child.csv/part-*")[0])
        return result

    monkeypatch.setattr(plan._Run, "_checked", loses_a_part)
    result = unpack(spark, EVERYTHING.at(source, out), declared)
    assert [(r["code"], r["details"]["count"]) for r in result.diagnostics.collect()] == [("VALIDATION_MISSING_ARTIFACTS", "1")]


def test_many_sources(spark, source, declared, tmp_path):
    sources = {
        "good": SCHEMA_ONLY.at(source, str(tmp_path / "o1")),
        "bad": SCHEMA_ONLY.at(str(tmp_path / "gone"), str(tmp_path / "o2")),
    }
    rows = labelled(unpack_many(spark, sources, {"good": declared})).collect()
    by_source = {s: {r["category"] for r in rows if r["source_id"] == s} for s in sources}
    assert "database" in by_source["bad"] and "relationship" in by_source["good"] and "database" not in by_source["good"]


def test_a_source_asked_for_nothing_fails_alone(spark, source, declared, tmp_path):
    nothing = UnpackOptions(source, str(tmp_path / "none"), selected_tables=spark.createDataFrame([], "name string"))
    results = unpack_many(spark, {"none": nothing, "good": SCHEMA_ONLY.at(source, str(tmp_path / "good"))}, {"good": declared})
    assert statuses(results["none"]) == {("database", "src"): "FAILED"}
    assert results["none"].summary.first()["exit_code"] == 2 and results["none"].manifest.count() == 1
    assert ("table", "child") in statuses(results["good"])


def test_shift_jis_run(spark, source, declared, tmp_path):
    out = str(tmp_path / "out")
    options = UnpackOptions(source, out, export_data="CSV", text_encoding="SHIFT_JIS")
    unpack(spark, options, declared)
    blobs = [open(p, "rb").read() for p in glob.glob(f"{out}/data/main-table.csv/part-*")]
    assert "水利".encode("shift_jis") in b"".join(blobs)


@pytest.mark.parametrize("field,value", [("export_data", "xml"), ("translate_sql", "oracle"), ("text_encoding", "latin1"), ("full_fidelity", "maybe")])
def test_unknown_options_are_refused(field, value):
    with pytest.raises(ValueError, match=field):
        UnpackOptions(**{field: value})


def test_a_scope_without_a_selection_is_refused(spark, source, tmp_path):
    none = spark.createDataFrame([], "name string")
    for options in (UnpackOptions(selected_tables=none), UnpackOptions(selected_queries=none)):
        with pytest.raises(ValueError, match="select at least one"):
            unpack(spark, options)
    UnpackOptions(selected_queries=none, extract_queries=False).check_scopes()
    UnpackOptions(selected_tables=[]).check_scopes()


def test_declared_links_properties_and_audits(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "id int, t string").write.parquet(str(source / "t.parquet"))
    spark.range(2).write.parquet(str(source / "u.parquet"))
    (source / "back.mdb").write_bytes(b"abc")
    (source / "other.mdb").write_bytes(b"")
    declared = Declarations(
        keys=[audit.Key("t", "pk_t", ("id",), True), audit.Key("u", "pk_u", ("id",), True), audit.Key("gone", "pk_gone", ("id",))],
        relationships=[audit.Relationship("t_u", "t", "u", ("id",), ("id",))],
        linked=("u",),
        properties=spark.createDataFrame([("back.mdb", "user", {"Author": "A"})], "source string, scope string, props map<string,string>"),
        linked_properties=spark.createDataFrame([("u", {"Connect": "x"})], "name string, properties map<string,string>"),
        links=spark.createDataFrame([("/d", "C:\\old\\back.mdb"), ("/d", "/gone.mdb")], "source_dir string, linked_path string"),
        dump_files=spark.createDataFrame([("/d", "back.mdb")], "dir string, file_name string"),
    )
    out = tmp_path / "out"
    result = unpack(spark, UnpackOptions(str(source), str(out), audit=True, export_data="JSON"), declared)
    found = sorted((r["code"], r["object_name"]) for r in result.diagnostics.collect())
    assert found == [
        ("AUDIT_NOT_POSSIBLE", "pk_gone"), ("DATABASE_OPEN_FAILED", "gone.mdb"), ("KEY_DOES_NOT_HOLD", "pk_t"),
        ("LINKED_DB_REMAP", "back.mdb"), ("RELATIONSHIP_DOES_NOT_HOLD", "t_u"),
    ]
    info = {(r["source"], r["key"]): r for r in spark.read.json(str(out / "db-info")).collect()}
    back = info["back.mdb", "Author"]
    assert (back["size_bytes"], back["sha256"], back["value"]) == (3, hashlib.sha256(b"abc").hexdigest(), "A")
    assert info["other.mdb", None]["sha256"] == hashlib.sha256(b"").hexdigest()
    assert spark.read.json(str(out / "schema/linked-tables")).first()["properties"]["Connect"] == "x"
    dates = {r["name"]: (r["created"], r["updated"]) for r in spark.read.json(str(out / "schema/tables")).collect()}
    assert all(a and a <= b for a, b in dates.values()) and len(dates) == 2
    assert (result.summary.first()["status"], result.summary.first()["errors"]) == ("Completed with issues", 1)
