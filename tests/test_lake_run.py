"""A run over a whole lake: broken tables and sources fail alone, names are safe, and jobs do not follow the sources."""

import json
import os

import pytest

from salvage.operators import sinks
from salvage.options import UnpackOptions
from salvage.plans import lake_run
from salvage.plans.lake_run import LakeDeclarations, unpack_lake
from salvage.sources import lake as lakes
from salvage.sources.tables import READERS, UNREADABLE


def options(root, out, **kw):
    return UnpackOptions(input=str(root), output=str(out), **kw)


def table_rows(result):
    rows = result.coverage.where("category = 'table'").collect()
    return {(r["source_id"], r["name"]): (r["status"], r["details"]["rowCount"]) for r in rows}


@pytest.fixture
def lake(spark, tmp_path):
    root = tmp_path / "lake"
    main = spark.createDataFrame([(1, "a"), (2, None), (3, "c,\r\nd")], "id int, `the name` string")
    main.repartition(2).write.parquet(str(root / "s1/Main Table.parquet"))
    main.write.parquet(str(root / "00 7=%+é/Main Table.parquet"))
    main.write.parquet(str(root / "s2/main-table.parquet"))
    main.write.parquet(str(root / "s2/Main Table.parquet"))
    spark.range(0).write.parquet(str(root / "s1/empty.parquet"))
    spark.createDataFrame([(1, "x", 2)], "lake_source int, LAKE_TABLE string, lake_table_ int").write.parquet(str(root / "s1/clash.parquet"))
    spark.range(6).selectExpr("id", "id % 2 AS half").write.partitionBy("half").parquet(str(root / "s2/parts.parquet"))
    (root / "s2/broken.parquet").write_bytes(b"no footer here")
    (root / "s2/lines.json").write_text('{"a": 1, "n": 1.5}\n\n{"a": 2}\n')
    (root / "s1/lines.json").write_text('{"a": 7, "n": 10.25}\n')
    (root / "s2/t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    (root / "s1/t.csv").write_text("a,b\n3,w\n")
    (root / "s1/t.json").write_text('{"b": "t"}\n')
    (root / "s1/head.csv").write_text("a,b\n")
    (root / "s1/nothing.csv").write_bytes(b"")
    (root / "s1/plain").write_bytes(b"x")
    return root


def test_whole_run(spark, lake, tmp_path):
    out = tmp_path / "out"
    result = unpack_lake(spark, options(lake, out, include_system_objects=True))
    odd = "00 7=%+é"
    assert table_rows(result) == {
        ("s1", "Main Table"): ("SUCCESS", "3"), (odd, "Main Table"): ("SUCCESS", "3"), ("s2", "main-table"): ("SUCCESS", "3"),
        ("s2", "Main Table"): ("SUCCESS", "3"), ("s1", "empty"): ("SUCCESS", "0"), ("s1", "clash"): ("SUCCESS", "1"),
        ("s2", "parts"): ("SUCCESS", "6"), ("s2", "broken"): ("FAILED", "-1"), ("s2", "lines"): ("SUCCESS", "2"),
        ("s1", "lines"): ("SUCCESS", "1"), ("s2", "t"): ("SUCCESS", "2"), ("s1", "t"): ("SUCCESS", "1"), ("s1", "t.json"): ("SUCCESS", "1"),
        ("s1", "head"): ("SUCCESS", "0"), ("s1", "nothing"): ("SUCCESS", "0"), ("s1", "plain"): ("FAILED", "-1"),
    }
    rows = {(r["source_id"], r["table"], r["format"]): r for r in result.exports.collect()}
    assert len(rows) == 14 * 3 and all(r["status"] == "SUCCESS" for r in rows.values())
    assert {k[:2] for k, r in rows.items() if r["path"] is None} == {("s1", "empty"), ("s1", "head"), ("s1", "nothing")}
    slugs = {(k[0], k[1]): r["slug"] for k, r in rows.items()}
    assert (slugs["s2", "Main Table"], slugs["s2", "main-table"], slugs[odd, "Main Table"]) == ("main-table", "main-table~2", "main-table")

    def lines(source, table, kind):
        folder = out / rows[source, table, kind]["path"]
        return sorted("".join((folder / f).read_bytes().decode() for f in os.listdir(folder) if f.startswith("part-")).split("\n" if kind == "JSON" else "\r\n\0"))

    assert [json.loads(x) for x in lines(odd, "Main Table", "JSON") if x] == [{"id": 1, "the name": "a"}, {"id": 2}, {"id": 3, "the name": "c,\r\nd"}]
    # The same bytes as an export of the table alone.
    sinks.export_csv(spark.read.options(**READERS["csv"]).csv(str(lake / "s2/t.csv")), str(tmp_path / "alone"))
    alone = [f.read_bytes().decode() for f in (tmp_path / "alone").glob("part-*")]
    assert lines("s2", "t", "CSV") == alone and alone[0].startswith("a,b\r\n1,")
    assert [json.loads(x) for x in lines("s1", "lines", "JSON") if x] == [{"a": 7, "n": 10.25}]
    assert [json.loads(x) for x in lines("s1", "clash", "JSON") if x] == [{"lake_source": 1, "LAKE_TABLE": "x", "lake_table_": 2}]
    assert sorted(json.loads(x)["half"] for x in lines("s2", "parts", "JSON") if x) == [0, 0, 0, 1, 1, 1]
    parquet = spark.read.parquet(str(out / rows["s1", "Main Table", "PARQUET"]["path"]))
    assert sorted(map(tuple, parquet.collect()), key=str) == [("1", "a"), ("2", None), ("3", "c,\r\nd")]

    schemas = {(r["source_id"], r["name"]): r for r in spark.read.json(str(out / "schema/tables")).collect()}
    assert [c["name"] for c in schemas["s1", "Main Table"]["columns"]] == ["id", "the name"]
    assert [c["name"] for c in schemas["s1", "head"]["columns"]] == ["a", "b"] and [c["type"] for c in schemas["s1", "empty"]["columns"]] == ["bigint"]
    assert schemas["s1", "Main Table"]["created"] and schemas["s2", "broken"]["columns"] is None
    summary = {r["source_id"]: (r["coverage_entries"], r["warnings"], r["errors"], r["status"]) for r in result.summary.collect()}
    assert summary == {
        "s1": (9 + 4, 1, 0, "Completed with warnings"), "s2": (6 + 4, 1, 0, "Completed with warnings"), odd: (5, 0, 0, "Completed cleanly"),
    }
    tables = {r["source_id"]: r["inventory"]["tables"] for r in result.manifest.collect()}
    assert tables == {"s1": 9, "s2": 6, odd: 1}


def damaged(path):
    """A Parquet file whose footer is whole and whose data is not."""
    data = bytearray(path.read_bytes())
    data[4 : len(data) // 2] = b"\xff" * (len(data) // 2 - 4)
    path.write_bytes(bytes(data))


def test_a_damaged_table_fails_alone(spark, tmp_path):
    root = tmp_path / "lake"
    for i in range(5):
        spark.range(2000).selectExpr("id", "sha2(string(id), 256) AS t").coalesce(1).write.parquet(str(root / f"s{i}/t.parquet"))
    folder = root / "s3/t.parquet"
    damaged(next(folder / f for f in os.listdir(folder) if f.startswith("part-")))
    for f in os.listdir(folder):
        if f.endswith(".crc"):
            os.replace(folder / f, tmp_path / f)
    result = unpack_lake(spark, options(root, tmp_path / "out", export_data="JSON"))
    assert table_rows(result) == {(f"s{i}", "t"): ("PARTIAL" if i == 3 else "SUCCESS", "2000") for i in range(5)}
    exports = {r["source_id"]: r for r in result.exports.collect()}
    assert exports["s3"]["reason"] and exports["s3"]["path"] is None and exports["s4"]["sha256"]
    codes = [(r["source_id"], r["code"], r["severity"]) for r in result.diagnostics.collect()]
    assert codes == [("s3", "JSON_EXPORT_PARTIAL", "warning")]
    assert spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "out/data/json")).count() == 8000


def test_lost_rows_are_noticed(spark, tmp_path, monkeypatch):
    root = tmp_path / "lake"
    spark.range(4).write.parquet(str(root / "s/t.parquet"))
    spark.range(4).write.parquet(str(root / "s/_hidden.parquet"))
    whole = lake_run.sinks.export_partitioned
    monkeypatch.setattr(lake_run.sinks, "export_partitioned", lambda df, *rest: whole(df.where("id <> 2"), *rest))
    result = unpack_lake(spark, options(root, tmp_path / "out", export_data="PARQUET"))
    reasons = {r["table"]: (r["status"], r["reason"]) for r in result.exports.collect()}
    assert reasons["t"] == ("PARTIAL", "3 of 4 rows came out") and reasons["_hidden"][0] == "PARTIAL"


def test_declarations(spark, tmp_path):
    root = tmp_path / "lake"
    for s in ("a", "b"):
        spark.range(2).write.parquet(str(root / f"{s}/t.parquet"))
        spark.range(2).write.parquet(str(root / f"{s}/sys.parquet"))
    q = spark.createDataFrame([("a", "q", "SELECT * FROM t"), ("a", "q2", "SELECT Nz(x) FROM u"), ("b", "q", None)], "source_id string, name string, sql string")
    keys = spark.createDataFrame([("a", "t", "pk", True, True, ["id"])], "source_id string, " + lake_run.audit.KEYS)
    rels = spark.createDataFrame([("b", "r", "t", "t", ["id"], ["id"], False, True)], "source_id string, " + lake_run.audit.RELATIONSHIPS)
    flags = spark.createDataFrame([("a", "sys", True, False), ("b", "t", False, True)], "source_id string, name string, system_object boolean, linked boolean")
    links = spark.createDataFrame([("a", "/d", "C:\\x\\data.mdb"), ("b", "/d", "/gone.mdb")], "source_id string, source_dir string, linked_path string")
    files = spark.createDataFrame([("/d", "data.mdb")], "dir string, file_name string")
    result = unpack_lake(spark, options(root, tmp_path / "out", translate_sql="ANSI"), LakeDeclarations(q, keys, rels, flags, links, files))
    assert set(table_rows(result)) == {("a", "t"), ("b", "t"), ("b", "sys")}
    counts = {(r["source_id"], r["kind"]): r["n"] for r in result.counts.collect() if r["n"]}
    assert counts == {("a", "tables"): 1, ("b", "tables"): 2, ("a", "queries"): 2, ("b", "queries"): 1, ("b", "relationships"): 1}
    codes = {(r["source_id"], r["code"]) for r in result.diagnostics.collect()}
    assert {("a", "LINKED_DB_REMAP"), ("b", "DATABASE_OPEN_FAILED")} <= codes
    schemas = {(r["source_id"], r["name"]): r for r in spark.read.json(str(tmp_path / "out/schema/tables")).collect()}
    assert schemas["a", "t"]["indexes"][0]["name"] == "pk" and schemas["b", "t"]["indexes"] is None
    assert spark.read.json(str(tmp_path / "out/queries/dependency-graph")).where("source_id = 'a'").count() == 2
    assert [r["name"] for r in spark.read.json(str(tmp_path / "out/schema/linked-tables")).collect()] == ["t"]


def test_empty_lake_and_selection(spark, tmp_path):
    (tmp_path / "none").mkdir()
    result = unpack_lake(spark, options(tmp_path / "none", tmp_path / "out"))
    assert result.coverage.isEmpty() and result.summary.isEmpty()
    root = tmp_path / "lake"
    spark.range(2).write.parquet(str(root / "a/t.parquet"))
    spark.range(2).write.parquet(str(root / "a/u.parquet"))
    chosen = unpack_lake(spark, options(root, tmp_path / "out2", selected_tables=["u"], extract_data=False))
    assert table_rows(chosen) == {("a", "u"): ("SUCCESS", "2")} and chosen.exports is None


def test_jobs_do_not_follow_the_sources(spark, tmp_path):
    source = tmp_path / "one.parquet"
    spark.range(3).coalesce(1).write.parquet(str(source))
    part = next(f for f in os.listdir(source) if f.startswith("part-"))

    def jobs(n):
        root = tmp_path / str(n)
        for i in range(n):
            os.makedirs(root / f"s{i}/t.parquet")
            os.link(source / part, root / f"s{i}/t.parquet" / part)
        (root / "s1/bad.parquet").write_bytes(b"x")
        (root / "s2/t.parquet/extra.parquet").write_bytes(b"PAR1PAR1")
        tracker = spark.sparkContext.statusTracker()
        before = set(tracker.getJobIdsForGroup(None))
        rows = table_rows(unpack_lake(spark, options(root, tmp_path / f"out{n}", export_data="PARQUET")))
        assert len(rows) == n + 1 and sorted(k for k, v in rows.items() if v == ("FAILED", str(UNREADABLE))) == [("s1", "bad"), ("s2", "t")]
        return len(set(tracker.getJobIdsForGroup(None)) - before)

    # Spark lists more than 32 folders in a job of its own.
    assert jobs(80) <= jobs(40)


def test_paths_of_exports_are_not_worked_out_for_every_row(spark, lake, tmp_path):
    run = lake_run._LakeRun(spark, options(lake, tmp_path / "out"), LakeDeclarations())
    run.tables()
    _, counted = run._written({"PARQUET", "JSON"})
    asked = run.files.join(counted, "source_id", "left").where("_entry LIKE '%.parquet'")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    # What is asked of the counts cannot come before the counting.
    assert "_metadata" not in plan and "RLIKE" not in plan
    read = lakes.row_counts(spark, str(lake), ("parquet",)).where("path LIKE '%x%'").select("n")
    below = read._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].splitlines()[0]
    assert "regexp_replace" not in below
    assert {(r["source_id"], r["_entry"]): r["_n"] for r in counted.where("format = 'JSON'").collect()}["s1", "Main Table.parquet"] == 3
