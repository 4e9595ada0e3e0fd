import codecs
import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from salvage.operators import sinks

NASTY = ["plain", 'quo"ted', "com,ma", "line\nfeed", "cr\rlf\r\nend", "  spaces  ", "#hash", "\\back\\", "水利", "tab\t", "'"]


def nasty(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)] + [(99, None)], "id int, `the text` string")


def parts(path):
    return sorted(glob.glob(f"{path}/part-*"))


def texts(df):
    return sorted((row[0], row[1]) for row in df.collect())


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.export_csv(nasty(spark), path)
    back = sinks.read_csv(spark, path, ["id", "the text"])
    assert texts(back) == sorted([(str(i), t) for i, t in enumerate(NASTY)] + [("99", None)], key=lambda r: r[0])
    blob = open(parts(path)[0], "rb").read()
    assert blob.startswith(b"id,the text\r\n") and b'"quo""ted"' in b"".join(open(p, "rb").read() for p in parts(path))


@pytest.mark.parametrize("encoding,charset", [("UTF8_BOM", "utf-8-sig"), ("WINDOWS_31J", "cp932"), ("SHIFT_JIS", "shift_jis")])
def test_csv_charsets(spark, tmp_path, encoding, charset):
    path = str(tmp_path / "t")
    sinks.export_csv(nasty(spark), path, encoding)
    for part in parts(path):
        blob = open(part, "rb").read()
        assert blob.startswith(codecs.BOM_UTF8) == (encoding == "UTF8_BOM")
        assert blob.decode(charset).startswith("id,the text\r\n")
    back = sinks.read_csv(spark, path, ["id", "the text"], encoding)
    assert texts(back) == sorted([(str(i), t) for i, t in enumerate(NASTY)] + [("99", None)], key=lambda r: r[0])


def test_json_keys_are_sorted_and_nulls_left_out_at_every_level(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, {"z": 1, "a": None, "b": 2}, (None, [{"y": 1, "x": 2}]), None)],
        "id int, m map<string,int>, s struct<q:int,p:array<map<string,int>>>, gone string",
    )
    sinks.export_json(df, str(tmp_path / "t"))
    (line,) = [line for p in parts(tmp_path / "t") for line in open(p)]
    assert line.strip() == '{"id":1,"m":{"b":2,"z":1},"s":{"p":[{"x":2,"y":1}]}}'


def test_parquet_is_text_under_safe_names_unless_typed(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "`an id` int, t string")
    sinks.export_parquet(df, str(tmp_path / "a"))
    sinks.export_parquet(df, str(tmp_path / "b"), typed=True)
    text, typed = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    assert text.dtypes == [("an_id", "string"), ("t", "string")] and tuple(text.first()) == ("1", None)
    assert typed.dtypes[0] == ("an_id", "int")
    assert text.schema["an_id"].metadata["comment"] == "an id"


def test_a_failing_export_is_isolated(spark, tmp_path):
    bad = spark.range(3).selectExpr("raise_error('no such row') AS a", "id")
    ledger = sinks.export_tables(spark, {"Bad": bad, "good": spark.range(2)}, str(tmp_path))
    rows = {(r["table"], r["format"]): r for r in ledger.collect()}
    assert {k: (r["status"], r["row_count"]) for k, r in rows.items()} == {
        **{("good", f): ("SUCCESS", 2) for f in ("CSV", "JSON", "PARQUET")},
        **{("Bad", f): ("PARTIAL", None) for f in ("CSV", "JSON", "PARQUET")},
    }
    assert "no such row" in rows["Bad", "PARQUET"]["reason"]
    (sidecar,) = parts(tmp_path / "data" / "bad.parquet.metadata")
    assert json.load(open(sidecar))["rawSourceHint"] == "data/bad.json"
    codes = {r["code"]: r["message"] for r in sinks.export_diagnostics(ledger).collect()}
    assert codes["PARQUET_EXPORT_PARTIAL"] == "Parquet export failed for table Bad"


def test_tables_that_share_a_slug_do_not_overwrite_each_other(spark, tmp_path):
    ledger = sinks.export_tables(spark, {"A-B": spark.range(1), "A B": spark.range(2)}, str(tmp_path), ["JSON"])
    assert {r["table"]: (r["path"], r["row_count"]) for r in ledger.collect()} == {
        "A B": ("data/a-b.json", 2),
        "A-B": ("data/a-b-2.json", 1),
    }
    assert spark.read.json(str(tmp_path / "data" / "a-b.json")).count() == 2


def test_checksums_skip_markers(spark, tmp_path):
    sinks.export_json(spark.range(4).repartition(2), str(tmp_path / "t"))
    rows = sinks.artifact_checksums(spark, str(tmp_path)).collect()
    assert len(rows) == len(parts(tmp_path / "t")) == 2 and all(len(r["sha256"]) == 64 for r in rows)


def test_hash_tree_is_made_of_part_hashes(spark, tmp_path):
    ledger = sinks.export_tables(spark, {"t": spark.range(50).repartition(9), "u v": spark.range(3)}, str(tmp_path), ["JSON", "CSV"])
    found = sinks.artifact_checksums(spark, str(tmp_path / "data")).cache()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for row in sinks.with_checksums(ledger, found).collect():
        nodes = {}
        for path in parts(tmp_path / row["path"]):
            name = os.path.basename(path)
            with open(path, "rb") as file:
                nodes.setdefault(sha(name)[:2], []).append(f"{name}:{hashlib.sha256(file.read()).hexdigest()}")
        assert nodes
        hashes = sorted(f"{node}:{sha(chr(10).join(sorted(leaves)))}" for node, leaves in nodes.items())
        assert row["sha256"] == sha("\n".join(hashes))

    recorded = found.collect()
    found.unpersist()
    before = spark.createDataFrame(recorded, found.schema)
    assert sinks.changed_parts(before, sinks.artifact_checksums(spark, str(tmp_path / "data"))).count() == 0
    changed, gone = (p for p in sorted(parts(tmp_path / "data/t.json"))[:2])
    for crc in glob.glob(str(tmp_path / "data/t.json/.*.crc")):
        os.remove(crc)
    with open(changed, "a") as file:
        file.write("x")
    os.remove(gone)
    (tmp_path / "data/t.json/part-new").write_text("y")
    states = {r["part"]: r["state"] for r in sinks.changed_parts(before, sinks.artifact_checksums(spark, str(tmp_path / "data"))).collect()}
    assert states == {os.path.basename(changed): "changed", os.path.basename(gone): "missing", "part-new": "new"}


def test_a_tree_with_an_unreadable_part_has_no_hash(spark):
    rows = [("a", "p1", 1, "x", None), ("a", "p2", 1, None, "lost"), ("b", "p1", 1, "x", None)]
    found = {r["artifact"]: r["sha256"] for r in sinks.hash_tree(spark.createDataFrame(rows, sinks.PARTS)).collect()}
    assert found["a"] is None and len(found["b"]) == 64
    assert sinks.hash_tree(spark.createDataFrame([], sinks.PARTS)).count() == 0


def test_fingerprint_ignores_order_and_layout_but_not_values(spark):
    df = spark.range(500).selectExpr("id", "concat('r', id % 7) AS t", "IF(id % 5 = 0, NULL, id) AS n")
    first = sinks.content_fingerprint(df).first()
    assert sinks.content_fingerprint(df.repartition(7).orderBy(F.desc("id"))).first() == first
    assert first["n"] == 500
    assert sinks.content_fingerprint(df.withColumn("t", F.concat("t", F.lit(" ")))).first()["h"] != first["h"]
    assert sinks.content_fingerprint(df.unionByName(df)).first()["h"] != first["h"]
    a = spark.createDataFrame([("1:a", None)], "x string, y string")
    b = spark.createDataFrame([(None, "1:a")], "x string, y string")
    assert sinks.content_fingerprint(a).first()["h"] != sinks.content_fingerprint(b).first()["h"]
    assert tuple(sinks.content_fingerprint(df.where("id < 0")).first()) == (0, "0")
