"""Declared keys and relationships of a lake: sources side by side, hot values, odd names, what cannot be read or is not there."""

import os

from salvage.operators import audit
from salvage.options import UnpackOptions
from salvage.plans.lake_audit import NOT_THERE
from salvage.plans.lake_run import LakeDeclarations, unpack_lake


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))


def damage(folder, aside):
    for name in os.listdir(folder):
        if name.endswith(".crc"):
            os.replace(folder / name, aside / name)
        elif name.startswith("part-"):
            data = bytearray((folder / name).read_bytes())
            # The footer is whole and the data is not.
            data[4 : len(data) // 2] = b"\xff" * (len(data) // 2 - 4)
            (folder / name).write_bytes(bytes(data))


def test_lake_audits(spark, tmp_path):
    root = tmp_path / "lake"
    hot = [(7, str(i), None) for i in range(300)] + [(i, str(i), i) for i in range(100)] + [(None, "x", 1)]
    schema = "`a.b` int, `back``tick` string, lake_source int"
    write(spark, hot, schema, root / "s1/t.parquet")
    write(spark, [(1, "1", 1), (2, "2", 2)], schema, root / "s 2/t.parquet")
    write(spark, [], schema, root / "s 2/empty.parquet")
    for source in ("s1", "s3"):
        write(spark, [(i, "long" * 2000 + str(i)) for i in range(2000)], "id long, t string", root / f"{source}/other.parquet")
    damage(root / "s3/other.parquet", tmp_path)
    (root / "s1/texts.csv").write_text("ref\n5\n7\n7\n1000\nword\n")
    declared = [
        ("s1", "t", "pk", True, True, ["a.b"]), ("s1", "t", "pk", True, True, ["a.b"]), ("s 2", "t", "pk", True, True, ["a.b"]),
        ("s 2", "empty", "pk", True, None, ["a.b"]), ("s1", "t", "two", None, True, ["back`tick", "a.b"]), ("s1", "t", "loose", False, None, ["a.b"]),
        ("s1", "other", "long", False, True, ["t"]), ("s3", "other", "long", False, True, ["t"]), ("s3", "gone", "pk", True, True, ["id"]),
        ("s1", "t", "none", True, True, ["A.B"]), ("s1", "t", "nothing", True, True, []), ("s1", "t", "null", True, True, None),
    ]
    links = [
        ("s1", "self", "t", "t", ["lake_source"], ["a.b"]), ("s 2", "self", "t", "t", ["lake_source"], ["a.b"]),
        ("s1", "texts", "texts", "other", ["ref"], ["id"]), ("s 2", "empty", "empty", "t", ["a.b"], ["a.b"]),
        ("s 2", "to_empty", "t", "empty", ["a.b"], ["a.b"]), ("s1", "pair", "t", "t", ["a.b", "back`tick"], ["a.b", "back`tick"]),
        ("s3", "broken", "other", "other", ["t"], ["t"]), ("s1", "whole", "other", "other", ["t"], ["t"]),
        ("s1", "uneven", "t", "t", ["a.b"], ["a.b", "lake_source"]), ("s1", "elsewhere", "t", "empty", ["a.b"], ["a.b"]),
    ]
    declarations = LakeDeclarations(
        keys=spark.createDataFrame(declared, "source_id string, " + audit.KEYS),
        relationships=spark.createDataFrame([(*row, False, False) for row in links], "source_id string, " + audit.RELATIONSHIPS),
    )
    options = UnpackOptions(str(root), str(tmp_path / "out"), extract_data=False, audit=True)
    result = unpack_lake(spark, options, declarations)

    found = [tuple(r) for r in result.key_audits.collect()]
    checked = sorted(row[:-1] for row in found if row[-1] is None)
    assert checked == sorted([
        ("s1", "t", "pk", 401, 300, 1, False), ("s1", "t", "pk", 401, 300, 1, False), ("s 2", "t", "pk", 2, 0, 0, True),
        ("s 2", "empty", "pk", 0, 0, 0, True), ("s1", "t", "two", 401, 1, 1, False), ("s1", "t", "loose", 401, 300, 1, True),
        ("s1", "other", "long", 2000, 0, 0, True),
    ])
    unchecked = {row[:3]: row for row in found if row[-1] is not None}
    assert {k for k, row in unchecked.items() if row[-1] == NOT_THERE} == {
        ("s3", "gone", "pk"), ("s1", "t", "none"), ("s1", "t", "nothing"), ("s1", "t", "null"),
    }
    assert len(unchecked) == 5 and unchecked["s3", "other", "long"][3:7] == (None,) * 4

    found = {(r["source_id"], r["name"]): tuple(r)[2:] for r in result.relationship_audits.collect()}
    assert len(found) == len(links)
    assert found["s1", "self"] == (401, 0, True, None) and found["s 2", "self"] == (2, 0, True, None)
    # The word refers to nothing.
    assert found["s1", "texts"] == (5, 1, False, None) and found["s 2", "empty"] == (0, 0, True, None)
    assert found["s 2", "to_empty"] == (2, 2, False, None) and found["s1", "pair"] == (401, 0, True, None)
    assert found["s1", "whole"] == (2000, 0, True, None)
    assert found["s3", "broken"][:3] == (None,) * 3 and found["s3", "broken"][3] not in (None, NOT_THERE)
    assert found["s1", "uneven"] == found["s1", "elsewhere"] == (None, None, None, NOT_THERE)
    codes = {(r["source_id"], r["code"], r["object_name"]) for r in result.diagnostics.collect()}
    assert {
        ("s1", "KEY_DOES_NOT_HOLD", "pk"), ("s3", "AUDIT_NOT_POSSIBLE", "long"), ("s 2", "RELATIONSHIP_DOES_NOT_HOLD", "to_empty"),
        ("s3", "AUDIT_NOT_POSSIBLE", "broken"),
    } <= codes
    assert ("s 2", "KEY_DOES_NOT_HOLD", "pk") not in codes


def test_nothing_declared(spark, tmp_path):
    root = tmp_path / "lake"
    spark.range(2).write.parquet(str(root / "a/t.parquet"))
    none = LakeDeclarations(keys=spark.createDataFrame([], "source_id string, " + audit.KEYS))
    result = unpack_lake(spark, UnpackOptions(str(root), str(tmp_path / "out"), extract_data=False, audit=True), none)
    assert result.key_audits.isEmpty() and result.relationship_audits is None
