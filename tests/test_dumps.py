import hashlib
import os

import pytest

from salvage.plans.queries import QUERIES
from salvage.sources import dumps
from salvage.sources import files as files_module


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "dir string, file_name string")


def test_catalog_lists_and_hashes_every_file(spark, tmp_path):
    contents = {
        "a.MDB": b"x" * 10, "sub dir/b": b"", "sub dir/e+1 %.x": b"", "_marker": b"y", ".hidden.mdb": b"z", "sub dir/c.d.Txt": os.urandom(3_000_000),
        "_folder/.deep/ü [1]*?{a}.accdb": b"w\n", "sub dir/back\\slash.gz": b"not compressed", "sub dir/_x.bz2": os.urandom(100), "empty/none/x": b"1",
    }
    for name, blob in {**contents, "_SUCCESS": b"", "sub dir/_SUCCESS": b"", "_temporary/0/part": b"gone"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(blob)
    (tmp_path / "nothing").mkdir()
    rows = dumps.dump_catalog(spark, str(tmp_path)).collect()
    want = {(name.rsplit("/")[-1], len(blob), hashlib.sha256(blob).hexdigest(), None) for name, blob in contents.items()}
    assert {(r["file_name"], r["size_bytes"], r["sha256"], r["reason"]) for r in rows} == want and len(rows) == len(want)
    kinds = {r["file_name"]: r["extension"] for r in rows}
    assert (kinds["a.MDB"], kinds["b"], kinds["c.d.Txt"], kinds[".hidden.mdb"]) == ("mdb", "unknown", "txt", "mdb")
    assert all(r["path"].endswith(r["file_name"]) and "://" in r["path"] or r["path"].startswith("file:/") for r in rows)


def test_an_unreadable_file_or_folder_is_a_row_with_a_reason(spark, tmp_path):
    for name in ("a.mdb", "b.mdb", "c.mdb"):
        (tmp_path / name).write_bytes(name.encode())
    listed = files_module.list_files(spark, str(tmp_path)).cache()
    assert listed.count() == 3
    (tmp_path / "b.mdb").unlink()
    (tmp_path / "c.mdb").write_bytes(b"longer than before")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files_module.hash_files(listed.coalesce(1)).collect()}
    listed.unpersist()
    assert got["a.mdb"]["sha256"] == hashlib.sha256(b"a.mdb").hexdigest() and got["a.mdb"]["reason"] is None
    assert got["b.mdb"]["sha256"] is None and "No such file" in got["b.mdb"]["reason"]
    assert got["c.mdb"]["sha256"] == hashlib.sha256(b"longer than before").hexdigest()
    assert (got["c.mdb"]["size_bytes"], got["c.mdb"]["reason"]) == (18, "size differs from the listing")
    gone = dumps.dump_catalog(spark, str(tmp_path / "nowhere")).collect()
    assert [(r["file_name"], r["sha256"]) for r in gone] == [("nowhere", None)] and gone[0]["reason"]


def test_catalog_of_a_store_that_only_hadoop_reads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_a.mdb").write_bytes(b"x" * 1000)
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.dumps.link./lake", f"file://{tmp_path}/in")
    rows = dumps.dump_catalog(spark, "viewfs://dumps/lake").collect()
    assert [(r["path"], r["sha256"]) for r in rows] == [("viewfs://dumps/lake/_a.mdb", hashlib.sha256(b"x" * 1000).hexdigest())]


def test_a_second_reading_takes_long_files_whole_without_one_value(spark, tmp_path, monkeypatch):
    contents = {"a": os.urandom(1000), "sub dir/b [1]*.x": os.urandom(1001), "sub dir/d ü": os.urandom(2_500_000)}
    for name, blob in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(blob)
    monkeypatch.setattr(files_module, "WHOLE_VALUE", 1000)
    # Spark's reader fails on any file longer than this, as it always does on one of more than 2 GiB.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows = files_module.hash_files_again(spark, str(tmp_path)).collect()
        (hashes,) = QUERIES["dump_hashes"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    want = {(name.rsplit("/")[-1], len(blob), hashlib.sha256(blob).hexdigest()) for name, blob in contents.items()}
    assert {(r["path"].rsplit("/", 1)[-1], r["length"], r["again"]) for r in rows} == want and len(rows) == len(want)
    assert hashes.hash_form and hashes.agrees and hashes.same_size


def test_a_long_file_that_cannot_be_read_has_no_second_hash(spark, tmp_path, monkeypatch):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(name.encode() * 20)
    # Checksums of Hadoop's local store that are not the file's.
    (tmp_path / ".b.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\0\0\0\0")
    monkeypatch.setattr(files_module, "WHOLE_VALUE", 10)
    found = files_module.hash_files_again(spark, str(tmp_path)).collect()
    assert {r["path"][-1]: r["again"] for r in found} == {"a": hashlib.sha256(b"a" * 20).hexdigest(), "b": None}


def test_catalog_without_hash_opens_no_file(spark, tmp_path):
    (tmp_path / "a.mdb").write_bytes(b"x")
    df = dumps.dump_catalog(spark, str(tmp_path), hashed=False)
    assert df.columns == ["path", "file_name", "extension", "size_bytes", "reason"]
    assert df.first()["size_bytes"] == 1


@pytest.mark.parametrize(
    "name,kind", [("aSYSb", dumps.FRONT_END), ("x_tbl.mdb", dumps.DATA), ("TblSys", dumps.FRONT_END), ("", dumps.UNKNOWN)]
)
def test_classes(spark, name, kind):
    row = dumps.classify_dumps(files(spark, ("/d", name))).first()
    assert (row["classification"], row["headline"]) == (kind, dumps.HEADLINES[kind])


def test_siblings(spark):
    listing = files(
        spark, ("/d", "aSYS.mdb"), ("/d", "aTBL.mdb"), ("/e", "aTBL.mdb"), ("/d", "Sys.mdb"), ("/d", "Tbl.mdb"),
        ("/d", "btbl.mdb"), ("/d", "bsys.mdb"), ("/d", "plain"), ("/d", "SYSsys"), ("/d", "TBLtbl"),
    )
    got = {(r["dir"], r["file_name"]): r for r in dumps.sibling_alternatives(listing).collect()}
    assert len(got) == 10
    assert got["/d", "aSYS.mdb"]["suggested_alternative"] == "aTBL.mdb"
    assert got["/d", "aSYS.mdb"]["recommendation"] == dumps.TRY_SIBLING + "aTBL.mdb"
    assert got["/d", "aTBL.mdb"]["suggested_alternative"] == "aSYS.mdb"
    assert got["/e", "aTBL.mdb"]["suggested_alternative"] is None
    assert got["/d", "Sys.mdb"]["suggested_alternative"] is None  # swapping does not fold case
    assert got["/d", "Sys.mdb"]["recommendation"] == dumps.WATCH_LINKS
    assert got["/d", "bsys.mdb"]["suggested_alternative"] == "btbl.mdb"
    assert got["/d", "SYSsys"]["suggested_alternative"] == "TBLtbl"
    assert got["/d", "plain"]["recommendation"] == dumps.USE_PREFLIGHT


def test_links(no_broadcast):
    listing = files(no_broadcast, ("/d", "a.mdb"), ("/e", "b.mdb"), ("/d", "C:\\x\\c.mdb"))
    cases = [
        ("/d", "/e/b.mdb", "/e/b.mdb", "direct"),
        ("/d", "/gone/a.mdb", "/d/a.mdb", "remapped"),
        ("/d", "C:\\gone\\a.mdb", "/d/a.mdb", "remapped"),
        ("/e", "C:\\gone\\a.mdb", None, "unresolved"),
        ("/d", "a.mdb", "/d/a.mdb", "remapped"),
        ("/d", "/d/", None, "unresolved"),
        ("/d", None, None, "unresolved"),
    ]
    links = no_broadcast.createDataFrame([c[:2] for c in cases], "source_dir string, linked_path string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in dumps.resolve_links(links, listing).collect()}
    assert got == {c[:2]: c[2:] for c in cases}
    compat = {r[1]: r[3] for r in dumps.resolve_links(links, listing, compat=True).collect() if r[0] == "/d"}
    assert compat["C:\\gone\\a.mdb"] == "unresolved" and compat["/gone/a.mdb"] == "remapped"
    codes = [(r["code"], r["object_name"]) for r in dumps.link_diagnostics(dumps.resolve_links(links, listing)).collect()]
    assert codes.count(("LINKED_DB_REMAP", "a.mdb")) == 3 and len(codes) == 6


def test_many_links_to_one_file_keep_every_row(no_broadcast):
    listing = files(no_broadcast, ("/d", "a.mdb"), ("/d", "b.mdb"))
    links = no_broadcast.range(0, 4000, 1, 12).selectExpr(
        "id", "'/d' AS source_dir", "CASE WHEN id % 2 = 0 THEN '/d/a.mdb' ELSE 'C:\\\\x\\\\b.mdb' END AS linked_path"
    )
    counts = {r["resolution"]: r["count"] for r in dumps.resolve_links(links, listing).groupBy("resolution").count().collect()}
    assert counts == {"direct": 2000, "remapped": 2000}


@pytest.mark.parametrize(
    "message,stale",
    [("no C:\\a\\x.mdb", True), ("C:\\x.accdb", True), ("C:\\ only", False), ("/x.mdb", False), ("c:\\x.mdb", False), (None, False)],
)
def test_stale_links(spark, message, stale):
    row = dumps.stale_link_hints(spark.createDataFrame([(message,)], "message string")).first()
    assert row["is_stale_windows_path"] is stale
    assert row["code"] == ("PREFLIGHT_LINKED_PATH_UNAVAILABLE" if stale else "PREFLIGHT_SCAN_FAILED")
    assert row["extract_message"] == (dumps.STALE_ON_OPEN if stale else message)


def test_preflight_without_counts(spark):
    row = dumps.preflight(files(spark, ("/d", "aSYS.mdb")).selectExpr("'s' AS source_id", "*")).first()
    assert (row["table_count"], row["query_count"], row["openable"], row["first_warning"]) == (0, 0, True, None)
