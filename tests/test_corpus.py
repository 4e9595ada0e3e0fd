import random

import pytest
import regex
from pyspark.sql import functions as F

from salvage.functions import sql_text
from salvage.operators import corpus


def one(spark, operator, sql, **options):
    return operator(spark.createDataFrame([("q", sql)], "name string, sql string"), **options).first()


@pytest.mark.parametrize(
    "sql,kind",
    [
        (" \t\nSELECT 1", "select"),
        ("select a into b from c", "select"),
        ("SELECT a UNION SELECT b", "select"),
        ("(select a) union (select b)", "union"),
        ("a\nunion b", "unknown"),
        (" union ", "unknown"),
        ("insert into x", "append"),
        ("UPDATE x", "update"),
        ("delete from x", "delete"),
        ("TRANSFORM x", "crosstab"),
        ("create table x", "make-table"),
        ("CREATE  TABLE x", "ddl"),
        ("create index x", "ddl"),
        ("alter table x", "ddl"),
        ("drop table x", "ddl"),
        ("drop", "unknown"),
        ("PARAMETERS p Text; select 1", "parameter"),
        ("pass-through x", "pass-through"),
        ("pass-through a union b", "union"),
        ("\x00\x1fselect", "select"),
        ("\u00a0select", "unknown"),
        ("", "unknown"),
        (None, "unknown"),
    ],
)
def test_classes(spark, sql, kind):
    assert one(spark, corpus.classify_queries, sql)["type"] == kind


@pytest.mark.parametrize(
    "sql,want",
    [
        ("IIF(a", [sql_text.WARN_CONDITIONAL]),
        ("switch(a) Nz(b)", [sql_text.WARN_CONDITIONAL]),
        ("DSum(a) DCount(b)", [sql_text.WARN_DOMAIN]),
        ("#2024#", [sql_text.WARN_DATE]),
        ("a LIKE 'x'", []),
        ("a*b", []),
        ("a LIKE '*'", [sql_text.WARN_WILDCARD]),
        ("a like '*' # dlookup( iif(", [sql_text.WARN_CONDITIONAL, sql_text.WARN_DOMAIN, sql_text.WARN_DATE, sql_text.WARN_WILDCARD]),
        (None, []),
    ],
)
def test_warnings(spark, sql, want):
    assert one(spark, corpus.dialect_warnings, sql)["warnings"] == want


@pytest.mark.parametrize(
    "sql,compat,strict",
    [
        ("SELECT * FROM [A B] JOIN C", ["A B", "C"], ["A B", "C"]),
        ("FROM Orders INNER JOIN Customers ON Orders.id", ["Orders INNER JOIN Customers ON Orders"], ["Orders", "Customers"]),
        ("FROM [A-B]", ["A"], ["A-B"]),
        ("from a; FROM a; into  b", ["a", "b"], ["a", "b"]),
        ("from  (select", [""], []),
        ("from (select", [], []),
        ("UPDATE 水利 SET", ["水利 SET"], ["水利"]),
        ("from [ x ] join\n\ty", ["x", "y"], ["x", "y"]),
        ("FROM [A|B] join [C'D] INTO [a \x1f | b]", ["A", "C", "a"], ["A|B", "C'D", "a \x1f | b"]),
        ("SELECT 'from x' FROM y WHERE a = \"join z\"", ["x", "y WHERE a", "z"], ["y"]),
        ("FROM a -- from b\njoin c /* update d\n */ into e", ["a", "b", "c", "d", "e"], ["a", "c", "e"]),
        ("FROM /* x */ a, 'it''s from q' [from] b from 'c'", ["q"], ["a"]),
        ("from 'open FROM t", ["t"], ["t"]),
        ("fromx from2 a inner join[b]", [], ["b"]),
        ("", [], []),
        (None, [], []),
    ],
)
def test_dependencies(spark, sql, compat, strict):
    assert one(spark, corpus.query_dependencies, sql)["dependencies"] == compat
    assert one(spark, corpus.query_dependencies, sql, mode="strict")["dependencies"] == strict


def test_dependencies_follow_the_pattern_on_random_texts(spark):
    rng = random.Random(3)
    words = ["from", "FROM", "join", "update", "into", "  ", " ", "\n", "[", "]", "A B", "é", "_x", "1", ",", "(", "|", "."]
    texts = ["".join(rng.choices(words, k=rng.randrange(25))) for _ in range(600)]
    pattern = regex.compile(r"(?i)(from|join|update|into)[ \t\n\x0b\f\r]+\[?([\p{L}\p{N}_ ]+)\]?")
    want = [list(dict.fromkeys(m[2].strip(" ") for m in pattern.finditer(t))) for t in texts]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, sql string")
    got = {int(r["name"]): r["dependencies"] for r in corpus.query_dependencies(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert any(want)


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        one(spark, corpus.query_dependencies, "from a", mode="loose")


@pytest.mark.parametrize(
    "sql,translated,confidence,warnings",
    [
        ("SELECT IIf([x]=1,'y','z') FROM [Table1]", "SELECT IIf(\"x\"=1,'y','z') FROM \"Table1\"", 0.25, [sql_text.WARN_FUNCTION]),
        ("SELECT '[a]'", "SELECT '\"a\"'", 0.45, []),
        ("a like '*' or Date()", "a like '*' or Date()", 0.45 - 0.2 - 0.1, [sql_text.WARN_FUNCTION, sql_text.WARN_LIKE]),
        ("a like '*'", "a like '*'", 0.45 - 0.1, [sql_text.WARN_LIKE]),
        ("switch(a)", "switch(a)", 0.45, []),
        ("", None, 0.0, [sql_text.WARN_NOT_TRANSLATED]),
        (" \t\n ", None, 0.0, [sql_text.WARN_NOT_TRANSLATED]),
        ("\u00a0", "\u00a0", 0.45, []),
        (None, None, 0.0, [sql_text.WARN_NOT_TRANSLATED]),
    ],
)
def test_translation(spark, sql, translated, confidence, warnings):
    for dialect in ("ansi", "POSTGRES", "MYSQL", "SQLSERVER"):
        got = one(spark, corpus.translate_queries, sql, dialect=dialect)
        assert (got["translated"], got["confidence"], got["translation_warnings"]) == (translated, confidence, warnings)


def test_no_dialect_translates_nothing(spark):
    got = one(spark, corpus.translate_queries, "select 1", dialect="NONE")
    assert (got["translated"], got["confidence"], got["translation_warnings"]) == (None, 0.0, [sql_text.WARN_NOT_TRANSLATED])


def test_translation_status_follows_the_bar(spark):
    q = corpus.translate_queries(spark.createDataFrame([("q", "select 1")], "name string, sql string"))
    assert corpus.translation_ledger(q, "ANSI")[1].first()["status"] == "PARTIAL"
    assert corpus.translation_ledger(q, "ANSI", bar=0.4)[1].first()["status"] == "SUCCESS"


@pytest.mark.parametrize(
    "sql,count",
    [("PARAMETERS a Text, [b c] Long; SELECT", 2), (" parameters x Text;", 1), ("select 1", 0), (None, 0), ("parameters none", 0)],
)
def test_parameter_count(spark, sql, count):
    assert one(spark, corpus.query_inventory, sql)["parameter_count"] == count


def test_listings_are_sorted_without_case(spark):
    df = spark.createDataFrame([("b", None), ("A", "x"), ("c", "[y]"), ("B", " ")], "name string, sql string")
    assert [r["name"] for r in corpus.query_inventory(df).collect()] == ["A", "B", "b", "c"]
    bench = corpus.sql_workbench(df, "ANSI").collect()
    assert [(r["name"], r["raw"], r["translated"]) for r in bench] == [
        ("A", "x", "x"),
        ("B", "-- empty SQL --", "-- no translation --"),
        ("b", "-- empty SQL --", "-- no translation --"),
        ("c", "[y]", '"y"'),
    ]


def test_model_carries_keys_and_everything_else(spark):
    df = spark.createDataFrame([("s1", "My Query", "SELECT Nz(a) FROM [T 1]")], "source_id string, name string, sql string")
    got = corpus.query_models(df, ("source_id",)).first().asDict()
    assert got == {
        "source_id": "s1", "name": "My Query", "slug": "my-query", "type": "select",
        "sql": "SELECT Nz(a) FROM [T 1]", "parameters": [], "dependencies": ["T 1"],
        "warnings": [sql_text.WARN_CONDITIONAL],
    }


def test_exploding_mines_each_text_once(spark, tmp_path):
    spark.createDataFrame([("q", "select 1 from a")], "name string, sql string").write.parquet(str(tmp_path / "q"))
    df = spark.read.parquet(str(tmp_path / "q"))
    edges = corpus.dependency_edges(df)._jdf.queryExecution().executedPlan().toString()
    assert edges.count("regexp_extract_all") == 1
    found = corpus.translation_ledger(corpus.translate_queries(df), "ANSI")[0]
    assert found._jdf.queryExecution().executedPlan().toString().count("dlookup(") == 1


def test_mining_needs_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([("q", "select 1")], "name string, sql string")
    plans = [
        corpus.query_models(df, ascii_names=True), corpus.translate_queries(df), corpus.dependency_edges(df),
        corpus.dialect_warnings(df).select(F.explode("warnings")),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Python" not in text and "lambda" not in text


def test_parameters_with_commas_in_names_and_types(spark):
    from pyspark.sql import functions as F

    from salvage.operators.corpus import parameter_count

    rows = [
        ("PARAMETERS [Enter a, b] Text, c Decimal(10,2); SELECT 1", 2),
        ("PARAMETERS [a;b] Text; SELECT 1", 1),
        ("SELECT [a, b] FROM t", 0),
    ]
    found = spark.createDataFrame(rows, "sql string, n int").select(parameter_count(F.col("sql")).alias("got"), "n")
    assert all(r.got == r.n for r in found.collect())
