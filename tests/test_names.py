import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from salvage.functions.names import distinct_slugs, safe_columns, safe_names, slug_of, slugged

SLUGS = [
    ("水利地益TBL2010", "水利地益tbl2010"),
    ("!!!", "unnamed"),
    ("", "unnamed"),
    ("Order Details", "order-details"),
    ("--a__b--", "a-b"),
    ("ＡＢＣ①", "abc1"),
    ("été", "été"),
    ("Straße", "straße"),
    ("a\nb", "a-b"),
    ("ﬁle", "file"),
]


@pytest.mark.parametrize("name,want", SLUGS)
def test_slug_on_the_driver(name, want):
    assert slug_of(name) == want


def test_slug_of_a_column(spark):
    rows = slugged(spark.createDataFrame([(n,) for n, _ in SLUGS], "name string"), "name").collect()
    assert [row["slug"] for row in rows] == [want for _, want in SLUGS]


def test_slug_of_null_is_unnamed(spark):
    assert slugged(spark.createDataFrame([(None,)], "name string"), "name").first()["slug"] == "unnamed"


def test_column_and_driver_slugs_agree_with_the_rule(spark):
    rng = random.Random(7)
    alphabet = "aZ09_- .é́ß①水ＡªⅧ½\t\n/İ'’"
    names = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)]

    def rule(name):
        dashed = regex.sub(r"[^\p{L}\p{N}]+", "-", unicodedata.normalize("NFKC", name))
        return regex.sub(r"(^-+|-+$)", "", dashed).lower() or "unnamed"

    got = slugged(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string"), "name")
    by_id = {row["i"]: row["slug"] for row in got.collect()}
    assert [by_id[i] for i in range(len(names))] == [rule(n) for n in names]
    assert [slug_of(n) for n in names] == [rule(n) for n in names]


def test_ascii_only_slugs_need_no_python(spark):
    df = slugged(spark.createDataFrame([("A b",)], "name string"), "name", ascii_only=True)
    assert "Python" not in df._jdf.queryExecution().toString() and df.first()["slug"] == "a-b"


def test_names_that_share_a_slug_are_numbered_in_name_order():
    assert distinct_slugs(["A b", "A-B", "c", "a.b"]) == {"A b": "a-b", "A-B": "a-b-2", "a.b": "a-b-3", "c": "c"}


@pytest.mark.parametrize(
    "names,want",
    [
        (["a b", "a-b", "a_b"], ["a_b", "a_b_2", "a_b_3"]),
        (["1st", "", None, "_x"], ["_1st", "field", "field_2", "_x"]),
        (["a_2", "a", "a"], ["a_2", "a", "a_3"]),
        (["顧客", "a", "A"], ["__", "a", "A_2"]),
    ],
)
def test_safe_names(names, want):
    assert safe_names(names) == want


def test_safe_columns_keep_the_original_name_through_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "x int, y int").toDF("order key", "order-key")
    safe_columns(df).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [(f.name, f.metadata["comment"]) for f in back.schema] == [
        ("order_key", "order key"),
        ("order_key_2", "order-key"),
    ]
    assert back.select(F.col("order_key_2")).first()[0] == 2
