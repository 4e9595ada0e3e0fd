import base64
import datetime as dt
import decimal

from salvage.functions.values import normalize_values, stringify

UTC = dt.timezone.utc


def test_every_kind_of_value(spark):
    moment = dt.datetime(2024, 5, 6, 7, 8, 9, 120000)
    schema = """b binary, t timestamp_ntz, d date, n int, f double, k boolean, m decimal(9,2), s string,
        a array<timestamp_ntz>, x map<int,binary>, r struct<b:binary,q:array<map<string,date>>>, z array<int>"""
    day = dt.date(2024, 1, 2)
    blob = bytes(range(200))
    row = (blob, moment, day, 1, 0.1, True, decimal.Decimal("1.50"), "t", [moment, None], {3: b"hi"}, (b"x", [{"k": day}]), [1])
    got = normalize_values(spark.createDataFrame([row], schema)).first()
    assert got["b"] == base64.b64encode(blob).decode()
    assert got["t"] == "2024-05-06T07:08:09.12Z"
    assert got["d"] == "2024-01-02T00:00:00Z"
    assert (got["n"], got["f"], got["k"], got["m"], got["s"], got["z"]) == (1, 0.1, True, decimal.Decimal("1.50"), "t", [1])
    assert got["a"] == ["2024-05-06T07:08:09.12Z", None]
    assert got["x"] == {"3": "aGk="}
    assert got["r"].asDict(True) == {"b": "eA==", "q": [{"k": "2024-01-02T00:00:00Z"}]}


def test_nulls_stay_null(spark):
    schema = "b binary, t timestamp, d date, a array<date>, x map<int,date>, r struct<b:binary>"
    df = spark.createDataFrame([(None,) * 6], schema)
    assert list(normalize_values(df).first()) == [None] * 6
    assert list(stringify(df).first()) == [None] * 6


def test_instants_are_utc_whatever_the_session_zone(spark):
    stamps = [0, 1_710_000_000, 1_730_008_800, 1_730_012_400]  # the last two straddle a clock change
    want = [dt.datetime.fromtimestamp(s, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for s in stamps]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.createDataFrame([(s,) for s in stamps], "s bigint").selectExpr("timestamp_seconds(s) AS t")
            assert [row["t"] for row in normalize_values(df).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_fraction_digits_as_needed(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-01 00:00:00.000001' b")
    assert list(normalize_values(df).first()) == ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.000001Z"]


def test_unchanged_columns_cost_nothing(spark):
    df = spark.createDataFrame([([0.5],)], "e array<float>")
    assert "transform" not in normalize_values(df)._jdf.queryExecution().toString()


def test_stringify_collections_as_json(spark):
    df = spark.createDataFrame([([1, None], {"a": b"x"}, (1, "q"))], "a array<int>, m map<string,binary>, s struct<i:int,t:string>")
    assert list(stringify(df).first()) == ["[1,null]", '{"a":"eA=="}', '{"i":1,"t":"q"}']


def test_awkward_and_repeated_column_names(spark):
    df = spark.createDataFrame([(1, b"x", "y")], "a int, b binary, c string").toDF("a.b", "a.b", "`q` r")
    assert stringify(df).columns == ["a.b", "a.b", "`q` r"]
    assert list(stringify(df).first()) == ["1", "eA==", "y"]
