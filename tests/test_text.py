import pytest

from salvage.functions.text import CHARSETS, decode_text, encode_text, redact_secrets

PYTHON_CHARSETS = {"UTF8": "utf-8", "UTF8_BOM": "utf-8-sig", "WINDOWS_31J": "cp932", "SHIFT_JIS": "shift_jis"}
TEXTS = ["plain", "", "水利地益 テスト", "ﾊﾝｶｸ ０１２", "é is not in it", "two\nlines\r\n"]


@pytest.mark.parametrize("encoding", sorted(CHARSETS))
def test_bytes_are_those_of_the_charset(spark, encoding):
    df = encode_text(spark.createDataFrame([(t,) for t in TEXTS], "t string"), "t", encoding)
    want = [t.encode(PYTHON_CHARSETS[encoding], "replace") for t in TEXTS]
    assert [bytes(row["bytes"]) for row in df.collect()] == want
    back = decode_text(df, "bytes", encoding, "back")
    assert [row["back"] for row in back.collect()] == [w.decode(PYTHON_CHARSETS[encoding]) for w in want]


def test_null_text_has_no_bytes(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert all(encode_text(df, "t", e).first()["bytes"] is None for e in CHARSETS)


def test_charset_settings_are_put_back(spark):
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key, None)
    encode_text(spark.createDataFrame([("x",)], "t string"), "t", "SHIFT_JIS")
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize(
    "text,want",
    [
        ("Server=a;Password=x y;Pwd=z", "Server=a;Password=<redacted>;Pwd=<redacted>"),
        ("UID=me;User ID=you;uid=", "UID=<redacted>;User ID=<redacted>;uid="),
        ("pwd=a\nb;c", "pwd=<redacted>;c"),
        ("PWD=", "PWD="),
        ("no secret", "no secret"),
        (None, None),
    ],
)
def test_redaction(spark, text, want):
    assert redact_secrets(spark.createDataFrame([(text,)], "t string"), ["t"]).first()["t"] == want


def test_utf8_leaves_the_session_settings_alone(spark, monkeypatch):
    from salvage.functions import text

    def touched(_):
        raise AssertionError("a setting was touched")

    monkeypatch.setattr(text, "wide_charsets", touched)
    df = spark.createDataFrame([("é",)], "t string")
    again = text.decode_text(text.encode_text(df, "t", "UTF8_BOM"), "bytes", "UTF8_BOM")
    assert again.first().text == "é"
