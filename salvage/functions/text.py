"""Redaction and character sets of text columns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Option name, charset name, byte order mark in front.
CHARSETS = {
    "UTF8": ("UTF-8", False),
    "UTF8_BOM": ("UTF-8", True),
    "WINDOWS_31J": ("Windows-31J", False),
    "SHIFT_JIS": ("Shift_JIS", False),
}
WIDE_CHARSET_SETTINGS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
BOM = "\ufeff"

# What counts as a secret in a connection string. The look-aheads only save time.
_PASSWORD = r"(?i)(?=p)(password|pwd)=([^;]+)"
_USER = r"(?i)(?=u)(user id|uid)=([^;]+)"


def redact(text: Column) -> Column:
    """Values of password and user keys up to the next semicolon become ``<redacted>``."""
    hidden = F.regexp_replace(text, _PASSWORD, "$1=<redacted>")
    hidden = F.regexp_replace(hidden, _USER, "$1=<redacted>")
    # Most texts hold no pair at all, which a search for one byte tells.
    return F.when(text.contains("="), hidden).otherwise(text)


def redact_secrets(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({name: redact(F.col(name).cast("string")) for name in cols})


@contextmanager
def wide_charsets(spark: SparkSession) -> Iterator[None]:
    """Let ``encode``/``decode`` and the CSV options take any charset of the JVM, ``?`` for the unmappable.

    Both settings are read while a plan is analysed, so the setting is only held for that long.
    """
    before = {key: spark.conf.get(key, None) for key in WIDE_CHARSET_SETTINGS}
    try:
        for key in WIDE_CHARSET_SETTINGS:
            spark.conf.set(key, "true")
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _settings_for(charset: str, spark: SparkSession) -> AbstractContextManager:
    """UTF-8 needs no setting, so none is touched that other threads of the session would see."""
    return nullcontext() if charset == "UTF-8" else wide_charsets(spark)


def encode_text(df: DataFrame, col: str, encoding: str, out: str = "bytes") -> DataFrame:
    """``col`` as the bytes a text file in ``encoding`` holds."""
    charset, bom = CHARSETS[encoding]
    text = F.concat(F.lit(BOM), F.col(col)) if bom else F.col(col)
    with _settings_for(charset, df.sparkSession):
        return df.withColumn(out, F.encode(text, charset))


def decode_text(df: DataFrame, col: str, encoding: str, out: str = "text") -> DataFrame:
    """The text of such bytes; a byte order mark is not part of it."""
    charset, bom = CHARSETS[encoding]
    with _settings_for(charset, df.sparkSession):
        text = F.decode(F.col(col), charset)
        return df.withColumn(out, F.regexp_replace(text, f"^{BOM}", "") if bom else text)
