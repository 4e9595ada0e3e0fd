"""Cell values in the form the exports carry (B1, B2).

The rewrite follows the schema, so a column whose type needs no change is passed on untouched and the
whole projection stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UTC_NAMES = {"UTC", "Etc/UTC", "Z", "GMT", "Etc/GMT", "+00:00", "GMT+0"}


def _needs_change(kind: T.DataType) -> bool:
    if isinstance(kind, (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _needs_change(kind.elementType)
    if isinstance(kind, T.MapType):
        return not isinstance(kind.keyType, T.StringType) or _needs_change(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_needs_change(field.dataType) for field in kind.fields)
    return False


def _iso(wall_clock: Column) -> Column:
    return F.concat(F.replace(wall_clock.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _utc_wall_clock(instant: Column) -> Column:
    # Counted from the epoch without a zone, so a clock change in the session zone cannot blur it.
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


def normalize(value: Column, kind: T.DataType, utc_session: bool = True) -> Column:
    """Binary as base64, times as ISO-8601 in UTC, collections element by element, the rest unchanged."""
    if not _needs_change(kind):
        return value
    if isinstance(kind, T.BinaryType):
        return F.translate(F.base64(value), "\r\n", "")
    if isinstance(kind, T.TimestampType):
        return _iso(value if utc_session else _utc_wall_clock(value))
    if isinstance(kind, T.TimestampNTZType):
        return _iso(value)
    if isinstance(kind, T.DateType):
        return F.concat(value.cast("string"), F.lit("T00:00:00Z"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: normalize(item, kind.elementType, utc_session))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            value = F.transform_keys(value, lambda key, _: key.cast("string"))
        if _needs_change(kind.valueType):
            value = F.transform_values(value, lambda _, item: normalize(item, kind.valueType, utc_session))
        return value
    fields = [
        normalize(value.getField(field.name), field.dataType, utc_session).alias(field.name)
        for field in kind.fields
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def _positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    # Source tables may hold names that need quoting or occur twice; positions are never ambiguous.
    plain = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*plain), plain


def normalize_values(df: DataFrame) -> DataFrame:
    utc = df.sparkSession.conf.get("spark.sql.session.timeZone") in _UTC_NAMES
    plain, names = _positional(df)
    return plain.select(
        *[
            normalize(F.col(name), field.dataType, utc).alias(field.name)
            for name, field in zip(names, df.schema.fields)
        ]
    )


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text: the normalised value, collections as JSON, null kept."""
    normalized = normalize_values(df)
    plain, names = _positional(normalized)
    return plain.select(
        *[
            _text(F.col(name), field.dataType).alias(field.name)
            for name, field in zip(names, normalized.schema.fields)
        ]
    )


def _text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def _holds_keys(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_keys(kind.elementType)
    return isinstance(kind, (T.MapType, T.StructType))


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """Struct fields and map entries in key order, map entries without a value left out."""
    if not _holds_keys(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: sorted_keys(item, kind.elementType))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda _, item: item.isNotNull())
        if _holds_keys(kind.valueType):
            kept = F.transform_values(kept, lambda _, item: sorted_keys(item, kind.valueType))
        return F.map_from_entries(F.array_sort(F.map_entries(kept), _by_key))
    fields = sorted(kind.fields, key=lambda field: field.name)
    return F.when(
        value.isNotNull(),
        F.struct(*[sorted_keys(value.getField(f.name), f.dataType).alias(f.name) for f in fields]),
    )


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
