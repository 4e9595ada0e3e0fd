"""Names that are safe in paths and in file schemas."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNNAMED = "unnamed"
FIELD = "field"


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    # Not Arrow's own utf8_normalize: its composed forms come out decomposed.
    return pa.array(
        [None if text is None else unicodedata.normalize("NFKC", text) for text in values.to_pylist()], pa.string()
    )


def slug(name: Column, ascii_only: bool = False) -> Column:
    """NFKC, runs of anything but letters and digits to one dash, dashes off both ends, lower case.

    NFKC is the only step Spark has no expression for. ASCII text is its own NFKC form, and is known by
    having as many bytes as characters, so only other rows carry a value to the Arrow function.
    ``ascii_only`` leaves that step out where the caller knows the names.
    """
    text = F.coalesce(name, F.lit(""))
    if not ascii_only:
        text = F.coalesce(_nfkc(F.when(F.octet_length(text) != F.char_length(text), text)), text)
    dashed = F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.lower(dashed), F.lit("")), F.lit(UNNAMED))


def slugged(df: DataFrame, name_col: str, ascii_only: bool = False) -> DataFrame:
    return df.withColumn("slug", slug(F.col(name_col), ascii_only))


def slug_of(name: str) -> str:
    """The same rule for a name already on the driver (a table, a column)."""
    text = unicodedata.normalize("NFKC", name)
    return re.sub(r"[\W_]+", "-", text).strip("-").lower() or UNNAMED


def distinct_slugs(names: Iterable[str]) -> dict[str, str]:
    """One slug per name; names that share a slug get ``-2``, ``-3``, ... in name order."""
    taken: set[str] = set()
    slugs = {}
    for name in sorted(names, key=lambda n: (n.lower(), n)):
        slugs[name] = _first_free(slug_of(name), "-", taken)
    return slugs


def safe_names(names: Iterable[str | None]) -> list[str]:
    """File-schema names: ``[A-Za-z0-9_]`` only, not starting with a digit, no two alike.

    Spark compares column names without case, so ``a_b`` and ``A_B`` count as alike.
    """
    taken: set[str] = set()
    safe = []
    for name in names:
        candidate = re.sub(r"[^A-Za-z0-9_]", "_", FIELD if name is None else name) or FIELD
        if not re.match(r"[A-Za-z_]", candidate):
            candidate = "_" + candidate
        safe.append(_first_free(candidate, "_", taken))
    return safe


def _first_free(candidate: str, joiner: str, taken: set[str]) -> str:
    unique, suffix = candidate, 2
    while unique.lower() in taken:
        unique = f"{candidate}{joiner}{suffix}"
        suffix += 1
    taken.add(unique.lower())
    return unique


def safe_columns(df: DataFrame) -> DataFrame:
    """Every column under its safe name, with the original name in the column comment."""
    names = safe_names(df.columns)
    renamed = df.toDF(*names)
    return renamed.select(
        *[
            F.col(name).alias(name, metadata={**field.metadata, "comment": field.name})
            for name, field in zip(names, df.schema.fields)
        ]
    )
