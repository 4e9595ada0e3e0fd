"""Options of one unpack run, and its two presets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# Closed vocabularies (fixed values).
FORMATS = ("CSV", "JSON", "PARQUET")
EXPORT_CHOICES = FORMATS + ("ALL",)
DIALECTS = ("ANSI", "POSTGRES", "MYSQL", "SQLSERVER", "NONE")
ENCODINGS = ("UTF8", "UTF8_BOM", "WINDOWS_31J", "SHIFT_JIS")
FIDELITY = ("AUTO", "ON", "OFF")

Selection = Iterable[str] | DataFrame | None


@dataclass(frozen=True)
class UnpackOptions:
    """What to take out of a source and how to write it.

    An empty or missing selection means *everything*; a selection may also be a one-column DataFrame of
    names, which is joined instead of being listed in the plan.
    """

    input: str = ""
    output: str = ""
    full_fidelity: str = "AUTO"
    include_system_objects: bool = False
    export_data: str = "ALL"
    text_encoding: str = "UTF8"
    translate_sql: str = "NONE"
    validate: bool = True
    extract_schema: bool = True
    extract_data: bool = True
    extract_queries: bool = True
    write_docs: bool = True
    audit: bool = False
    selected_tables: Selection = None
    selected_queries: Selection = None
    typed_parquet: bool = False
    parallel_jobs: int = 8

    def __post_init__(self) -> None:
        for field, allowed in (
            ("full_fidelity", FIDELITY),
            ("export_data", EXPORT_CHOICES),
            ("text_encoding", ENCODINGS),
            ("translate_sql", DIALECTS),
        ):
            value = getattr(self, field).upper()
            if value not in allowed:
                raise ValueError(f"{field}={value!r} is not one of {', '.join(allowed)}")
            object.__setattr__(self, field, value)

    @property
    def formats(self) -> tuple[str, ...]:
        return FORMATS if self.export_data == "ALL" else (self.export_data,)

    def at(self, input: str, output: str) -> UnpackOptions:
        return replace(self, input=input, output=output)

    def check_scopes(self) -> None:
        """Refuse a scope whose selection was made and came out empty (G3); ``None`` still means all."""
        if (self.extract_schema or self.extract_data) and _chosen_nothing(self.selected_tables):
            raise ValueError("select at least one table before extracting schema or table data")
        if self.extract_queries and _chosen_nothing(self.selected_queries):
            raise ValueError("select at least one query before extracting saved queries")


def _chosen_nothing(selection: Selection) -> bool:
    return isinstance(selection, DataFrame) and selection.isEmpty()


EVERYTHING = UnpackOptions(export_data="ALL", translate_sql="NONE")
SCHEMA_ONLY = UnpackOptions(
    export_data="JSON", translate_sql="NONE", extract_data=False, extract_queries=False
)
