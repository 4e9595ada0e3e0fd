"""Which objects a run looks at."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salvage.operators.skew import hot_keys, lookup_join
from salvage.options import Selection
from salvage.session import local_rows


def _listed(selection: Selection) -> list[str]:
    return [] if selection is None else sorted(set(selection))


def select_objects(
    df: DataFrame, selected: Selection, name_col: str = "name", hot: DataFrame | None = None
) -> DataFrame:
    """Rows whose name is selected, by exact case; no selection, or an empty one of either form, selects everything.

    A list becomes an ``IN`` filter that reaches the scan. A DataFrame of names is a semi join instead,
    with hot names (``hot``, where they are known already) spread out, as its length is not known; only whether it has a row
    is asked beforehand.
    """
    if isinstance(selected, DataFrame):
        if selected.isEmpty():
            return df
        names = selected.toDF(name_col).distinct()
        return lookup_join(df, names, [name_col], "left_semi", hot).select(*df.columns)
    names = _listed(selected)
    return df.where(F.col(name_col).isin(names)) if names else df


def selected_names(spark: SparkSession, names: Iterable[str], selected: Selection) -> set[str]:
    """The same test for names that the driver holds; a DataFrame is asked once for all of them."""
    if isinstance(selected, DataFrame):
        if selected.isEmpty():
            return set(names)
        listing = local_rows(spark, [(name,) for name in names], "name string")
        return {row["name"] for row in listing.join(selected.toDF("name"), "name", "left_semi").collect()}
    wanted = _listed(selected)
    return {name for name in names if not wanted or name in wanted}


def drop_system(df: DataFrame, include: bool = False) -> DataFrame:
    return df if include else df.where(~F.col("system_object"))


def relationships_in_scope(rels: DataFrame, selected: Selection) -> DataFrame:
    """Relationships with both ends selected; one pass over them finds the hot names of both."""
    hot = hot_keys(rels, ["from_table"], ["to_table"]) if isinstance(selected, DataFrame) else None
    return select_objects(select_objects(rels, selected, "from_table", hot), selected, "to_table", hot)
