"""Declared structure, and whether the data keeps to it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salvage.functions.values import normalize_values
from salvage.operators.scope import relationships_in_scope, select_objects
from salvage.options import Selection
from salvage.session import union_all

KEYS = "table string, name string, primary_key boolean, unique boolean, columns array<string>"
RELATIONSHIPS = (
    "name string, from_table string, to_table string, from_columns array<string>, "
    "to_columns array<string>, cascade_deletes boolean, cascade_updates boolean"
)


@dataclass(frozen=True)
class Key:
    """A declared index."""

    table: str
    name: str
    columns: tuple[str, ...]
    primary_key: bool = False
    unique: bool = True


@dataclass(frozen=True)
class Relationship:
    """A declared reference from a child table to its parent."""

    name: str
    from_table: str
    to_table: str
    from_columns: tuple[str, ...]
    to_columns: tuple[str, ...]
    cascade_deletes: bool = False
    cascade_updates: bool = False


def declared_keys(keys: DataFrame, selected: Selection = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The index listing. It follows the selection but not the system flag."""
    listing = keys.select(*by, "table", "name", "primary_key", "unique", "columns")
    return select_objects(listing, selected, "table")


def declared_relationships(rels: DataFrame, selected: Selection = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The relationship listing."""
    listing = rels.select(
        *by, "name", "from_table", "to_table", "from_columns", "to_columns", "cascade_deletes", "cascade_updates"
    )
    return relationships_in_scope(listing, selected)


def constraints(rels: DataFrame, selected: Selection = None, by: tuple[str, ...] = ()) -> DataFrame:
    """E5: relationships under their second name."""
    return declared_relationships(rels, selected, by)


def _any_null(cols: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def _short(value: Column, kind: T.DataType) -> Column:
    """Long texts stand in as their SHA-256, longer than any text kept as it is: a key over whole
    documents moves digests, not documents."""
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        return value
    return F.when(F.octet_length(value) > 64, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(
        value.cast("string")
    )


def key_groups(df: DataFrame, columns: Iterable[Column], by: Iterable[Column] = ()) -> DataFrame:
    """The different values of a key as ``_k0``, ``_k1``, ..., each with the number of its rows ``_n``.

    Equal keys combine on the map side, so a value that fills a third of the table is one row per task; only the key columns are
    read.
    """
    types = df.select(*columns).schema.fields
    values = [_short(c, f.dataType).alias(f"_k{i}") for i, (c, f) in enumerate(zip(columns, types))]
    return df.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_n"))


def key_facts(groups: DataFrame, width: int, by: Iterable[str] = ()) -> DataFrame:
    """Rows, surplus rows and incomplete rows of a key of so many columns."""
    incomplete = _any_null([f"_k{i}" for i in range(width)])
    return groups.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~incomplete, F.col("_n") - 1)), F.lit(0)).alias("n_dup"),
        F.coalesce(F.sum(F.when(incomplete, F.col("_n"))), F.lit(0)).alias("n_null"),
    )


def key_holds(primary: str | Column, unique: str | Column) -> Column:
    """Whether the facts of a key are those of a unique, or primary, one; missing flags ask for nothing."""
    primary, unique = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)) for c in (primary, unique))
    return (~(primary | unique) | (F.col("n_dup") == 0)) & (~primary | (F.col("n_null") == 0))


def _audit_key(df: DataFrame, key: Key) -> DataFrame:
    facts = key_facts(key_groups(df, [F.col(c) for c in key.columns]), len(key.columns))
    return facts.select(
        F.lit(key.table).alias("table"),
        F.lit(key.name).alias("key"),
        "n_rows",
        "n_dup",
        "n_null",
        key_holds(F.lit(key.primary_key), F.lit(key.unique)).alias("holds"),
    )


def audit_keys(tables: Mapping[str, DataFrame], keys: Iterable[Key]) -> DataFrame:
    """Rows, surplus rows and incomplete rows per declared key. A primary key must also be complete."""
    return union_all(_audit_key(tables[key.table], key) for key in keys)


def _audit_relationship(child: DataFrame, parent: DataFrame, rel: Relationship) -> DataFrame:
    # The child is reduced to its distinct references with their counts first: the join then sees each
    # reference once, however many rows share it, and needs no further exchange of the child.
    names = [f"_k{i}" for i in range(len(rel.from_columns))]
    references = child.groupBy(*[F.col(c).alias(n) for c, n in zip(rel.from_columns, names)]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    complete = references.where(~_any_null(names))
    parents = parent.select(*[F.col(c).alias(n) for c, n in zip(rel.to_columns, names)])
    orphans = complete.join(parents, names, "left_anti").agg(F.sum("_n").alias("n_orphan"))
    children = child.agg(F.count(F.lit(1)).alias("n_child"))
    n_orphan = F.coalesce(F.col("n_orphan"), F.lit(0))
    return orphans.select(
        F.lit(rel.name).alias("name"),
        children.scalar().alias("n_child"),
        n_orphan.alias("n_orphan"),
        (n_orphan == 0).alias("holds"),
    )


def audit_relationships(tables: Mapping[str, DataFrame], rels: Iterable[Relationship]) -> DataFrame:
    """Child rows and child rows without a parent, per declared relationship.

    Children with an incomplete reference refer to nothing and are no orphans. Whether the parent side is
    broadcast is left to its size.
    """
    return union_all(
        _audit_relationship(tables[rel.from_table], tables[rel.to_table], rel) for rel in rels
    )


def linked_tables(
    inventory: DataFrame, properties: DataFrame | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Tables that live in another file; ``properties`` adds a ``properties`` map by table name."""
    listing = inventory.where("linked").select(*keys, "name", F.lit("linked").alias("type"))
    if properties is None:
        return listing.withColumn("properties", F.create_map().cast("map<string,string>"))
    return listing.join(properties.select(*keys, "name", "properties"), [*keys, "name"], "left")


def system_objects(inventory: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The system tables among the listed ones."""
    return inventory.where("system_object").select(*keys, "name", F.lit("table").alias("type"))


def property_rows(props: DataFrame, ordered: bool = False) -> DataFrame:
    """Property maps as rows, values normalised.

    ``ordered`` sorts them by source, scope and key; the value breaks ties, so one source can fill several
    sorted partitions.
    """
    rows = (
        normalize_values(props.select("source", "scope", "props"))
        .select("source", "scope", F.explode_outer("props").alias("key", "value"))
        .where(F.col("key").isNotNull())
    )
    return rows.orderBy("source", "scope", "key", "value") if ordered else rows
