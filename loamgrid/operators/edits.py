"""Calculated fields, edits and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def calculate(df: DataFrame, field: str, expression: Column) -> DataFrame:
    """Create or overwrite a field on every row, whatever filter the layer shows."""
    return df.withColumn(field, expression)


def add_field(df: DataFrame, field: str, default) -> DataFrame:
    """Fill a field only where it is absent."""
    value = default if isinstance(default, Column) else F.lit(default)
    if field in df.columns:
        return df.withColumn(field, F.coalesce(F.col(f"`{field}`"), value))
    return df.withColumn(field, value)


def union_layers(*layers: DataFrame) -> DataFrame:
    """Union of layers with differing fields; missing fields are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def field_union(*layers: DataFrame) -> list[str]:
    """Sorted union of field names."""
    return sorted({c for df in layers for c in df.columns})


def merge_edits(base: DataFrame, edits: DataFrame, visible: DataFrame, id_col: str = "id") -> DataFrame:
    """Hidden rows stay; visible rows are replaced by their edit, or deleted without one; new ids are added.

    ``edits`` has the columns of ``base`` and unique ids; ``visible`` is a table
    of ids.  An edit of a hidden row is appended next to it, as a new feature is.
    """
    shown = visible.select(id_col).distinct()
    hidden = base.join(shown, id_col, "left_anti")
    return hidden.unionByName(edits.select(*base.columns))


def update_cells(base: DataFrame, updates: DataFrame, id_col: str = "id") -> DataFrame:
    """Overwrite cells by id; ``updates`` has the id and the new values (null keeps the old one)."""
    changed = [c for c in updates.columns if c != id_col]
    new = updates.select(id_col, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = base.join(new, id_col, "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns]
    )


def delete_rows(base: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """U04."""
    return base.join(ids.select(id_col).distinct(), id_col, "left_anti")
