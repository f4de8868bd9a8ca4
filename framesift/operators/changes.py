"""What changed between two snapshots of a table, and bringing an index up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.encoding import json_record
from framesift.operators.keys import filter_by_keys


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """Digest of the named columns; NULL and "" differ, and it is never NULL itself."""
    parts = []
    for name in columns:
        plain = df.schema[name].dataType.typeName() in ("string", "binary")
        value = F.col(name) if plain else F.when(F.col(name).isNotNull(), json_record([name]))
        parts.append(F.coalesce(F.sha2(value, 256), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change) with change in insert, update, delete; unchanged rows are absent.

    Compares values, so a table that was rewritten as a whole shows only its
    real changes. Keys are unique; only key and digest are shuffled.
    """
    before = old.select(key, row_digest(old, columns).alias("_before"))
    after = new.select(key, row_digest(new, columns).alias("_after"))
    change = (
        F.when(F.col("_before").isNull(), "insert")
        .when(F.col("_after").isNull(), "delete")
        .when(F.col("_before") != F.col("_after"), "update")
    )
    return before.join(after, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def rows_to_write(new: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the new snapshot that were inserted or updated: what has to be embedded again."""
    touched = changes.filter(F.col("change") != "delete")
    return filter_by_keys(new, touched, key, keep=True)


def apply_changes(index: DataFrame, fresh: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The index after the changes: untouched rows plus ``fresh`` rows, same columns.

    ``fresh`` holds the index rows of `rows_to_write`.
    """
    untouched = filter_by_keys(index, changes, key, keep=False)
    return untouched.unionByName(fresh.select(*index.columns))
