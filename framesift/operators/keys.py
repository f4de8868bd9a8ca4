"""Choosing rows of a wide table by a list of keys, without shuffling the wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.session import cut_lineage

#: Bytes of keys sent to every task, at most.
KEY_BYTES = 32 * 1024 * 1024

#: What a key costs in a hash table beside its own bytes.
KEY_OVERHEAD = 64


def fits_broadcast(keys: DataFrame, key: str, limit: int = KEY_BYTES) -> bool:
    """Whether the keys, as measured, stay within ``limit`` bytes."""
    size = keys.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes")
    ).first()
    return size.bytes + KEY_OVERHEAD * size.n <= limit


def filter_by_keys(rows: DataFrame, keys: DataFrame, key: str, keep: bool, limit: int = KEY_BYTES) -> DataFrame:
    """Rows whose key is among ``keys`` (``keep``) or is not.

    The keys are written out once and measured. Few keys go to every task and
    the rows stay where they are; more keys meet the rows in a shuffled join.
    """
    listed = cut_lineage(keys.select(key))
    if fits_broadcast(listed, key, limit):
        listed = F.broadcast(listed)
    return rows.join(listed, key, "left_semi" if keep else "left_anti")
