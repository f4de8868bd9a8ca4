"""Exact duplicates, one kept row per group, and the space that frees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators.components import connected_groups
from framesift.operators.keys import filter_by_keys
from framesift.operators.near_duplicates import equal_members, near_duplicate_links
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join
from framesift.session import cut_lineage


def content_digest(content: Column) -> Column:
    """SHA-256 of the bytes, as 64 hex digits."""
    return F.sha2(content, 256)


def exact_duplicate_groups(images: DataFrame, key: str, content: Column, size: Column) -> DataFrame:
    """One row per content that occurs more than once: digest, copies, first key, bytes to save.

    A NULL content (a file that could not be read) is like no other.
    """
    return (
        images.select(F.col(key).alias("key"), content_digest(content).alias("digest"), size.alias("size"))
        .filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.count("*").alias("copies"),
            F.min("key").alias("first_key"),
            (F.sum("size") - F.max("size")).alias("redundant_bytes"),
        )
        .filter("copies > 1")
    )


def exact_duplicate_members(
    images: DataFrame, key: str, content: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(key, group_id) for every row whose content occurs more than once; group id is the lowest key.

    The content is read once, and only key and digest are shuffled; see
    `equal_members` for contents that are very frequent.
    """
    hashed = images.select(F.col(key).alias("key"), F.unhex(content_digest(content)).alias("digest"))
    return equal_members(hashed, "digest", hot_rows).select("key", F.col("root").alias("group_id"))


def near_duplicate_groups(
    table: DataFrame, key: str, vector: str, threshold: float, dim: int | None = None, **options: int
) -> DataFrame:
    """(key, group_id): rows joined by chains of vectors at least ``threshold`` alike."""
    return connected_groups(near_duplicate_links(table, key, vector, threshold, dim, **options))


def keep_one(
    members: DataFrame,
    prefer: Sequence[Column | str] = (),
    descending: Sequence[bool] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``keep_key`` and ``kept``: one row stays per group.

    ``members`` has (key, group_id) and whatever ``prefer`` reads, and is best
    kept to that, as it is written out once. The first
    preference decides, then the next, then the lowest key; ``descending`` marks
    numeric preferences where larger is better. Unknown values come last. The winner is the minimum of an
    ordering struct, which combines on the map side: no task sorts a group.
    """
    flags = list(descending) or [False] * len(prefer)
    values = [F.col(column) if isinstance(column, str) else column for column in prefer]
    order = F.struct(
        *(
            part
            for n, (value, down) in enumerate(zip(values, flags))
            for part in (value.isNull().alias(f"unknown{n}"), (-value if down else value).alias(f"p{n}"))
        ),
        F.col("key"),
    )
    members = cut_lineage(members)
    winners = members.groupBy("group_id").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    winners = cut_lineage(winners.select("group_id", F.col("best.key").alias("keep_key"), "n"))
    hot = hot_keys(winners, ["group_id"], hot_rows)
    joined = salted_join(members, winners.drop("n"), ["group_id"], hot, F.col("key"))
    return joined.withColumn("kept", F.col("key") == F.col("keep_key"))


def savings_report(decided: DataFrame, folder: str = "folder", size: str = "size_bytes") -> DataFrame:
    """Per folder: rows in groups, rows dropped, and the bytes that frees."""
    dropped = ~F.col("kept")
    return decided.groupBy(folder).agg(
        F.count("*").alias("grouped_files"),
        F.sum(dropped.cast("long")).alias("dropped_files"),
        F.sum(F.when(dropped, F.col(size)).otherwise(0)).alias("saved_bytes"),
    )


def without_dropped(images: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """The table after clean-up: every row except the dropped ones."""
    dropped = decided.filter(~F.col("kept")).select(F.col("key").alias(key))
    return filter_by_keys(images, dropped, key, keep=False)
