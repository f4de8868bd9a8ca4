"""Tables that keep a log of what each write changed.

Beside the table `name` are kept `name__changes`, the log, a row per changed
key and version, and the digests of the rows of the last version. A write
compares the digests of its own rows with those, so the old rows are not read.
The log's table says in a property which version is the last; what a stopped
write has left behind is beyond it, and the next write replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators.changes import row_digest
from framesift.operators.keys import filter_by_keys
from framesift.sources import tables

VERSION = "framesift.version"


def _feed(name: str) -> str:
    return f"{name}__changes"


def _digests(name: str, version: int) -> str:
    return f"{name}__digests_{version}"


def logged_version(spark: SparkSession, name: str) -> int:
    """Number of the last finished write of `write_logged`; 0 before the first."""
    if not spark.catalog.tableExists(_feed(name)):
        return 0
    shown = spark.sql(f"SHOW TBLPROPERTIES {tables.quoted(_feed(name))}").filter(F.col("key") == VERSION).first()
    return int(shown["value"]) if shown else 0


def write_logged(df: DataFrame, name: str, key: str, columns: Sequence[str] | None = None, fmt: str | None = None) -> int:
    """Replace the table by ``df`` and log its inserts, updates and deletes; returns the version.

    Keys are unique. An update is a change in one of ``columns``, all but the
    key unless named, and the same at every write. The first version logs every row as an insert. ``df`` may
    read the table itself and is evaluated once. Readers of the log see the
    version when the table holds it; stopped before that, a write has changed
    nothing that they see, and is to be repeated.
    """
    spark = df.sparkSession
    fmt = fmt or tables.table_format(spark)
    last = logged_version(spark, name)
    version, staged = last + 1, f"{name}__staged"
    df.write.format(fmt).mode("overwrite").saveAsTable(staged)
    new = spark.table(staged)
    compared = list(columns) if columns is not None else [c for c in df.columns if c != key]
    after = new.select(F.col(key).alias("key"), row_digest(new, compared).alias("digest"))
    after.write.format(fmt).mode("overwrite").saveAsTable(_digests(name, version))

    after = spark.table(_digests(name, version)).withColumnRenamed("digest", "_after")
    if last:
        before = spark.table(_digests(name, last)).withColumnRenamed("digest", "_before")
        both = before.join(after, "key", "full")
    else:
        both = after.withColumn("_before", F.lit(None).cast("binary"))
    change = (
        F.when(F.col("_before").isNull(), "insert")
        .when(F.col("_after").isNull(), "delete")
        .when(F.col("_before") != F.col("_after"), "update")
    )
    changed = both.select(F.col("key").alias(key), change.alias("change"), F.lit(version).alias("version")).filter("change IS NOT NULL")
    feed = tables.quoted(_feed(name))
    if spark.catalog.tableExists(_feed(name)):
        if fmt == "parquet":
            spark.sql(f"ALTER TABLE {feed} DROP IF EXISTS PARTITION (version = {version})")  # of a write that was stopped
        else:
            spark.sql(f"DELETE FROM {feed} WHERE version = {version}")
        changed.write.format(fmt).mode("append").partitionBy("version").saveAsTable(_feed(name))
    else:
        changed.write.format(fmt).partitionBy("version").saveAsTable(_feed(name))
    tables.replace_by(spark, staged, name)
    spark.sql(f"ALTER TABLE {feed} SET TBLPROPERTIES ('{VERSION}' = '{version}')")
    if last:
        tables.drop_table(spark, _digests(name, last))
    return version


def changes_since(spark: SparkSession, name: str, key: str, version: int) -> DataFrame:
    """(key, change) between ``version`` and the last one: what all writes in between come to.

    Only the log's later partitions are read. A key that came and went is absent.
    """
    seen = spark.table(_feed(name)).filter((F.col("version") > version) & (F.col("version") <= logged_version(spark, name)))
    ends = seen.groupBy(key).agg(F.min_by("change", "version").alias("first"), F.max_by("change", "version").alias("last"))
    change = (
        F.when((F.col("first") == "insert") & (F.col("last") != "delete"), "insert")
        .when((F.col("first") != "insert") & (F.col("last") == "delete"), "delete")
        .when((F.col("first") != "insert") & (F.col("last") != "delete"), "update")
    )
    return ends.select(key, change.alias("change")).filter("change IS NOT NULL")


def rows_since(spark: SparkSession, name: str, key: str, version: int) -> DataFrame:
    """The table's rows that were inserted or updated after ``version``: what an index has to take in."""
    touched = changes_since(spark, name, key, version).filter("change != 'delete'")
    return filter_by_keys(spark.table(name), touched, key, keep=True)


def drop_logged(spark: SparkSession, name: str) -> None:
    """Drop the table with its log and digests."""
    last = logged_version(spark, name)
    for table in (name, f"{name}__staged", _feed(name), *(_digests(name, v) for v in range(max(1, last - 1), last + 2))):
        tables.drop_table(spark, table)
