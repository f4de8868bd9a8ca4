"""Joins onto groups whose sizes are badly uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key a task may take beside its fair share. A key with more is
#: hot and is cut into pieces of about this size.
HOT_ROWS = 1_000_000


def hot_keys(sizes: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> list[Row]:
    """Keys with more than ``hot_rows`` rows, and the ``pieces`` to cut them into.

    ``sizes`` has the keys and their rows ``n``. There can be no more hot keys
    than total rows / ``hot_rows``, so the list is short whatever the skew.
    """
    pieces = F.ceil(F.col("n") / hot_rows).cast("int").alias("pieces")
    return sizes.filter(F.col("n") > hot_rows).select(*on, pieces).collect()


def salted_join(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    hot: Sequence[Row],
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to one-row-per-key ``groups`` without sending a hot key to one task.

    Rows of a key in ``hot`` are spread over its pieces by the hash of
    ``spread`` and its group row is repeated once per piece; all other keys are
    joined as they are. Without hot keys this is an ordinary join. ``how`` is
    inner or left.
    """
    if not hot:
        return rows.join(groups, [*on], how)
    schema = groups.select(*on).schema.add("_pieces", T.IntegerType())
    listed = F.broadcast(rows.sparkSession.createDataFrame([tuple(key) for key in hot], schema))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    salted = rows.join(listed, [*on], "left").withColumn("_salt", F.pmod(F.xxhash64(spread), pieces).cast("int"))
    repeated = groups.join(listed, [*on], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), pieces - F.lit(1)))
    )
    return salted.drop("_pieces").join(repeated.drop("_pieces"), [*on, "_salt"], how).drop("_salt")
