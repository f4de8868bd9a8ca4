"""Tables in and out: scans, writes, replacement, properties, small reads."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framesift.functions.encoding import json_record
from framesift.schemas import PREVIEW_ROWS

log = logging.getLogger(__name__)

#: Rows that `query_to_pandas` brings to the driver unless told otherwise.
PANDAS_ROWS = 100_000

CHANGE_FEED = {"delta.enableChangeDataFeed": "true"}


def table_format(spark: SparkSession) -> str:
    """``delta`` where the session is set up for it, else ``parquet``."""
    return "delta" if "delta" in (spark.conf.get("spark.sql.extensions", "") or "").lower() else "parquet"


def quoted(name: str) -> str:
    """A table name, perhaps with its database, as SQL takes it whatever its letters."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _literal(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rows_to_frame(spark: SparkSession, rows: Sequence[Any] | pd.DataFrame, schema: T.StructType | str) -> DataFrame:
    """Local rows with a declared schema; an empty list gives an empty typed table."""
    return spark.createDataFrame(rows, schema)


def save_table(df: DataFrame, name: str, fmt: str | None = None) -> DataFrame:
    """Overwrite a managed table. For a table that ``df`` itself reads, use `replace_table`."""
    df.write.format(fmt or table_format(df.sparkSession)).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def create_table(
    df: DataFrame, name: str, fmt: str | None = None, options: Mapping[str, str] | None = None
) -> DataFrame:
    """Create a table and fail if it is there already; ``options`` such as `CHANGE_FEED`."""
    writer = df.write.format(fmt or table_format(df.sparkSession)).mode("errorifexists")
    writer.options(**dict(options or {})).saveAsTable(name)
    return df.sparkSession.table(name)


def replace_table(df: DataFrame, name: str, fmt: str | None = None) -> DataFrame:
    """Overwrite a table whose old rows ``df`` may read: write beside it, then swap names.

    The old table is moved aside before the new one takes its name, and dropped
    last. Stopped before the swap, the old table is untouched; stopped within
    it, `recover_table` brings the old one back.
    """
    spark = df.sparkSession
    staged = f"{name}__next"
    df.write.format(fmt or table_format(spark)).mode("overwrite").saveAsTable(staged)
    return replace_by(spark, staged, name)


def replace_by(spark: SparkSession, staged: str, name: str) -> DataFrame:
    """Give the table ``staged`` the name of another one, which is dropped; see `replace_table`."""
    aside = f"{name}__old"
    if spark.catalog.tableExists(name):
        drop_table(spark, aside)
        spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(aside)}")
    spark.sql(f"ALTER TABLE {quoted(staged)} RENAME TO {quoted(name)}")
    drop_table(spark, aside)
    return spark.table(name)


def recover_table(spark: SparkSession, name: str) -> bool:
    """Whether the table exists, after bringing it back if `replace_table` stopped within its swap."""
    if spark.catalog.tableExists(name):
        return True
    if not spark.catalog.tableExists(f"{name}__old"):
        return False
    spark.sql(f"ALTER TABLE {quoted(name + '__old')} RENAME TO {quoted(name)}")
    return True


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def set_properties(spark: SparkSession, name: str, properties: Mapping[str, str]) -> bool:
    """Set table properties; a table that refuses them is reported, not fatal."""
    listed = ", ".join(f"{_literal(key)} = {_literal(value)}" for key, value in properties.items())
    try:
        spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({listed})")
        return True
    except (AnalysisException, ParseException) as error:
        log.warning("properties of %s not set: %s", name, error)
        return False


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(n)


def query_to_pandas(
    spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, most_rows: int = PANDAS_ROWS
) -> pd.DataFrame:
    """Result of a small query. Values go in as bound parameters, never spliced into the text.

    A result of more than ``most_rows`` rows is an error; it is not cut.
    """
    result = spark.sql(sql, args=dict(args or {})).limit(most_rows + 1).toPandas()
    if len(result) > most_rows:
        raise ValueError(f"the query has more than {most_rows} rows; aggregate it or raise most_rows")
    return result


def as_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """One JSON record per row, the request body of a model service."""
    return df.select(json_record(df.columns).alias(column))


def row_count(df: DataFrame) -> int:
    return df.count()
