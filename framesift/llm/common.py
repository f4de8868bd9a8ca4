"""Row keys and written tables shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.session import new_shared_path

#: Column that tells rows apart, whatever the ids hold.
ROW = "__row"

#: The white space that the operators' definitions name.
SPACE = "\\x20\\x09-\\x0D"


#: Rows of whole texts handed to Python at a time. Spark's own number is meant
#: for narrow rows; of pages or documents it makes batches of tens of megabytes,
#: which a task holds several times over.
TEXT_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Have this session hand rows to Python in batches of at most `TEXT_ROWS`."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    The plan behind it is evaluated once, and a lost executor costs none of it.
    The folder is deleted when the application ends, unless `drop_written` did.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(table: DataFrame) -> None:
    """Delete the files of a table of `write_shared` that nothing reads any more."""
    spark = table.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` and a `ROW` column, a long that no two rows share and that is in the order of the ids.

    Where the ids are whole numbers, all present and distinct, they are the
    key. Otherwise (null or repeated ids, or ids of another type) the table is
    sorted by id, null ids last, rows of one id by a hash of all their columns,
    and written out with numbers in that order, which stay the same for every
    later read; rows alike in everything may change places. A frame that has
    the column already, from an earlier call, is returned as it is.
    """
    if ROW in df.columns:
        return df
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        counted = df.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        if counted.filter("id IS NULL OR n > 1").isEmpty():
            return df.withColumn(ROW, F.col(id_col).cast("long"))
    # A sort deals ranges to partitions in order, and these numbers grow with the partition and the row in it.
    whole = F.xxhash64(*(F.col(c) for c, kind in df.dtypes if not kind.startswith("map")))
    ordered = df.withColumn("__whole", whole).orderBy(F.col(id_col).asc_nulls_last(), "__whole").drop("__whole")
    return write_shared(ordered.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keyed(df: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """Only the `ROW` key, the id as ``_id`` and ``columns`` under their internal names."""
    rows = with_row_key(df.select(*{id_col, *columns.values(), *({ROW} & set(df.columns))}), id_col)
    return rows.select(ROW, F.col(id_col).alias("_id"), *(F.col(c).alias(name) for name, c in columns.items()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Pieces that the rows of one group are dealt to by their partition before the last choice is made.
PIECES = 64


def best_rows(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group by ``order``, numbered from 1 in an int column ``rank``.

    Spark keeps k rows of a group per task before it shuffles. The choice is
    made in pieces first, so that a group met in every task of a large job
    does not bring all their rows to one.
    """
    piece = F.pmod(F.spark_partition_id(), F.lit(PIECES))
    first = Window.partitionBy(*group, "__piece").orderBy(*order)
    some = rows.withColumn("__piece", piece).withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= k)
    whole = Window.partitionBy(*group).orderBy(*order)
    return some.drop("__piece").withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)
