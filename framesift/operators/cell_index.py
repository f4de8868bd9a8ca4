"""An index laid out in cells, so that a search reads only the partitions that can matter.

Every vector lies in the cell of its nearest centre, and a cell is a partition
of the table. Beside it a small table says of each cell where its centre is,
how wide it is and how long its vectors are. From these a search bounds the
scores that a cell can hold, reads the most promising cells first and then
those whose bound reaches the kth score found: the result is that of a search
over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.filters import Filters
from framesift.functions.vectors import as_vector, check_metric, to_matrix, unit_rows
from framesift.operators import blocks as B
from framesift.operators.search import search
from framesift.session import cut_lineage

CELL = "cell"

#: Rows of a cell wished for, rows of one file, and rows per cell that the centres are moved by.
CELL_ROWS, FILE_ROWS, SAMPLE_ROWS = 65536, 262144, 64

#: Times the centres are moved to the mean of their sample.
MOVES = 8

#: Slack of a bound, larger than the rounding of scores and angles.
SLACK = 2e-6


def _centres(vectors: DataFrame, count: int, n_rows: int) -> np.ndarray:
    """Unit centres, from about `SAMPLE_ROWS` rows a cell: rows in hash order, moved by spherical k-means.

    The sample is bounded by what may be broadcast. It decides how well
    searches prune, not what they find.
    """
    dim = len(vectors.select("vec").first()[0])
    wanted = min(count * SAMPLE_ROWS, B.rows_within_budget(dim))
    sample = unit_rows(B.choose_pivots(vectors, wanted, n_rows)[1])
    centres = sample[:count]
    for _ in range(MOVES):
        home = np.concatenate([(sample[part] @ centres.T).argmax(axis=1) for part in B.row_steps(len(sample), len(centres))])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1.0), centres)
    return centres


def write_cell_index(
    rows: DataFrame, path: str, key: str, vector: str, cells: int | None = None, file_rows: int = FILE_ROWS
) -> None:
    """Write index rows (see `index_rows`; all vectors of one length) in cells below ``path``.

    A cell with very many rows is several files, written by several tasks.
    ``cells`` is how many are wished for; the centres are bounded by what may
    be sent to every task.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col(key).alias("key"), as_vector(F.col(vector)).alias("vec"))
    n_rows = vectors.count()
    if not n_rows:
        raise ValueError("no rows to index")
    dim = len(vectors.select("vec").first()[0])
    count = min(cells or math.ceil(n_rows / CELL_ROWS), B.rows_within_budget(dim), n_rows)
    shared = spark.sparkContext.broadcast(_centres(vectors, count, n_rows))

    def place(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], pa.struct([("cell", pa.int32()), ("angle", pa.float64()), ("length", pa.float64())]))
        raw = to_matrix(column)
        matrix, centres = unit_rows(raw), shared.value
        home, angle = [], []
        for part in B.row_steps(len(matrix), len(centres)):
            scores = matrix[part] @ centres.T
            best = scores.argmax(axis=1)
            home.append(best.astype(np.int32))
            angle.append(np.arccos(np.clip(scores[np.arange(len(best)), best], -1.0, 1.0)))
        parts = [pa.array(np.concatenate(home)), pa.array(np.concatenate(angle)), pa.array(np.linalg.norm(raw, axis=1))]
        return pa.StructArray.from_arrays(parts, names=["cell", "angle", "length"])

    where = F.arrow_udf(place, "struct<cell:int,angle:double,length:double>").asNondeterministic()
    placed = cut_lineage(vectors.withColumn("place", where(F.col("vec"))).select("key", "place.*"))
    sizes = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("angle").alias("widest"), F.min("length").alias("shortest"), F.max("length").alias("longest")
    )
    listed = {r.cell: r for r in sizes.collect()}  # a row per centre
    described = [(c, r.n, r.widest, r.shortest, r.longest, shared.value[c].tolist()) for c, r in sorted(listed.items())]
    schema = "cell int, n long, widest double, shortest double, longest double, centre array<double>"
    table = spark.createDataFrame(described, schema)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    pieces = F.broadcast(table.select("cell", F.ceil(F.col("n") / file_rows).alias("_pieces")))
    homes = placed.select(F.col("key").alias(key), "cell").join(pieces, "cell")
    dealt = rows.join(homes, key).withColumn("_piece", F.pmod(F.xxhash64(key), F.col("_pieces")))
    files = sum(math.ceil(r.n / file_rows) for r in listed.values())
    ordered = dealt.repartition(max(1, min(files, 100_000)), "cell", "_piece").drop("_pieces", "_piece").sortWithinPartitions("cell")
    ordered.write.mode("overwrite").partitionBy(CELL).parquet(f"{path}/rows")


@dataclass
class CellIndex:
    """A stored index: its rows and, on the driver, a line for each cell."""

    rows: DataFrame
    numbers: np.ndarray
    counts: np.ndarray
    widest: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    centres: np.ndarray


def read_cell_index(spark: SparkSession, path: str) -> CellIndex:
    listed = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # bounded by the broadcast budget
    column = {name: np.array([r[name] for r in listed]) for name in ("cell", "n", "widest", "shortest", "longest", "centre")}
    rows = spark.read.parquet(f"{path}/rows")
    return CellIndex(rows, column["cell"], column["n"], column["widest"], column["shortest"], column["longest"], column["centre"])


def cell_bounds(index: CellIndex, query: Sequence[float], metric: str) -> np.ndarray:
    """The best score any row of each cell can have, larger being better (L2 is negated).

    A row of a cell is no nearer to the query's direction than the centre's
    angle less the cell's width, and no shorter or longer than its cell says.
    """
    target = np.asarray(query, dtype=np.float64)
    length = float(np.linalg.norm(target))
    toward = np.arccos(np.clip(index.centres @ (target / length), -1.0, 1.0)) if length else np.zeros(len(index.numbers))
    cosine = np.cos(np.maximum(toward - index.widest - SLACK, 0.0))
    if metric == "cosine":
        return cosine + SLACK
    if metric == "dot":
        far = np.where(cosine > 0, index.longest, index.shortest)
        return length * far * cosine + SLACK * (1.0 + length * index.longest)
    nearest = np.clip(length * cosine, index.shortest, index.longest)
    squares = length**2 + nearest**2 - 2.0 * length * nearest * cosine
    slack = SLACK * (1.0 + length + index.longest)
    return -np.sqrt(np.maximum(squares - slack * (length + index.longest), 0.0)) + slack


def cells_to_read(
    index: CellIndex,
    query: Sequence[float],
    k: int,
    key: str,
    vector: str = "embeddings",
    filters: Filters = None,
    metric: str = "cosine",
    probes: int | None = None,
) -> list[int]:
    """The cells that hold the ``k`` best rows: all whose bound reaches the kth score of the cells read so far.

    Cells are tried in the order of their bounds, twice as many each time, so a
    filter that few rows pass takes a few rounds more. Only keys and vectors
    are read here. With ``probes`` it is the first so many, which is not exact.
    """
    bounds = cell_bounds(index, query, metric)
    order = np.argsort(-bounds, kind="stable")
    if probes is not None:
        return index.numbers[order[:probes]].tolist()
    best: list[float] = []
    done, step = 0, max(1, int(np.searchsorted(np.cumsum(index.counts[order]), k)) + 1)
    while done < len(order):
        ahead = order[done : done + step]
        if len(best) >= k:
            ahead = ahead[bounds[ahead] >= best[k - 1]]
        if not len(ahead):
            break
        some = index.rows.filter(F.col(CELL).isin(index.numbers[ahead].tolist()))
        found = search(some, query, k, key, vector, [key], filters, metric).select("score").collect()  # k rows
        best = sorted(best + [-r.score if metric == "l2" else r.score for r in found], reverse=True)[:k]
        done, step = done + step, 2 * step
    if len(best) >= k:
        order = order[bounds[order] >= best[k - 1]]
    return index.numbers[order].tolist()


def search_cells(
    index: CellIndex,
    query: Sequence[float],
    k: int,
    key: str,
    vector: str = "embeddings",
    columns: Sequence[str] | None = None,
    filters: Filters = None,
    metric: str = "cosine",
    probes: int | None = None,
) -> DataFrame:
    """`search` over the cells that can matter: the same rows, from fewer partitions.

    With ``probes`` only the so many most promising cells are read, and a row
    of another one may be missed.
    """
    check_metric(metric)
    if len(query) == 0:
        raise ValueError("empty query vector")
    cells = cells_to_read(index, query, k, key, vector, filters, metric, probes)
    rows = index.rows.filter(F.col(CELL).isin(cells))
    return search(rows, query, k, key, vector, columns, filters, metric)
