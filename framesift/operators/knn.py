"""Nearest neighbours of many queries at once, exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.functions.vectors import (
    check_metric,
    closeness,
    distances,
    rounded,
    searchable_vectors,
    square_error,
    to_matrix,
    unit_rows,
)
from framesift.operators import blocks as B
from framesift.session import cut_lineage

#: Slack for the rounding of scores when a bound decides whether a cell is visited.
BOUND_SLACK = 2e-6


#: Tasks per core that search vectors against broadcast queries, at most. Each returns k rows a query.
TASKS_PER_CORE = 8

#: Groups of tasks up to which their results are merged in one step.
MERGE_AT_ONCE = 16


def best_per_query(queries: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best entries of each query; equal scores go by key."""
    _, key_rank = np.unique(keys, return_inverse=True)
    order = np.lexsort((key_rank, -scores, queries))
    sorted_queries = queries[order]
    starts = np.searchsorted(sorted_queries, sorted_queries, side="left")
    return order[np.arange(len(order)) - starts < k]


def _candidates(
    queries: np.ndarray, keys: np.ndarray, matrix: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows of every query; equal scores go by key.

    Never more than ``k`` entries a query, even where all rows are copies.
    """
    if metric == "cosine":
        queries, matrix, metric = unit_rows(queries), unit_rows(matrix), "dot"
    by_key = np.argsort(keys, kind="stable")
    matrix = matrix[by_key]
    if metric == "l2":
        return _nearest_by_distance(queries, matrix, by_key, k)
    found = []
    for part in B.row_steps(len(queries), len(matrix)):
        scores = rounded(closeness(queries[part], matrix, metric))
        if scores.shape[1] > k:
            kth = np.partition(scores, -k, axis=1)[:, -k, None]
            chosen = scores >= kth
            crowded = np.flatnonzero(chosen.sum(axis=1) > k)
            if len(crowded):
                level = scores[crowded] == kth[crowded]
                room = k - (scores[crowded] > kth[crowded]).sum(axis=1, keepdims=True)
                chosen[crowded] &= ~level | (np.cumsum(level, axis=1) <= room)
        else:
            chosen = np.ones(scores.shape, dtype=bool)
        query, row = np.nonzero(chosen)
        found.append((query + part.start, by_key[row], scores[query, row]))
    return tuple(np.concatenate(column) for column in zip(*found))


def _nearest_by_distance(
    queries: np.ndarray, matrix: np.ndarray, by_key: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_candidates` for L2: squares by one product choose rows, with room for its error, differences decide."""
    found = []
    for part in B.row_steps(len(queries), len(matrix)):
        asked = queries[part]
        squares = (asked**2).sum(axis=1)[:, None] + (matrix**2).sum(axis=1)[None, :] - 2.0 * (asked @ matrix.T)
        if squares.shape[1] > k:
            error = square_error(asked, matrix)
            kth = np.maximum(np.partition(squares, k - 1, axis=1)[:, k - 1], 0.0)
            limit = (np.sqrt(kth + error) + BOUND_SLACK) ** 2 + error
            query, row = np.nonzero(squares <= limit[:, None])
        else:
            query, row = np.nonzero(np.ones(squares.shape, dtype=bool))
        step = max(1, B.MATRIX_ENTRIES // max(1, matrix.shape[1]))
        score = [distances(asked[query[at : at + step]], matrix[row[at : at + step]]) for at in range(0, len(query), step)]
        score = rounded(-np.concatenate(score)) if score else np.empty(0)
        best = best_per_query(query, row, score, k)  # rows are in key order, so ties go by key
        found.append((query[best] + part.start, by_key[row[best]], score[best]))
    return tuple(np.concatenate(column) for column in zip(*found))


def _as_array(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _rank(scored: DataFrame, k: int, metric: str, exclude_self: bool, groups: int = 1) -> DataFrame:
    """Ranks of each query's best. With ``groups`` the tasks' results are merged in two steps.

    Each task hands over k rows per query; with very many tasks, first groups
    of them are merged, so that no query's rows meet in one place at once.
    """
    if exclude_self:
        scored = scored.filter(F.col("query_key") != F.col("key"))
    if groups > 1:
        scored = scored.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        within = Window.partitionBy("query_key", "_group").orderBy(F.desc("score"), "key")
        scored = scored.withColumn("_place", F.row_number().over(within)).filter(F.col("_place") <= k).drop("_place", "_group")
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "key")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.abs("score")) if metric == "l2" else ranked


def knn_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "cosine",
    exclude_self: bool = False,
    dim: int | None = None,
    block_rows: int = B.BLOCK_ROWS,
    max_broadcast_bytes: int = B.BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` nearest ``vectors`` of every row of ``queries``.

    Both inputs have columns (key, vec) with unique keys. As in an index, rows
    whose vector is NULL, zero, of another length or has NULL, NaN or infinity
    inside neither ask nor are found. Returns (query_key, key, score, rank); score is the distance
    for "l2". Few queries, as measured, are sent to every task: one pass over
    the vectors that never shuffles them and leaves ``k`` rows per query and
    task. More queries go through `_knn_by_cells`, which is just as exact.
    """
    check_metric(metric)
    wanted = k + 1 if exclude_self else k
    if dim is None:
        first = queries.filter("vec IS NOT NULL").select(F.size("vec").alias("dim")).first()
        dim = first.dim if first else 1
    # the queries are used more than once, so they are written out; a model behind them runs once
    queries = cut_lineage(searchable_vectors(queries.select("key", "vec"), "vec", dim).select("key", "vec"))
    vectors = searchable_vectors(vectors.select("key", "vec"), "vec", dim).select("key", "vec")
    limit = B.rows_within_budget(dim, max_broadcast_bytes)
    asked = queries.count()
    if asked == 0:
        return _rank(_empty(queries, vectors), k, metric, exclude_self)
    if asked <= limit:
        tasks = search_tasks(vectors.sparkSession)
        # a task reads several partitions one after the other and merges their results before any row is shuffled
        scored = _knn_by_broadcast(queries, vectors.coalesce(tasks), wanted, metric)
        groups = math.ceil(math.sqrt(tasks))
        return _rank(scored, k, metric, exclude_self, groups if groups > MERGE_AT_ONCE else 1)
    scored = _knn_by_cells(queries, cut_lineage(vectors), wanted, metric, dim, block_rows)
    return _rank(scored, k, metric, exclude_self)


def search_tasks(spark: SparkSession) -> int:
    """How many tasks may return rows: by the cores or the shuffle's partitions, not by the size of the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _types(queries: DataFrame, vectors: DataFrame) -> str:
    query_type = queries.schema["key"].dataType.simpleString()
    key_type = vectors.schema["key"].dataType.simpleString()
    return f"query_key {query_type}, key {key_type}, score double"


def _empty(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], _types(queries, vectors))


def _knn_by_broadcast(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    spark = vectors.sparkSession
    schema = _types(queries, vectors)
    probe = queries.toArrow()
    query_keys = probe.column("key").combine_chunks()
    shared = spark.sparkContext.broadcast((query_keys, to_matrix(probe.column("vec"))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_keys, queries = shared.value
        kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        key_arrow = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_arrow = batch.column("key").type
            keys = _as_array(batch.column("key"))
            query, row, score = _candidates(queries, keys, to_matrix(batch.column("vec")), k, metric)
            entries = (query, keys[row], score)
            if kept is not None:
                entries = tuple(np.concatenate(pair) for pair in zip(kept, entries))
            best = best_per_query(*entries, k)
            kept = tuple(column[best] for column in entries)
        if kept is not None:
            yield pa.RecordBatch.from_arrays(
                [query_keys.take(pa.array(kept[0])), pa.array(kept[1], type=key_arrow), pa.array(kept[2])],
                names=["query_key", "key", "score"],
            )

    return vectors.mapInArrow(nearest, schema)


def _knn_by_cells(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str, dim: int, block_rows: int
) -> DataFrame:
    """Exact join through pivots.

    Every vector goes to the cell of its nearest pivot; a cell is known by its
    pivot, radius and row count. By the triangle inequality these bound the
    scores a query can meet in a cell, so a query visits only cells whose best
    possible score reaches the k-th best score it is sure to find. Data
    without structure visits all cells, which are then made fewer, and is
    still compared block by block.
    """
    spark = vectors.sparkSession
    unit = metric == "cosine"
    n_rows = vectors.count()
    _, pivots = B.choose_pivots(vectors, B.cell_count(n_rows, dim, block_rows), n_rows)
    if len(pivots) == 0:
        return _empty(queries, vectors)
    pivots = unit_rows(pivots) if unit else pivots
    asked_rows = queries.count()
    sample = B.sample_rows(queries, asked_rows)
    sample = unit_rows(sample) if unit else sample
    key_type = vectors.schema["key"].dataType.simpleString()
    query_type = queries.schema["key"].dataType.simpleString()

    def homes(batches: Iterator[pa.RecordBatch], shared: Broadcast, with_vectors: bool) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            matrix = to_matrix(batch.column("vec"))
            for part in B.row_steps(len(matrix), len(pivots)):
                rows = unit_rows(matrix[part]) if unit else matrix[part]
                near = closeness(rows, pivots, "l2")
                home = near.argmax(axis=1)
                columns = [pa.array(home.astype(np.int32))]
                names = ["cell"]
                piece = batch.slice(part.start, part.stop - part.start)
                if with_vectors:
                    columns += [pa.array(["v"] * len(home)), piece.column("key"), piece.column("vec")]
                    names += ["role", "key", "vec"]
                else:
                    distance = np.linalg.norm(rows - pivots[home], axis=1)
                    columns.append(pa.array(distance))
                    names.append("distance")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def described(count: int) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The first so many pivots, and their cells: number, rows and radius."""
        shared = spark.sparkContext.broadcast(pivots[:count])
        cells = (
            vectors.select("key", "vec")
            .mapInArrow(lambda batches: homes(batches, shared, False), "cell int, distance double")
            .groupBy("cell")
            .agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
            .orderBy("cell")
            .collect()
        )  # one row per pivot
        return shared, tuple(np.array([row[name] for row in cells]) for name in ("cell", "n", "radius"))

    def visited(matrix: np.ndarray, pivots: np.ndarray, cells: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place of the cell) of the cells that rows have to visit, some rows at a time."""
        cell, count, radius = cells
        pivots = pivots[cell]
        for part in B.row_steps(len(matrix), len(cell)):
            rows = unit_rows(matrix[part]) if unit else matrix[part]
            middle = closeness(rows, pivots, "l2" if metric == "l2" else "dot")
            spread = radius[None, :]
            if metric == "dot":
                spread = spread * np.linalg.norm(rows, axis=1, keepdims=True)
            lowest, highest = middle - spread, middle + spread
            if metric == "l2":  # a small distance by the product is off by up to the root of its square's error
                slack = BOUND_SLACK + np.sqrt(2 * square_error(rows, pivots))
            else:
                slack = BOUND_SLACK + square_error(rows, pivots)
            order = np.argsort(-lowest, axis=1)
            reached = np.cumsum(count[order], axis=1) >= k
            at = np.where(reached.any(axis=1), reached.argmax(axis=1), len(cell) - 1)
            sure = np.take_along_axis(lowest, np.take_along_axis(order, at[:, None], 1), 1)
            query, column = np.nonzero(highest >= sure - 2 * slack[:, None])
            yield query + part.start, column

    tried: dict[int, tuple] = {}

    def mean_visits(count: int) -> float:
        tried.clear()
        tried[count] = described(count)
        found = sum(len(query) for query, _ in visited(sample, pivots[:count], tried[count][1]))
        return found / max(1, len(sample))

    count = B.fewer_cells(len(pivots), B.copies_allowed(asked_rows, dim), mean_visits)
    shared, cells = tried.get(count) or described(count)
    known = spark.sparkContext.broadcast(cells)
    block_rows = B.block_size(max(n_rows, asked_rows), dim, block_rows)
    placed = vectors.select("key", "vec").mapInArrow(
        lambda batches: homes(batches, shared, True), f"cell int, role string, key {key_type}, vec array<float>"
    )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = known.value[0]
        for batch in batches:
            for query, column in visited(to_matrix(batch.column("vec")), shared.value, known.value):
                for some in B.row_steps(len(query), 256):
                    taken = pa.array(query[some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell[column[some]].astype(np.int32)),
                            pa.array(["q"] * len(taken)),
                            batch.column("key").take(taken),
                            batch.column("vec").take(taken),
                        ],
                        names=["cell", "role", "key", "vec"],
                    )

    def visit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = known.value[0]
        counts = np.zeros(len(cell), dtype=np.int64)
        for batch in batches:
            for _, column in visited(to_matrix(batch.column("vec")), shared.value, known.value):
                counts += np.bincount(column, minlength=len(cell))
        some = np.flatnonzero(counts)
        columns = [pa.array(cell[some].astype(np.int32)), pa.array(["q"] * len(some), pa.string()), pa.array(counts[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "role", "n"])

    # Blocks are cut by the hash of the key; keys of both sides may differ in
    # type, so the query key travels as text beside its own column.
    asked = queries.select("key", "vec").mapInArrow(visits, f"cell int, role string, key {query_type}, vec array<float>")
    asked_sizes = (
        queries.select("key", "vec")
        .mapInArrow(visit_counts, "cell int, role string, n long")
        .groupBy("cell", "role")
        .agg(F.sum("n").alias("n"))
    )
    vector_sizes = spark.createDataFrame(
        [(int(cell), "v", int(n)) for cell, n in zip(*cells[:2])], "cell int, role string, n long"
    )

    def nearest(left_keys, left, right_keys, right, same) -> Iterator[pa.RecordBatch]:
        keys = _as_array(right_keys.field("key"))
        query, row, score = _candidates(left, keys, right, k, metric)
        best = best_per_query(query, keys[row], score, k)
        yield pa.RecordBatch.from_arrays(
            [
                left_keys.field("query_key").take(pa.array(query[best])),
                pa.array(keys[row[best]], type=right_keys.field("key").type),
                pa.array(score[best]),
            ],
            names=["query_key", "key", "score"],
        )

    both = F.struct(F.col("key").alias("key"), F.lit(None).cast(query_type).alias("query_key"))
    rows = placed.select("cell", "role", both.alias("key"), "vec").unionByName(
        asked.select(
            "cell",
            "role",
            F.struct(F.lit(None).cast(key_type).alias("key"), F.col("key").alias("query_key")).alias("key"),
            "vec",
        )
    )
    return B.compare_blocks(
        rows,
        asked_sizes.unionByName(vector_sizes),
        [("q", "v", 0)],
        nearest,
        f"query_key {query_type}, key {key_type}, score double",
        block_rows,
        few_cells=True,
    )
