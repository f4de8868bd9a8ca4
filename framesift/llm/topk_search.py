"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, but no scores are shuffled. A
round counts them into a histogram for each query; the histograms of all tasks
are summed up, and the bin that holds the query's kth value is cut into finer
bins for the next round, until it is one value wide. A last round lets through
what lies above that value, and of the ties at it the smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import ROW, best_rows, drop_written, keyed, write_shared

#: Bits of a bin's number: a round narrows every range by 256.
BIN_BITS = 8

#: Queries and bytes of their components sent to every task at a time, about.
BLOCK_QUERIES, BLOCK_BYTES = 8192, 32 << 20

#: Scores of a task held at a time, and tied rows kept before they are cut down.
MATRIX_ENTRIES, HELD_TIES = 1 << 20, 1 << 17

#: Scores beyond this end here, so that differences of two fit into 64 bits.
MOST = 1 << 62


def _integers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the rows of a list column, by length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        yield int(length), places, flat.astype(np.int64).reshape(len(places), int(length))


def _largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.min(initial=0))), abs(int(matrix.max(initial=0))))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All integer inner products of two int64 matrices' rows, exact up to `MOST`."""
    bound = _largest(left) * _largest(right) * left.shape[1]
    if bound < 1 << 53:  # every partial sum is exact in a double
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if bound < MOST:
        return left @ right.T
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


@dataclass
class Queries:
    """A block of queries and, for each, the range of scores in which its kth value lies."""

    rows: np.ndarray  # row keys, in order
    ids: list
    matrices: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: places among the queries, components
    low: np.ndarray  # least score of the range
    high: np.ndarray  # and its largest
    shift: np.ndarray  # bits of a bin's width
    needed: np.ndarray  # how many are still wanted from the range on down
    open: np.ndarray  # whether the range is wider than one value
    bits: int  # of a bin's number

    def scored(self, batch: pa.RecordBatch, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, places in the batch, scores) over all pairs of equal length; a query's own row scores below all."""
        keys = batch[ROW].to_numpy(zero_copy_only=False)
        own = np.minimum(np.searchsorted(self.rows, keys), len(self.rows) - 1)
        own = np.where(self.rows[own] == keys, own, -1)
        for length, places, matrix in _integers(batch["vec"]):
            if length not in self.matrices:
                continue
            numbers, queries = self.matrices[length]
            chosen = some[numbers]
            numbers, queries = numbers[chosen], queries[chosen]
            step = max(1, MATRIX_ENTRIES // max(1, len(places)))
            for at in range(0, len(numbers), step):
                part = numbers[at : at + step]
                scores = inner_products(queries[at : at + step], matrix)
                mine = own[places]
                column = np.flatnonzero(mine >= 0)
                row = np.minimum(np.searchsorted(part, mine[column]), len(part) - 1)
                same = part[row] == mine[column]
                scores[row[same], column[same]] = -MOST - 1
                yield part, places, scores


def _histograms(block: Queries):
    """Each task's counts (query, bin, n), from the highest bin on down to the one with the last row wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = 1 << block.bits
        counts = np.zeros((len(block.rows), bins), dtype=np.int64)
        floor = block.low.copy()  # below these scores a query has enough already
        for batch in batches:
            for part, _, scores in block.scored(batch, block.open):
                i, j = np.nonzero((scores >= floor[part][:, None]) & (scores <= block.high[part][:, None]))
                query = part[i]
                place = (scores[i, j] - block.low[query]) >> block.shift[query]
                some = np.bincount(i * bins + place, minlength=len(part) * bins).reshape(len(part), bins)
                counts[part] += some
                reached = counts[part][:, ::-1].cumsum(axis=1) >= block.needed[part][:, None]
                last = np.where(reached.any(axis=1), bins - 1 - reached.argmax(axis=1), 0)
                floor[part] = block.low[part] + (last << block.shift[part])
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, place = np.nonzero((counts > 0) & (above < block.needed[:, None]))
        arrays = [pa.array(query.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[query, place])]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "bin", "n"])

    return run


def _narrow(vectors: DataFrame, block: Queries) -> None:
    """One round: every open range becomes the bin that holds the kth value."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(block)
    counted = vectors.mapInArrow(lambda batches: _histograms(shared.value)(batches), "query int, bin int, n long")
    counted = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    needed = spark.createDataFrame(list(enumerate(block.needed.tolist())), "query int, needed long")
    reached = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))
    summed = counted.withColumn("reached", reached).join(F.broadcast(needed), "query")
    kth = summed.filter("reached >= needed and reached - n < needed").select("query", "bin", (F.col("reached") - F.col("n")).alias("above"))
    found = np.array([tuple(r) for r in kth.collect()], dtype=np.int64).reshape(-1, 3)  # a row per query of the block
    shared.unpersist()
    query, place, above = found.T
    short = block.open.copy()
    short[query] = False  # fewer rows than wanted: all of them are let through
    block.low[short], block.open[short] = -MOST, False
    block.low[query] += place << block.shift[query]
    block.high[query] = np.minimum(block.high[query], block.low[query] + (np.int64(1) << block.shift[query]) - 1)
    block.needed[query] -= above
    done = block.shift[query] == 0
    block.open[query[done]] = False
    block.shift[query] = np.maximum(block.shift[query] - block.bits, 0)


def _first(table: pa.Table, most: np.ndarray) -> pa.Table:
    """The first ``most[query]`` rows of each query by id, null ids last, then by row."""
    table = table.sort_by([("query", "ascending"), ("id", "ascending"), ("row", "ascending")])
    query = table["query"].to_numpy()
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return table.filter(pa.array(place < most[query]))


def _winners(block: Queries, names: list[str]):
    """Rows above each query's kth value, and the smallest ids of those at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everyone = np.ones(len(block.rows), dtype=bool)
        ties, size, id_type = [], 0, None
        query_ids = None

        def out(query: np.ndarray, ids: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
            which = query_ids.take(pa.array(query))
            return pa.RecordBatch.from_arrays([pa.array(block.rows[query]), which, ids, pa.array(scores)], names)

        for batch in batches:
            if query_ids is None:
                id_type = batch["_id"].type
                query_ids = pa.array(block.ids, id_type)
            for part, places, scores in block.scored(batch, everyone):
                i, j = np.nonzero(scores > block.low[part][:, None])
                if len(i):
                    yield out(part[i], batch["_id"].take(pa.array(places[j])), scores[i, j])
                i, j = np.nonzero(scores == block.low[part][:, None])
                taken = pa.array(places[j])
                ties.append(
                    pa.table({"query": part[i], "id": batch["_id"].take(taken), "row": batch[ROW].take(taken)})
                )
                size += len(i)
                if size > HELD_TIES:
                    ties = [_first(pa.concat_tables(ties), block.needed)]
                    size = ties[0].num_rows
        if size:
            kept = _first(pa.concat_tables(ties), block.needed).combine_chunks()
            query = kept["query"].to_numpy()
            yield out(query, pc.cast(kept["id"], id_type).combine_chunks(), block.low[query])

    return run


def _block(queries: DataFrame, k: int, longest: float, bits: int = BIN_BITS) -> Queries:
    """The queries and their first ranges, which hold every score their length and the longest vector's allow."""
    rows = queries.orderBy(ROW).toArrow().combine_chunks()  # a block of bounded size
    keys = rows[ROW].to_numpy()
    matrices, low, shift = {}, np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    needed, wide = np.full(len(keys), k, dtype=np.int64), np.ones(len(keys), dtype=bool)
    column = rows["vec"].combine_chunks() if isinstance(rows["vec"], pa.ChunkedArray) else rows["vec"]
    for length, places, matrix in _integers(column):
        matrices[length] = (places, matrix)
        for place, vector in zip(places, matrix):
            size = math.sqrt(float((vector.astype(np.float64) ** 2).sum()))
            bound = min(MOST - 1, int(size * longest * (1 + 1e-9)) + 1)
            low[place] = -bound
            shift[place] = max(0, (2 * bound).bit_length() - bits)
    return Queries(keys, rows["_id"].to_pylist(), matrices, low, -low, shift, needed, wide, bits)


def top_k_search(
    table: DataFrame,
    queries: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    block_queries: int = BLOCK_QUERIES,
    bin_bits: int = BIN_BITS,
) -> DataFrame:
    """One row per hit: (query_id, rank, vec_id, score), each query's ``k`` best by integer inner product.

    A vector's components become floor(``scale`` * x). ``queries`` is a
    condition on the rows of ``table``; those that meet it are held against all
    other rows. Equal scores are ordered by ascending id.

    Vectors that are null or hold a null or a non-finite component take no
    part, neither as queries nor as candidates. Vectors of different lengths
    have no product and do not meet. A query with fewer than k candidates
    returns all of them; a condition that is null is not met. Rows with null or
    repeated ids are rows of their own: a query among them meets the others of
    its id, null ids come last among equal scores. Components end at 64 bits
    and scores at 2^62. An empty table gives an empty result. Other columns are
    only read by ``queries``.

    No task holds more than a block of queries with 2^``bin_bits`` counts each, and only
    counts and the rows from each kth value on are shuffled.
    """
    spark = table.sparkSession
    extra = [F.col(ROW)] if ROW in table.columns else []
    narrow = table.select(*extra, F.col(id_col), F.col(vector_col), F.coalesce(queries, F.lit(False)).alias("__query"))
    rows = keyed(narrow, id_col, vec=vector_col, query="__query").withColumn("vec", F.col("vec").cast("array<double>"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec").isNotNull() & finite)
    vectors = write_shared(rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)))), "vectors")
    id_type = vectors.schema["_id"].dataType.simpleString()

    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    size = vectors.agg(
        F.max(squares).alias("longest"),
        F.sum(F.col("query").cast("long")).alias("n"),
        F.sum(F.when(F.col("query"), F.size("vec"))).alias("components"),
    ).first()
    names = ["query_row", "query_id", id_col, "score"]
    schema = f"query_row long, query_id {id_type}, `{id_col}` {id_type}, score long"
    if not size.n:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, `{id_col}` {id_type}, score long")
    blocks = max(math.ceil(size.n / block_queries), math.ceil(8 * size.components / BLOCK_BYTES))
    asked = vectors.filter("query").withColumn("block", F.pmod(F.xxhash64(ROW), F.lit(blocks)))
    found, candidates = [], vectors.select(ROW, "_id", "vec")
    for number in range(blocks):
        chosen = asked.filter(F.col("block") == number).select(ROW, "_id", "vec")
        block = _block(chosen, k, math.sqrt(size.longest), bin_bits)
        if not len(block.rows):
            continue
        while block.open.any():
            _narrow(candidates, block)
        shared = spark.sparkContext.broadcast(block)
        winners = candidates.mapInArrow(lambda batches, s=shared: _winners(s.value, names)(batches), schema)
        found.append(write_shared(winners, "winners"))
        shared.unpersist()
    drop_written(vectors)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    order = [F.desc("score"), F.col(id_col).asc_nulls_last()]
    return best_rows(result, ["query_row"], order, k).select("query_id", "rank", id_col, "score")
