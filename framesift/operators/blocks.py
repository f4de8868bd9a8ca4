"""Comparing rows within cells, in pieces of bounded size.

Both the similarity join and the nearest-neighbour join put rows into cells
and compare rows of one cell with each other. A cell may be arbitrarily large,
so its rows are cut into blocks and every pair of blocks becomes one group of
its own: no task ever holds more than two blocks. A row is copied for every
cell it visits and every block it meets, so where cells prune little, they are
made fewer and blocks larger (`fewer_cells`, `block_size`): what is shuffled
then follows the rows and not their square, as far as two blocks fit a task.
Without cells (`compare_all`) blocks are written once and read by every task that compares them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.vectors import to_matrix
from framesift.operators.skew import hot_keys, salted_join
from framesift.session import cut_lineage

#: Rows per block: 8192 vectors of length 768 are 24 MB.
BLOCK_ROWS = 8192

#: Pairs of blocks a task compares, at most.
PAIRS_PER_TASK = 16

#: Largest score matrix held at a time, in entries (8 MB of doubles, within reach of a cache).
MATRIX_ENTRIES = 1_000_000

#: Bytes of pivots or queries sent to every task, at most.
BROADCAST_BYTES = 32 * 1024 * 1024


def rows_within_budget(dim: int, limit: int = BROADCAST_BYTES) -> int:
    """How many double vectors of length ``dim`` stay within ``limit`` bytes."""
    return max(1, limit // (8 * max(1, dim)))


#: Copies of a row that the cells may ask for on average, and bytes of copies that are not worth larger cells.
COPIES, FREE_BYTES = 8, 64 * 1024 * 1024

#: Rows that `fewer_cells` measures visits by.
SAMPLE_ROWS = 512


def copies_allowed(n_rows: int, dim: int) -> float:
    """How many copies of ``n_rows`` rows may be shuffled: a fixed number of each, or any that are few bytes."""
    return max(float(COPIES), FREE_BYTES / (4 * max(1, dim) * max(1, n_rows)))


def block_size(n_rows: int, dim: int, block_rows: int) -> int:
    """Rows per block of a join over ``n_rows``: ``block_rows``, or more if that would mean too many copies.

    The bound is single vectors of `BROADCAST_BYTES`, whatever the rows.
    """
    most = BROADCAST_BYTES // (4 * max(1, dim))
    return max(block_rows, min(most, int(-(-n_rows // copies_allowed(n_rows, dim)))))


def sample_rows(vectors: DataFrame, n_rows: int) -> np.ndarray:
    """About `SAMPLE_ROWS` vectors, by the hash of their keys, but not those that become pivots."""
    one_in = max(1, n_rows // SAMPLE_ROWS)
    chosen = vectors.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(one_in)) == 0)
    return to_matrix(chosen.select("vec").limit(2 * SAMPLE_ROWS).toArrow().column("vec"))


def fewer_cells(count: int, allowed: float, visits: Callable[[int], float]) -> int:
    """The number of cells, ``count`` or fewer, at which a row visits no more than ``allowed`` on average.

    ``visits`` measures how many cells a row visits of so many.
    """
    while count > 1:
        found = visits(count)
        if found <= allowed:
            break
        count = max(1, min(count - 1, int(count * allowed / found)))
    return count


def row_steps(n_rows: int, n_columns: int) -> Iterator[slice]:
    """Slices of rows whose score matrix stays within `MATRIX_ENTRIES`."""
    step = max(1, MATRIX_ENTRIES // max(1, n_columns))
    for first in range(0, n_rows, step):
        yield slice(first, min(first + step, n_rows))


Compare = Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray, bool], Iterator[pa.RecordBatch]]

#: (left role, right role, number): which rows of a cell are compared with which.
Rule = tuple[str, str, int]


def _directed(rules: Sequence[Rule]) -> list[tuple[str, str, int, str]]:
    """Each rule as seen from the rows of either role: (role, partner, rule, side)."""
    seen = []
    for left, right, number in rules:
        if left == right:
            seen.append((left, right, number, "B"))
        else:
            seen.append((left, right, number, "L"))
            seen.append((right, left, number, "R"))
    return seen


PLAN = "role string, own_blocks int, jobs array<struct<rule:int,side:string,partner_blocks:int>>"


def _plan_of_few(
    spark: SparkSession, sizes: DataFrame, rules: Sequence[Rule], block_rows: int
) -> tuple[DataFrame, int]:
    """Block plan of a bounded number of cells, one small row per cell and role; and the pairs of blocks."""
    counted = {(row.cell, row.role): row.n for row in sizes.collect()}
    blocks = {place: -(-n // block_rows) for place, n in counted.items()}
    planned: dict[tuple, list] = {}
    pairs = 0
    for (cell, role), n in counted.items():
        for own, partner, rule, side in _directed(rules):
            if own == role and (cell, partner) in blocks and (side != "B" or n > 1):
                planned.setdefault((cell, role), []).append((rule, side, blocks[cell, partner]))
                count = blocks[cell, role] * blocks[cell, partner]
                pairs += {"B": (count + blocks[cell, role]) // 2, "L": count, "R": 0}[side]
    rows = [(cell, role, blocks[cell, role], jobs) for (cell, role), jobs in planned.items()]
    return spark.createDataFrame(rows, "cell int, " + PLAN), pairs


def _plan_of_many(spark: SparkSession, sizes: DataFrame, rules: Sequence[Rule], block_rows: int) -> DataFrame:
    """The same where the cells are themselves data: counted, joined and grouped by cell."""
    table = F.broadcast(
        spark.createDataFrame(_directed(rules), "role string, partner string, rule int, side string")
    )
    blocks = sizes.select("cell", "role", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("own_blocks"))
    partners = blocks.select(
        "cell", F.col("role").alias("partner"), F.col("own_blocks").alias("partner_blocks")
    )
    return (
        blocks.join(table, "role")
        .join(partners, ["cell", "partner"])
        .filter((F.col("side") != "B") | (F.col("n") > 1))
        .groupBy("cell", "role")
        .agg(
            F.first("own_blocks").alias("own_blocks"),
            F.collect_list(F.struct("rule", "side", "partner_blocks")).alias("jobs"),
        )
    )  # ``jobs`` has at most one entry per rule


def compare_blocks(
    rows: DataFrame,
    sizes: DataFrame,
    rules: Sequence[Rule],
    compare: Compare,
    schema: str,
    block_rows: int,
    few_cells: bool,
) -> DataFrame:
    """Run ``compare`` on every pair of blocks that ``rules`` asks for.

    ``rows`` has columns (cell, role, key, vec); ``sizes`` has (cell, role, n).
    A rule compares all rows of the one role with all rows of the other inside
    each cell; with equal roles, every unordered pair once. ``compare``
    receives left keys and vectors, right keys and vectors, and whether both
    sides are the same rows. ``few_cells`` says the number of cells has a
    bound, so the block plan may be broadcast.
    """
    spark = rows.sparkSession
    if few_cells:
        plan, pairs = _plan_of_few(spark, sizes, rules, block_rows)
        planned = rows.join(F.broadcast(plan), ["cell", "role"])
        partitions = _partitions(spark, pairs)
    else:
        plan = _plan_of_many(spark, sizes, rules, block_rows)
        on = ["cell", "role"]
        planned = salted_join(rows, plan, on, hot_keys(sizes, on, 16 * block_rows), F.col("key"))
        partitions = None

    own, other = F.col("own"), F.col("other")
    side = F.col("job.side")
    placed = (
        planned.withColumn("own", F.pmod(F.xxhash64("key"), F.col("own_blocks")).cast("int"))
        .withColumn("job", F.explode("jobs"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("job.partner_blocks") - 1)))
        .select(
            "cell",
            F.col("job.rule").alias("rule"),
            F.when(side == "B", F.least(own, other)).when(side == "L", own).otherwise(other).alias("a"),
            F.when(side == "B", F.greatest(own, other)).when(side == "L", other).otherwise(own).alias("b"),
            F.when(side != "B", side)
            .when(own == other, F.lit("B"))
            .when(own < other, F.lit("L"))
            .otherwise(F.lit("R"))
            .alias("side"),
            "key",
            "vec",
        )
    )
    group = ["cell", "rule", "a", "b"]
    if partitions:
        placed = placed.repartition(partitions, *group)
    return placed.groupBy(*group).applyInArrow(_group_function(compare), schema)


#: Blocks of `compare_all`, as far as these are neither small nor over the budget: enough pairs for many cores.
BLOCKS_OF_ALL = 24


def compare_all(rows: DataFrame, n_rows: int, dim: int, compare: Compare, schema: str, block_rows: int) -> DataFrame:
    """Run ``compare`` on all pairs of ``rows`` (key, vec), which no cells can keep apart, each pair once.

    Rows are dealt to blocks and written out, a block as one row; the blocks'
    product with themselves reads these files. So a row is shuffled and written
    once, however many there are, and a task holds two blocks of at most
    `BROADCAST_BYTES` in single precision. Of two different blocks, one of
    their two tasks compares the first half of the lower block with the
    other, the other task the second half.
    """
    key_type = rows.schema["key"].dataType.simpleString()
    most = BROADCAST_BYTES // (4 * max(1, dim))
    count = -(-n_rows // max(1, min(most, max(block_rows, -(-n_rows // BLOCKS_OF_ALL)))))
    dealt = rows.select("key", "vec").repartition(count).withColumn("block", F.spark_partition_id())
    key_list = f"keys array<{key_type}>, vecs binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [batch for batch in batches if batch.num_rows]
        if table:
            keys = pa.chunked_array([batch.column("key") for batch in table]).combine_chunks()
            packed = b"".join(to_matrix(batch.column("vec")).astype(np.float32).tobytes() for batch in table)
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([table[0].column("block").slice(0, 1), listed, pa.array([packed], pa.binary())], names=["block", "keys", "vecs"])

    blocks = cut_lineage(dealt.mapInArrow(pack, f"block int, {key_list}"))
    others = blocks.select(*(F.col(name).alias(f"other_{name}") for name in blocks.columns))

    def side(batch: pa.RecordBatch, at: int, prefix: str) -> tuple[pa.Array, np.ndarray]:
        keys = batch.column(prefix + "keys").slice(at, 1).flatten()
        values = np.frombuffer(batch.column(prefix + "vecs")[at].as_buffer(), dtype=np.float32)
        return keys, values.reshape(len(keys), -1).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, other = batch.column("block")[at].as_py(), batch.column("other_block")[at].as_py()
                keys, matrix = side(batch, at, "")
                if own == other:
                    yield from compare(keys, matrix, keys, matrix, True)
                    continue
                met, against = side(batch, at, "other_")
                if own < other:
                    keys, matrix = keys[: len(keys) // 2], matrix[: len(keys) // 2]
                else:
                    met, against = met[len(met) // 2 :], against[len(met) // 2 :]
                if len(keys) and len(met):
                    yield from compare(keys, matrix, met, against, False)

    return blocks.crossJoin(others.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def _partitions(spark: SparkSession, pairs: int) -> int:
    """Tasks for so many pairs of blocks: by the work, which the bytes shuffled do not show."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(pairs, max(usual, -(-pairs // PAIRS_PER_TASK))))


def _group_function(compare: Compare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        sides = table.column("side").to_numpy(zero_copy_only=False)
        keys, matrix = table.column("key").combine_chunks(), to_matrix(table.column("vec"))
        if (sides == "B").all():
            yield from compare(keys, matrix, keys, matrix, True)
            return
        left, right = np.flatnonzero(sides == "L"), np.flatnonzero(sides == "R")
        if len(left) and len(right):
            a, b = matrix[left], matrix[right]
            del table, matrix
            yield from compare(keys.take(pa.array(left)), a, keys.take(pa.array(right)), b, False)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def choose_pivots(vectors: DataFrame, count: int, n_rows: int) -> tuple[list, np.ndarray]:
    """About ``count`` rows of (key, vec), the first in hash order: fixed and unbiased.

    The joins are exact whatever the pivots are. About twice as many rows as
    needed pass the hash test, so that is all the ordering has to look at.
    """
    chance = min(1.0, 2.0 * count / max(1, n_rows) + 1e-9)
    order = F.xxhash64("key")
    candidates = vectors.select("key", "vec")
    if chance < 1.0:
        candidates = candidates.filter(order < int(-(2**63) + chance * 2**64))
    picked = candidates.orderBy(order, "key").limit(count).collect()
    if not picked:
        picked = vectors.select("key", "vec").limit(1).collect()
    return [row.key for row in picked], np.array([row.vec for row in picked], dtype=np.float64)


def cell_count(n_rows: int, dim: int, block_rows: int) -> int:
    """One cell per block of rows, as far as the pivots stay within the broadcast budget."""
    return int(min(max(1, -(-n_rows // block_rows)), rows_within_budget(dim)))
