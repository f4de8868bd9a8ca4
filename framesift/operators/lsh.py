"""Near duplicates by locality-sensitive hashing: the approximate form for tables too large for all cells.

A vector's code has one bit for each of many random planes, its side. Rows
whose codes agree in all bits of a band are candidates. What is shuffled for
the bands is the key and a sketch of 64 further bits; most pairs that are not
alike are sorted out by their sketches, and vectors are only fetched for the
rest, where the exact score decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.vectors import rounded, to_matrix, unit_rows
from framesift.operators import blocks as B
from framesift.operators.components import connected_groups
from framesift.operators.keys import filter_by_keys
from framesift.operators.near_duplicates import LINK_COLUMNS, PAIR_COLUMNS, _valid, distinct_vectors, representatives
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join
from framesift.session import cut_lineage

#: Share of the pairs at the threshold that the bands are set up to find.
RECALL = 0.99

#: Bits of a band at most, and rows per bucket that one band's own work is worth.
MOST_BITS, BUCKET_WORTH = 30, 32

#: Bits of a sketch, and the share of pairs at the threshold it may sort out.
SKETCH_BITS, SKETCH_LOSS = 64, 1e-5

#: Rows of a bucket up to which Spark joins it with itself; a larger one is compared in blocks. A row
#: meets no more others than that, and a block in Python costs as much as some ten thousand pairs joined.
JOINED_ROWS = 256


def _same_side(threshold: float) -> float:
    """Chance that vectors at the threshold lie on the same side of a random plane."""
    return 1.0 - math.acos(min(1.0, threshold)) / math.pi


def band_plan(n_rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits per band, bands) for the least work at which a pair at the threshold is found with ``recall``.

    A pair shares a band of r bits with the r-th power of the chance for one,
    and any of b bands with 1 - (1 - that)^b. Unrelated rows share a band of r
    bits with probability 2^-r.
    """
    same = _same_side(threshold)
    best = None
    for bits in range(1, MOST_BITS + 1):
        chance = same**bits
        bands = 1 if chance >= recall else math.ceil(math.log(1.0 - recall) / math.log1p(-chance))
        work = bands * (BUCKET_WORTH + n_rows / 2.0**bits)
        if best is None or work < best[0]:
            best = (work, bits, bands)
    return best[1], best[2]


def sketch_limit(threshold: float) -> int:
    """How many bits of a sketch may differ so that a pair at the threshold is sorted out with `SKETCH_LOSS` at most."""
    apart, above = 1.0 - _same_side(threshold), 1.0
    for limit in range(SKETCH_BITS + 1):
        above -= math.comb(SKETCH_BITS, limit) * apart**limit * (1.0 - apart) ** (SKETCH_BITS - limit)
        if above <= SKETCH_LOSS:
            return limit
    return SKETCH_BITS


def band_rows(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(cell, key, sketch): each row once per band, in the bucket of its bits there. No vector goes along."""
    key_type = vectors.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        weights = np.uint64(1) << np.arange(SKETCH_BITS, dtype=np.uint64)
        for batch in batches:
            matrix = unit_rows(to_matrix(batch.column("vec")))
            if not len(matrix):
                continue
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(matrix.shape[1], bits * bands + SKETCH_BITS))
            for part in B.row_steps(len(matrix), planes.shape[1]):
                sides = matrix[part] @ planes > 0
                sketches = (sides[:, bits * bands :] * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
                codes = sides[:, : bits * bands].reshape(len(sides), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
                keys = batch.column("key").slice(part.start, len(sides))
                arrays = [keys, pa.array(sketches), pa.array(list(codes), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "sketch", "codes"])

    coded = vectors.select("key", "vec").mapInArrow(run, f"key {key_type}, sketch long, codes array<long>")
    cells = F.transform("codes", lambda code, band: F.shiftleft(band.cast("long"), 32) + code)
    return coded.select(F.explode(cells).alias("cell"), "key", "sketch")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def _emit_alike(limit: int):
    """Pairs (key, other) of rows whose sketches differ in at most ``limit`` bits."""

    def sketches(halves: np.ndarray) -> np.ndarray:
        low, high = halves.astype(np.int64).astype(np.uint64).T
        return high << np.uint64(32) | low

    def compare(left_keys, left, right_keys, right, same) -> Iterator[pa.RecordBatch]:
        a, b = sketches(left), sketches(right)
        for part in B.row_steps(len(a), len(b)):
            i, j = np.nonzero(_ones(a[part][:, None] ^ b[None, :]) <= limit)
            i = i + part.start
            if same:
                i, j = i[i < j], j[i < j]
            x, y = left_keys.take(pa.array(i)), right_keys.take(pa.array(j))
            lower = pc.less(x, y)
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(lower, y, x), pc.if_else(lower, x, y)], names=["key", "other"]
            )

    return compare


def _joined(rows: DataFrame, rules: list[B.Rule], limit: int) -> DataFrame:
    """Pairs (key, other) that ``rules`` compare inside the small buckets of ``rows``, which have a ``number`` each."""
    left = rows.select("cell", F.col("role").alias("left"), "key", F.col("sketch").alias("mine"), "number")
    right = rows.select(
        "cell", F.col("role").alias("right"), F.col("key").alias("met"), F.col("sketch").alias("theirs"), F.col("number").alias("next")
    )
    asked = F.lit(False)
    for a, b, _ in rules:
        asked |= ((F.col("left") == a) & (F.col("right") == b)) | ((F.col("left") == b) & (F.col("right") == a))
    pairs = left.join(right, "cell").filter((F.col("number") < F.col("next")) & asked & (_apart("mine", "theirs") <= limit))
    pairs = pairs.filter(F.col("key").isNotNull() & F.col("met").isNotNull())
    return pairs.select(F.greatest("key", "met").alias("key"), F.least("key", "met").alias("other"))


def _alike(rows: DataFrame, rules: list[B.Rule], limit: int, block_rows: int, joined_rows: int = JOINED_ROWS) -> DataFrame:
    """Distinct pairs (key, other), other being lower, that ``rules`` compare inside the buckets of ``rows``.

    ``rows`` is written out. Most buckets hold a few rows, and there are more
    of them than vectors: those of up to ``joined_rows`` are one join, and only
    larger ones are groups in Python, cut into blocks.
    """
    key_type = rows.schema["key"].dataType.simpleString()
    sizes = cut_lineage(rows.groupBy("cell", "role").agg(F.count("*").alias("n")))
    large = cut_lineage(sizes.groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > joined_rows).select("cell"))
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    if large.isEmpty():
        return _joined(numbered, rules, limit).distinct()
    found = _joined(filter_by_keys(numbered, large, "cell", keep=False), rules, limit)
    halves = F.array(F.col("sketch").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("sketch", 32))
    narrow = filter_by_keys(rows, large, "cell", keep=True).select("cell", "role", "key", halves.alias("vec"))
    sizes = sizes.join(large, "cell", "left_semi")
    schema = f"key {key_type}, other {key_type}"
    blocks = B.compare_blocks(narrow, sizes, rules, _emit_alike(limit), schema, block_rows, few_cells=False)
    return found.unionByName(blocks).distinct()


def _cosines(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = unit_rows(to_matrix(left)), unit_rows(to_matrix(right))
    return pa.array(rounded(np.einsum("nd,nd->n", a, b)) if len(a) else [], type=pa.float64())


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, other, score) of the pairs whose vectors are at least ``threshold`` alike.

    Only vectors of listed keys are fetched. ``pairs`` is written out; one
    ``other`` may be in very many of them.
    """
    pairs = cut_lineage(pairs.select("key", "other"))
    listed = pairs.select("key").unionByName(pairs.select(F.col("other").alias("key"))).distinct()
    wanted = filter_by_keys(vectors.select("key", "vec"), listed, "key", keep=True)
    hot = hot_keys(pairs.groupBy("other").agg(F.count("*").alias("n")), ["other"], hot_rows)
    others = wanted.select(F.col("key").alias("other"), F.col("vec").alias("other_vec"))
    both = salted_join(pairs, others, ["other"], hot, F.col("key")).join(wanted, "key")
    score = F.arrow_udf(_cosines, "double")(F.col("vec"), F.col("other_vec"))
    return both.select("key", "other", score.alias("score")).filter(F.col("score") >= threshold)


def _between_groups(pairs: DataFrame, groups: DataFrame, hot_rows: int) -> DataFrame:
    """The pairs that ``groups`` (key, group_id) does not connect already."""
    pairs = cut_lineage(pairs)
    hot = hot_keys(pairs.groupBy("other").agg(F.count("*").alias("n")), ["other"], hot_rows)
    other = groups.select(F.col("key").alias("other"), F.col("group_id").alias("other_group"))
    named = salted_join(pairs.join(groups, "key", "left"), other, ["other"], hot, F.col("key"), "left")
    apart = F.coalesce("group_id", "key") != F.coalesce("other_group", "other")
    return named.filter(apart).select("key", "other")


def near_duplicate_links_lsh(
    table: DataFrame,
    key: str,
    vector: str,
    threshold: float,
    recall: float = RECALL,
    dim: int | None = None,
    seed: int = 7,
    block_rows: int = B.BLOCK_ROWS,
    bits: int | None = None,
    bands: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Links (key, root) that connect what chains of candidates at least ``threshold`` alike connect.

    In every bucket all rows are held against its lowest key first: one pair a
    row, whatever the bucket holds, and of a row's pairs the vectors of the
    first are fetched, then of those that are not connected yet. Rows that
    this leaves apart from their bucket's lowest key are then compared, by
    sketch and in blocks, with all rows of the bucket; two rows that are
    connected to it need no comparison. Every link is checked exactly.
    """
    valid = cut_lineage(_valid(table, key, vector, dim))
    vectors, copies = representatives(valid)
    vectors = cut_lineage(vectors)
    n_rows = vectors.count()
    key_type = vectors.schema["key"].dataType.simpleString()
    if not n_rows:
        return vectors.sparkSession.createDataFrame([], LINK_COLUMNS.format(key_type))
    if bits is None or bands is None:
        bits, bands = band_plan(n_rows, threshold, recall)
    limit = sketch_limit(threshold)

    rows = cut_lineage(band_rows(vectors, bits, bands, seed))
    lowest = F.min(F.struct("key", "sketch")).alias("lowest")
    hubs = rows.groupBy("cell").agg(lowest, F.count("*").alias("n")).filter("n > 1")
    hubs = cut_lineage(hubs.select("cell", F.col("lowest.key").alias("other"), F.col("lowest.sketch").alias("hub"), "n"))
    placed = salted_join(rows, hubs, ["cell"], hot_keys(hubs, ["cell"], hot_rows), F.col("key"))
    placed = cut_lineage(placed.withColumn("close", _apart("sketch", "hub") <= limit).drop("hub"))

    to_hubs = cut_lineage(placed.filter("close and key != other").select("key", "other").distinct())
    first = cut_lineage(to_hubs.groupBy("key").agg(F.min("other").alias("other")))
    links = cut_lineage(verified(first, vectors, threshold, hot_rows).select("key", "other"))
    groups = cut_lineage(connected_groups(links, "key", "other", hot_rows))
    others = to_hubs.join(first, ["key", "other"], "left_anti")
    more = verified(_between_groups(others, groups, hot_rows), vectors, threshold, hot_rows).select("key", "other")
    links = cut_lineage(links.unionByName(more))
    groups = cut_lineage(connected_groups(links, "key", "other", hot_rows))

    apart = _between_groups(to_hubs, groups, hot_rows).withColumn("apart", F.lit(True))
    several = placed.filter("n > 2").join(apart, ["key", "other"], "left")
    settled = F.col("close") & F.col("apart").isNull()
    several = cut_lineage(several.select("cell", F.when(settled, "c").otherwise("n").alias("role"), "key", "sketch"))
    rest = _alike(several, [("n", "n", 0), ("n", "c", 1)], limit, block_rows).join(to_hubs, ["key", "other"], "left_anti")
    more = verified(_between_groups(rest, groups, hot_rows), vectors, threshold, hot_rows).select("key", "other")
    return links.unionByName(more).withColumnRenamed("other", "root").unionByName(copies)


def near_duplicate_groups_lsh(
    table: DataFrame, key: str, vector: str, threshold: float, recall: float = RECALL, **options: int
) -> DataFrame:
    """(key, group_id) as `near_duplicate_groups`, from candidates; ``options`` as in `near_duplicate_links_lsh`."""
    return connected_groups(near_duplicate_links_lsh(table, key, vector, threshold, recall, **options))


def near_duplicate_pairs_lsh(
    table: DataFrame,
    key: str,
    vector: str,
    threshold: float,
    recall: float = RECALL,
    seed: int = 7,
    block_rows: int = B.BLOCK_ROWS,
    bits: int | None = None,
    bands: int | None = None,
) -> DataFrame:
    """Approximate form of `near_duplicate_pairs` for tables too large for it: (key_a, key_b, score).

    Rows are compared if they lie on the same side of all random planes of one
    band; `band_plan` chooses bits and bands from the threshold, the rows and
    the ``recall`` wanted at the threshold (closer pairs are found more
    surely). Every pair returned is checked exactly. Buckets are compared block
    by block, hot ones included.
    """
    vectors = cut_lineage(distinct_vectors(table, key, vector).select("key", "vec"))
    n_rows = vectors.count()
    if not n_rows:
        schema = PAIR_COLUMNS.format(vectors.schema["key"].dataType.simpleString())
        return vectors.sparkSession.createDataFrame([], schema)
    if bits is None or bands is None:
        bits, bands = band_plan(n_rows, threshold, recall)
    rows = cut_lineage(band_rows(vectors, bits, bands, seed).withColumn("role", F.lit("n")))
    pairs = _alike(rows, [("n", "n", 0)], sketch_limit(threshold), block_rows)
    found = verified(pairs, vectors, threshold)
    return found.select(F.col("other").alias("key_a"), F.col("key").alias("key_b"), "score")
