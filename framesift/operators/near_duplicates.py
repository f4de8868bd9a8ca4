"""Near duplicates: an exact cosine similarity join. `lsh` has the approximate form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.vectors import as_vector, rounded, searchable_vectors, to_matrix, unit_rows, vector_digest
from framesift.operators import blocks as B
from framesift.operators.keys import filter_by_keys
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join
from framesift.session import cut_lineage

#: Slack of the pruning test; larger than any rounding of scores.
PRUNE_SLACK = 1e-5

#: Columns of a score matrix: few enough for the cache, so that many rows share them.
TILE_COLUMNS = 4096

#: Share of rows next to a pivot from which cells are kept, as they link such rows without comparing them.
CORE_SHARE = 1 / 16

PAIR_COLUMNS = "key_a {0}, key_b {0}, score double"
LINK_COLUMNS = "key {0}, root {0}"


def _valid(table: DataFrame, key: str, vector: str, dim: int | None) -> DataFrame:
    rows = table.select(F.col(key).alias("key"), as_vector(F.col(vector)).alias("vec"))
    return searchable_vectors(rows, "vec", dim).select("key", "vec")


def distinct_vectors(table: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """One row per distinct valid vector: (key, vec), key being the lowest."""
    return representatives(cut_lineage(_valid(table, key, vector, dim)))[0]


def representatives(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lowest key of every distinct vector with its vector, and links (key, root) from the others to it.

    Vectors are told apart by their digests, so only keys and digests are
    shuffled to find the copies, and a vector that fills a third of the table
    is one row per task there. ``valid`` is written out already.
    """
    copies = cut_lineage(_copies(valid))
    return filter_by_keys(valid, copies, "key", keep=False), copies


def _exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of chosen rows, in double."""
    step = max(1, B.MATRIX_ENTRIES // left.shape[1])
    parts = [
        np.einsum("nd,nd->n", left[i[at : at + step]], right[j[at : at + step]]) for at in range(0, len(i), step)
    ]
    return np.concatenate(parts) if parts else np.empty(0)


def _hits(
    left: np.ndarray, right: np.ndarray, threshold: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Close rows as (left, right, score). Single precision finds them, double decides."""
    left, right = unit_rows(left), unit_rows(right)
    quick_left, quick_right = left.astype(np.float32), right.astype(np.float32)
    # No sum of products of unit vectors is further off than this in single precision.
    floor = np.float32(threshold - 1e-6 - 1e-7 * (left.shape[1] + 4))
    for part, columns in _tiles(len(left), len(right), same):
        quick = quick_left[part] @ quick_right[columns].T
        if same:
            both = np.arange(max(part.start, columns.start), min(part.stop, columns.stop))
            quick[both - part.start, both - columns.start] = -2.0
        rows = np.flatnonzero(quick.max(axis=1) >= floor)
        i, j = np.nonzero(quick[rows] >= floor)
        i = rows[i]
        if same:
            ahead = i + part.start < j + columns.start
            i, j = i[ahead], j[ahead]
        if len(i) * 8 > quick.size:
            score = rounded((left[part] @ right[columns].T)[i, j])
        else:
            score = rounded(_exact(left[part], right[columns], i, j))
        kept = score >= threshold
        yield i[kept] + part.start, j[kept] + columns.start, score[kept]


def _tiles(n_left: int, n_right: int, same: bool) -> Iterator[tuple[slice, slice]]:
    """Rows and columns of score matrices within `MATRIX_ENTRIES`, neither of them few; of equal sides only above the diagonal."""
    for part in B.row_steps(n_left, min(n_right, TILE_COLUMNS)):
        for first in range(0, n_right, TILE_COLUMNS):
            columns = slice(first, min(first + TILE_COLUMNS, n_right))
            if not same or columns.stop > part.start + 1:
                yield part, columns


def _emit_pairs(threshold: float):
    def compare(left_keys, left, right_keys, right, same) -> Iterator[pa.RecordBatch]:
        for i, j, score in _hits(left, right, threshold, same):
            a, b = left_keys.take(pa.array(i)), right_keys.take(pa.array(j))
            ordered = pc.less(a, b)
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(ordered, a, b), pc.if_else(ordered, b, a), pa.array(score)],
                names=["key_a", "key_b", "score"],
            )

    return compare


def _settle(roots: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the trees of all linked nodes; afterwards ``roots`` points straight at roots."""
    while True:
        a, b = roots[u], roots[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = roots[roots]
            if np.array_equal(above, roots):
                break
            roots[:] = above


def _emit_links(threshold: float):
    """Instead of all close pairs, a forest that connects the same rows: at most one link a row."""

    def compare(left_keys, left, right_keys, right, same) -> Iterator[pa.RecordBatch]:
        offset = 0 if same else len(left_keys)
        nodes = left_keys if same else pa.concat_arrays([left_keys, right_keys])
        order = pc.sort_indices(nodes).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        nodes = nodes.take(pa.array(order))  # in key order, so a root is its tree's lowest key
        roots = np.arange(len(nodes))
        for i, j, _ in _hits(left, right, threshold, same):
            _settle(roots, place[i], place[j + offset])
        linked = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays(
            [nodes.take(pa.array(linked)), nodes.take(pa.array(roots[linked]))], names=["key", "root"]
        )

    return compare


#: Blocks of a cell above which it is cut into cells of its own, and rows that are placed in these together.
SPLIT_BLOCKS, PLACED_ROWS = 64, 16384


def _visits(matrix: np.ndarray, pivots: np.ndarray, apart: np.ndarray | None, reach: float) -> tuple[np.ndarray, ...]:
    """(row, cell, whether it is the row's home, score to the pivot) of unit rows: one home each, and every cell they may match into.

    Let x live in the cell of pivot p and y in that of q. The distance of y
    beyond the plane halfway between p and q, (y.q - y.p) / |p - q|, cannot
    exceed |x - y|, and close vectors have |x - y| <= sqrt(2 - 2 threshold).
    So y needs to visit p's cell only if that distance stays within the reach.
    Each pair of cells is compared in one of the two, alternating which.
    """
    numbers = np.arange(len(pivots))
    scores = matrix @ pivots.T
    home = scores.argmax(axis=1)
    gap = apart[home] if apart is not None else np.sqrt(np.maximum(2.0 - 2.0 * (pivots[home] @ pivots.T), 0.0))
    beyond = scores[np.arange(len(home)), home][:, None] - scores
    target = np.where(
        (home[:, None] + numbers[None, :]) % 2 == 0,
        np.minimum(home[:, None], numbers[None, :]),
        np.maximum(home[:, None], numbers[None, :]),
    )
    visits = (beyond <= reach * gap + PRUNE_SLACK) & (target == numbers[None, :])
    visits[np.arange(len(home)), home] = True
    row, cell = np.nonzero(visits)
    return row, cell, cell == home[row], scores[row, cell]


def _mean_visits(sample: np.ndarray, pivots: np.ndarray, reach: float) -> float:
    """How many of the pivots' cells a row of the sample visits on average."""
    apart, found = _gaps(pivots), 0
    for part in B.row_steps(len(sample), len(pivots)):
        found += len(_visits(sample[part], pivots, apart, reach)[0])
    return found / max(1, len(sample))


def _prunes_nothing(sample: np.ndarray, pivots: np.ndarray, threshold: float) -> bool:
    """Whether cells of these pivots still compare over half of all pairs, by the sample, and hardly a row is linked by its pivot.

    A row meets half of its own cell's rows and all guests of it: with v
    visits a row of c cells, this is (2 v - 1) / c of all pairs.
    """
    visits = _mean_visits(sample, pivots, _reach(threshold))
    linked = sum((sample[part] @ pivots.T >= threshold).any(axis=1).sum() for part in B.row_steps(len(sample), len(pivots)))
    return 2.0 * visits - 1.0 > len(pivots) / 2.0 and linked < CORE_SHARE * len(sample)


def _gaps(pivots: np.ndarray) -> np.ndarray | None:
    """Distances of all pivots, if they are few enough to be kept."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0)) if len(pivots) <= 2048 else None


def _reach(threshold: float) -> float:
    return math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + PRUNE_SLACK


def _assign(vectors: DataFrame, pivots: np.ndarray, threshold: float, key_type: str, mark_core: bool, narrow: bool) -> DataFrame:
    """Rows (cell, role[, key, vec]) of every row's `_visits`.

    Roles are two letters: h(ome) or g(uest), then c(ore) if the row is itself
    close to the pivot, n otherwise.
    """
    reach = _reach(threshold)
    shared = vectors.sparkSession.sparkContext.broadcast(unit_rows(pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        apart = _gaps(pivots)
        for batch in batches:
            matrix = unit_rows(to_matrix(batch.column("vec")))
            for part in B.row_steps(len(matrix), len(pivots)):
                row, cell, home, score = _visits(matrix[part], pivots, apart, reach)
                core = rounded(score) >= threshold if mark_core else np.zeros(len(row), dtype=bool)
                role = np.char.add(np.where(home, "h", "g"), np.where(core, "c", "n"))
                for some in B.row_steps(len(row), 256):
                    columns = [pa.array(cell[some].astype(np.int32)), pa.array(role[some].tolist())]
                    names = ["cell", "role"]
                    taken = pa.array(row[some] + part.start)
                    columns.append(batch.column("key").take(taken))
                    names.append("key")
                    if not narrow:
                        columns.append(batch.column("vec").take(taken))
                        names.append("vec")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"cell int, role string, key {key_type}" + ("" if narrow else ", vec array<float>")
    return vectors.select("key", "vec").mapInArrow(assign, schema)


def _assign_again(
    rows: DataFrame, large: DataFrame, threshold: float, block_rows: int, dim: int, n_rows: int | None = None
) -> DataFrame:
    """The rows of large cells (cell, n) in cells of their own: (cell, role, key, vec), the role with a third letter.

    A cell's own rows give it pivots, as many as it has blocks, or fewer if
    these are too many copies of the table's ``n_rows``. They are a table joined
    by cell, so their number is bounded for a cell, not for all; a cell's rows
    are placed some thousand at a time. H(ome) and G(uest) tell
    of the second step what h and g tell of the first.
    """
    key_type = rows.schema["key"].dataType.simpleString()
    reach, most = _reach(threshold), B.rows_within_budget(dim)
    if n_rows:
        # half of a cell's cells are visited at worst, by the rows that are in the cell already
        held = max(1, large.agg(F.sum("n")).first()[0])
        most = min(most, max(2, int(2 * B.copies_allowed(n_rows, dim) * n_rows / held)))
    plan = large.select(
        "cell",
        F.least(F.lit(most), F.ceil(F.col("n") / block_rows)).cast("int").alias("wanted"),
        "n",
        F.ceil(F.col("n") / PLACED_ROWS).cast("int").alias("pieces"),
    )
    plan = F.broadcast(cut_lineage(plan))  # a row per cell of the first step
    inside = rows.join(plan, "cell")
    # twice as many as wanted pass the test of the hash; the first of them by the hash are taken
    chance = F.least(F.lit(1.0), 2.0 * F.col("wanted") / F.col("n")) * float(2**62)
    order = F.shiftrightunsigned(F.xxhash64("key", F.lit("pivot")), 2)
    tested = inside.filter(F.col("role").startswith("h") & (order <= chance)).withColumn("order", order)
    first = F.row_number().over(Window.partitionBy("cell").orderBy("order", "key"))
    pivots = tested.withColumn("place", first).filter("place <= wanted").select(
        F.col("cell").alias("above"), "place", "pieces", F.col("vec").alias("pivot")
    )
    part = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part")
    pivots = cut_lineage(pivots).select("above", part, "place", "pivot")
    placed = inside.withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))

    def place(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if not rows.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "key": rows["key"], "vec": rows["vec"]})
        matrix = unit_rows(to_matrix(rows["vec"]))
        # a cell whose rows were all too far up in hash order for a pivot is one cell
        listed = unit_rows(to_matrix(pivots.sort_by("place")["pivot"])) if pivots.num_rows else matrix[:0]
        if not len(listed):
            listed = np.eye(1, matrix.shape[1])
        apart, found = _gaps(listed), []
        for part in B.row_steps(len(matrix), len(listed)):
            row, cell, home, _ = _visits(matrix[part], listed, apart, reach)
            found.append((row + part.start, cell, home))
        row, cell, home = (np.concatenate(column) for column in zip(*found))
        role = pc.binary_join_element_wise(rows["role"].take(pa.array(row)), pa.array(np.where(home, "H", "G").tolist()), "")
        above = int(rows["cell"][0].as_py())
        taken = pa.array(row)
        columns = [pa.array((above << 32) + cell), role, rows["key"].take(taken), rows["vec"].take(taken)]
        return pa.Table.from_arrays(columns, names=["cell", "role", "key", "vec"])

    by = ["cell", "piece"]
    both = placed.select(*by, "role", "key", "vec").groupBy(*by).cogroup(pivots.groupBy("above", "part"))
    return both.applyInArrow(place, f"cell long, role string, key {key_type}, vec array<float>")


def _finer_rules() -> list[B.Rule]:
    """Which roles of `_assign_again` meet: no two guests of either step, and no two that their pivot links."""
    roles = [a + b + c for a in "hg" for b in "nc" for c in "HG"]
    rules = []
    for i, left in enumerate(roles):
        for right in roles[i:]:
            if (left[0], right[0]) != ("g", "g") and (left[1], right[1]) != ("c", "c") and (left[2], right[2]) != ("G", "G"):
                rules.append((left, right, len(rules)))
    return rules


def _similarity_join(
    vectors: DataFrame,
    threshold: float,
    links: bool,
    block_rows: int,
    most_cells: int | None = None,
    split_blocks: int = SPLIT_BLOCKS,
) -> DataFrame:
    """Exact join over distinct vectors (key, vec); ``links`` asks for a connecting forest.

    Cells of more than ``split_blocks`` blocks, as there are once the pivots
    no longer fit into one broadcast (or are more than ``most_cells``), are cut
    into cells of their own. There is a cell for each ``block_rows`` rows, or
    fewer if rows would visit too many of them (see `blocks`). Where cells
    would prune nothing, and none or smaller blocks are asked for, there are none and
    all blocks are compared (`compare_all`).
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    spark = vectors.sparkSession
    key_type = vectors.schema["key"].dataType.simpleString()
    schema = (LINK_COLUMNS if links else PAIR_COLUMNS).format(key_type)
    compare = (_emit_links if links else _emit_pairs)(threshold)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not size.n:
        return spark.createDataFrame([], schema)
    count = min(B.cell_count(size.n, size.dim, block_rows), most_cells or size.n)
    pivot_keys, pivots = B.choose_pivots(vectors, count, size.n)
    if len(pivots) > 1:
        sample, units = unit_rows(B.sample_rows(vectors, size.n)), unit_rows(pivots)
        if most_cells is None and block_rows >= B.BLOCK_ROWS and _prunes_nothing(sample, units, threshold):
            return B.compare_all(vectors, size.n, size.dim, compare, schema, block_rows)
        allowed = B.copies_allowed(size.n, size.dim)
        count = B.fewer_cells(len(pivots), allowed, lambda some: _mean_visits(sample, units[:some], _reach(threshold)))
        pivot_keys, pivots = pivot_keys[:count], pivots[:count]
    wished, block_rows = block_rows, B.block_size(size.n, size.dim, block_rows)
    narrow = _assign(vectors, pivots, threshold, key_type, mark_core=links, narrow=True)
    if links:
        narrow = cut_lineage(narrow)
    sizes = narrow.groupBy("cell", "role").agg(F.count("*").alias("n"))
    rows = _assign(vectors, pivots, threshold, key_type, mark_core=links, narrow=False)
    # Core rows of a cell are linked through its pivot already, so two of them
    # need no comparison: a dense cluster costs one link a row.
    rules = [("hn", "hn", 0), ("hn", "gn", 1)]
    if links:
        rules += [("hn", "hc", 2), ("hn", "gc", 3), ("hc", "gn", 4)]
    homes = sizes.groupBy("cell").agg(F.sum("n").alias("n"))
    large = cut_lineage(homes.filter(F.col("n") > split_blocks * wished))
    if large.isEmpty():
        found = B.compare_blocks(rows, sizes, rules, compare, schema, block_rows, few_cells=True)
    else:
        listed = F.broadcast(large.select("cell"))  # no more than there are pivots
        small = B.compare_blocks(
            rows.join(listed, "cell", "left_anti"), sizes.join(listed, "cell", "left_anti"), rules, compare, schema, block_rows, few_cells=True
        )
        finer = cut_lineage(_assign_again(rows, large, threshold, wished, size.dim, size.n))
        finer_sizes = cut_lineage(finer.groupBy("cell", "role").agg(F.count("*").alias("n")))
        found = small.unionByName(
            B.compare_blocks(finer, finer_sizes, _finer_rules(), compare, schema, block_rows, few_cells=False)
        )
    if not links:
        return found
    pivot_table = spark.createDataFrame(
        list(enumerate(pivot_keys)), f"cell int, root {key_type}"
    )
    core = (
        narrow.filter(F.col("role").isin("hc", "gc"))
        .join(F.broadcast(pivot_table), "cell")
        .filter(F.col("key") != F.col("root"))
        .select("key", "root")
    )
    return found.unionByName(core)


def near_duplicate_pairs(
    table: DataFrame,
    key: str,
    vector: str,
    threshold: float,
    dim: int | None = None,
    block_rows: int = B.BLOCK_ROWS,
    **cells: int,
) -> DataFrame:
    """All pairs of distinct vectors with cosine >= ``threshold``: (key_a, key_b, score).

    Equal vectors are represented by their lowest key and paired once; their
    other copies are an exact-duplicate matter (`exact_vector_copies`).
    ``cells`` as in `_similarity_join`.
    """
    vectors = cut_lineage(distinct_vectors(table, key, vector, dim))
    return _similarity_join(vectors, threshold, False, block_rows, **cells)


def exact_vector_copies(table: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """Links (key, root) from every further copy of a vector to its lowest key."""
    return _copies(_valid(table, key, vector, dim))


def _copies(valid: DataFrame) -> DataFrame:
    hashed = valid.select("key", vector_digest(F.col("vec")).alias("digest"))
    members = equal_members(hashed, "digest")
    return members.filter(F.col("key") != F.col("root")).select("key", "root")


def equal_members(rows: DataFrame, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, root) for every row whose ``value`` occurs more than once; root is the lowest such key.

    ``rows`` has the key and a digest. They are written out once, narrow as
    they are, so that whatever they were made from is read a single time. A
    value that fills a third of the table is counted on the map side and its
    rows are spread over many tasks.
    """
    rows = cut_lineage(rows.select("key", value))
    groups = rows.groupBy(value).agg(F.min("key").alias("root"), F.count("*").alias("n")).filter("n > 1")
    groups = cut_lineage(groups)
    joined = salted_join(rows, groups.drop("n"), [value], hot_keys(groups, [value], hot_rows), F.col("key"))
    return joined.select("key", "root")


def near_duplicate_links(
    table: DataFrame,
    key: str,
    vector: str,
    threshold: float,
    dim: int | None = None,
    block_rows: int = B.BLOCK_ROWS,
    **cells: int,
) -> DataFrame:
    """Links (key, root) that connect exactly the rows chains of close pairs connect.

    For grouping this replaces the pair list, whose length is quadratic in the
    size of a duplicate cluster; the links are linear in it. ``table`` is read
    once, so vectors made on the way by a model are made once.
    """
    valid = cut_lineage(_valid(table, key, vector, dim))
    distinct, copies = representatives(valid)
    return _similarity_join(distinct, threshold, True, block_rows, **cells).unionByName(copies)
