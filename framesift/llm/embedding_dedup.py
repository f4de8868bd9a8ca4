"""Near duplicates among embeddings: spherical k-means cells, and blocked products inside them.

Equal vectors are one vector with a number of copies. Each label's vectors go
to the cell of their nearest centre, and also visit every cell in which a link
can lie: two unit vectors with a cosine of t are sqrt(2 - 2 t) apart at most,
so a vector farther than that from the plane between its own centre and another
one has no link in the other's cell. Cells are cut into blocks, and every pair
of blocks of a cell is one group of bounded size. No link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, keyed, write_shared
from framesift.operators.components import connected_groups
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join

THRESHOLD = 0.93

#: Vectors per cell and per block, on average and at most. Two blocks are compared by one task at a time.
CELL_ROWS, BLOCK_ROWS = 4096, 4096

#: Vectors per cell that the centres are fitted on, a sample by the hash of their key, and steps of the fit.
SAMPLE_PER_CELL, FIT_STEPS = 32, 8

#: Bytes of centres sent to every task, at most; with more vectors the cells grow instead.
CENTRE_BYTES = 32 << 20

#: Rows of a block whose products are held at a time.
ROWS_AT_ONCE = 512

#: Products this near to the threshold are worked out again without rounding on the way.
CLOSE_CALL = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision. All have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def spherical_kmeans(vectors: np.ndarray, count: int, steps: int = FIT_STEPS) -> np.ndarray:
    """Unit centres of ``count`` cells, starting from the first vectors. Empty cells keep their centre."""
    centres = vectors[:count].copy()
    for _ in range(steps):
        home = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _fit_cells(distinct: DataFrame, sizes: DataFrame, cell_rows: int) -> dict[tuple[str, int], np.ndarray]:
    """Centres for each (label, length) with more than ``cell_rows`` vectors."""
    large = sizes.filter(F.col("n") > cell_rows)
    total = large.agg(F.sum(F.ceil(F.col("n") / cell_rows) * F.col("_dim")).alias("t")).first().t or 0
    if not total:
        return {}
    share = min(1.0, CENTRE_BYTES / (8 * total))
    cells = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") / cell_rows) * share)).cast("int")
    large = large.select("_label", "_dim", cells.alias("cells"), (SAMPLE_PER_CELL * cells / F.col("n")).alias("chance"))
    large = write_shared(large, "large-labels")
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    sample = (
        distinct.join(large, ["_label", "_dim"])
        .filter(place < F.col("chance") * (1 << 30))
        .select("_label", "_dim", "cells", place.alias("place"), "node", "vec")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("place", "ascending"), ("node", "ascending")]).combine_chunks()
        label, dim, cells = (rows.column(c)[0].as_py() for c in ("_label", "_dim", "cells"))
        centres = spherical_kmeans(_matrix(rows.column("vec").combine_chunks()), cells)
        columns = [pa.array([label] * len(centres)), pa.array([dim] * len(centres), pa.int32()), pa.array(list(centres))]
        yield pa.RecordBatch.from_arrays(columns, ["_label", "_dim", "centre"])

    fit.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    fitted: dict[tuple[str, int], list] = {}
    made = sample.groupBy("_label", "_dim").applyInArrow(fit, "_label string, _dim int, centre array<double>")
    for row in made.collect():  # within CENTRE_BYTES
        fitted.setdefault((row._label, row._dim), []).append(row.centre)
    return {key: np.array(centres) for key, centres in fitted.items()}


def _place(distinct: DataFrame, centres: dict[tuple[str, int], np.ndarray], threshold: float) -> DataFrame:
    """(cell, home, node, copies, vec): each vector in its own cell, and as a visitor in lower ones.

    A pair from two cells meets in the lower one.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    vec_type = distinct.schema["vec"].dataType.simpleString()
    if not centres:
        cell = F.concat_ws("/", "_label", "_dim", F.lit("0"))
        return distinct.select(cell.alias("cell"), F.lit(True).alias("home"), "node", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch["_label"].to_pylist(), batch["_dim"].to_pylist()
            rows, cells, own = [], [], []
            for key in set(zip(labels, dims)):
                of = np.array([i for i, k in enumerate(zip(labels, dims)) if k == key])
                if key not in centres:
                    rows.append(of)
                    cells.extend([f"{key[0]}/{key[1]}/0"] * len(of))
                    own.append(np.ones(len(of), dtype=bool))
                    continue
                middle = centres[key]
                product = _matrix(batch["vec"].take(pa.array(of))) @ middle.T
                home = product.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * middle @ middle.T))
                goes = product[np.arange(len(of)), home][:, None] - product <= reach * apart[home]
                goes &= np.arange(len(middle)) <= home[:, None]
                which, cell = np.nonzero(goes)
                rows.append(of[which])
                cells.extend(f"{key[0]}/{key[1]}/{c}" for c in cell)
                own.append(cell == home[which])
            picked = pa.array(np.concatenate(rows))
            for first in range(0, len(picked), 8192):
                some = slice(first, first + 8192)
                part = picked[some]
                columns = [pa.array(cells[some], pa.string()), pa.array(np.concatenate(own)[some])]
                columns += [batch[c].take(part) for c in ("node", "copies", "vec")]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "home", "node", "copies", "vec"])

    return distinct.mapInArrow(run, f"cell string, home boolean, node long, copies long, vec {vec_type}")


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places one label, the lowest, in ``labels``."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        apart = low < high
        if not apart.any():
            return
        np.minimum.at(labels, high[apart], low[apart])
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def block_links(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left place, right place) of all pairs of unit vectors at the threshold or above, some rows at a time."""
    for first in range(0, len(left), ROWS_AT_ONCE):
        product = left[first : first + ROWS_AT_ONCE] @ right.T
        linked = product >= threshold
        for i, j in np.argwhere(np.abs(product - threshold) < CLOSE_CALL):
            x, y = left[first + i], right[j]
            exact = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))
            linked[i, j] = exact >= threshold
        a, b = np.nonzero(linked)
        yield a + first, b


def _compare(placed: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(node, n, root) from every pair of blocks: copies of vectors linked to the node, and a link to connect it by."""
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / block_rows).cast("int").alias("homes"),
        F.ceil(F.sum((~F.col("home")).cast("int")) / block_rows).cast("int").alias("visits"),
    )
    sizes = write_shared(sizes, "cells")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int")
    # visitors' blocks are numbered after the homes'; only a pair with a home block is compared
    partners = F.when(F.col("home"), F.sequence(F.lit(0), F.col("homes") + F.col("visits") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("homes") - 1)
    )
    blocks = (
        placed.join(sizes, "cell")
        .filter("homes > 0")
        .withColumn("own", F.when(F.col("home"), own).otherwise(F.col("homes") + own))
        .withColumn("other", F.explode(partners))
    )
    dealt = blocks.select(
        "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        (F.col("own") <= F.col("other")).alias("left"), "node", "copies", "vec",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        vectors = _matrix(rows.column("vec").combine_chunks())
        left = np.flatnonzero(rows.column("left").to_numpy(zero_copy_only=False))
        same = rows.column("a")[0] == rows.column("b")[0]
        right = left if same else np.flatnonzero(~rows.column("left").to_numpy(zero_copy_only=False))
        count, labels = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for i, j in block_links(vectors[left], vectors[right], threshold):
            if same:
                i, j = i[i != j], j[i != j]
            np.add.at(count, left[i], copies[right[j]])
            if not same:
                np.add.at(count, right[j], copies[left[i]])
            _joined(labels, left[i], right[j])
        some = np.flatnonzero(count)
        if len(some):
            columns = [pa.array(node[some]), pa.array(count[some]), pa.array(node[labels[some]])]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "root"])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return dealt.groupBy("cell", "a", "b").applyInArrow(run, "node long, n long, root long")


def embedding_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Vectors of one label are linked when their cosine, in double precision, is
    ``threshold`` or more; copies of a vector are linked to each other. A
    component is what links connect, named by its smallest id, whose row is
    kept.

    A null, zero or empty vector, one with a null or non-finite component and
    one without a label link with nothing; vectors of different lengths never
    link. A null id names a component only if all its ids are null; repeated
    ids are rows of their own. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = keyed(vectors, id_col, _vec=vector_col, _label=label_col)
    rows = rows.select(
        ROW, "_id", F.col("_label").cast("string").alias("_label"),
        F.when(F.col("_label").isNotNull() & _usable(F.col("_vec")), F.col("_vec")).alias("vec"),
    )
    name = F.struct(F.col("_id").isNull().alias("null"), "_id", ROW)
    usable = rows.filter("vec IS NOT NULL")
    distinct = usable.groupBy("_label", "vec").agg(F.min(ROW).alias("node"), F.count("*").alias("copies"), F.min(name).alias("name"))
    distinct = write_shared(distinct.withColumn("_dim", F.size("vec")), "vectors")
    sizes = write_shared(distinct.groupBy("_label", "_dim").agg(F.count("*").alias("n")), "label-sizes")

    centres = _fit_cells(distinct, sizes, cell_rows)
    placed = write_shared(_place(distinct, centres, threshold), "placed-vectors")
    found = write_shared(_compare(placed, threshold, block_rows), "links")
    groups = connected_groups(found.select(F.col("node").alias("key"), "root"))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))

    nodes = distinct.select("node", "copies", "name").join(linked, "node", "left").join(
        groups.withColumnRenamed("key", "node"), "node", "left"
    )
    nodes = write_shared(nodes.withColumn("group_id", F.coalesce("group_id", "node")), "nodes")
    # one component may hold most vectors, and one vector most rows
    least = write_shared(nodes.groupBy("group_id").agg(F.min("name").alias("least"), F.count("*").alias("n")), "components")
    hot = hot_keys(least, ["group_id"], hot_rows)
    nodes = salted_join(nodes.drop("name"), least.select("group_id", "least"), ["group_id"], hot, F.col("node"))
    nodes = nodes.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    repeated = distinct.filter("copies > 1").select("_label", "vec", F.col("node").alias("_first")).hint("merge")
    keys = usable.join(repeated, ["_label", "vec"], "left").select(ROW, "_id", F.coalesce("_first", ROW).alias("node"))
    alone = rows.filter("vec IS NULL").select(ROW, "_id", F.lit(0).cast("long").alias("n_links"), name.alias("least"))
    often = hot_keys(distinct.select("node", F.col("copies").alias("n")), ["node"], hot_rows)
    named = salted_join(keys, nodes, ["node"], often, F.col(ROW)).select(ROW, "_id", "n_links", "least").unionAll(alone)
    result = named.select(
        ROW,
        F.col("_id").alias(id_col),
        "n_links",
        F.col("least._id").alias("component_id"),
        (F.col(ROW) == F.col(f"least.{ROW}")).alias("kept"),
    )
    return result if ROW in vectors.columns else result.drop(ROW)
