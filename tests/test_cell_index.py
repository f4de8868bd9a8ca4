import re

import numpy as np
import pytest

from helpers import vector_rows
from framesift.operators import cell_index, search

SCHEMA = "key long, vec array<float>"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Twelve clusters of vectors of different lengths, one of them with a third of all rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    sizes = [30] * 11 + [170]
    matrix = np.concatenate([c * rng.uniform(0.2, 4, (n, 1)) + 0.1 * rng.normal(size=(n, 16)) for c, n in zip(centres, sizes)])
    matrix = np.concatenate([matrix, np.repeat(matrix[:1], 5, axis=0)]).astype(np.float32)
    frame = spark.createDataFrame(vector_rows(matrix), SCHEMA).withColumn("label", cell_index.F.col("key") % 3)
    path = str(tmp_path_factory.mktemp("cells"))
    cell_index.write_cell_index(frame, path, "key", "vec", cells=12, file_rows=40)
    return frame, cell_index.read_cell_index(spark, path), matrix, path


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("filters", [None, {"label": [1]}, "key % 50 = 3"])
def test_equals_search_over_all(stored, metric, filters):
    frame, index, matrix, _ = stored
    for query in (matrix[3], matrix[200] * 3, -matrix[40], np.ones(16), np.eye(16)[2] * 9):
        asked = [float(x) for x in query]
        want = search.search(frame, asked, 7, "key", "vec", ["key", "label"], filters, metric).collect()
        assert cell_index.search_cells(index, asked, 7, "key", "vec", ["key", "label"], filters, metric).collect() == want


def test_fewer_partitions_are_read(spark, stored):
    _, index, matrix, _ = stored
    query = [float(x) for x in matrix[3]]
    found = cell_index.search_cells(index, query, 5, "key", "vec")
    cells = cell_index.cells_to_read(index, query, 5, "key", "vec")
    assert len(cells) <= 3 < len(index.numbers) == 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (IN|=)", plan)
    assert len(index.rows.filter(index.rows.cell.isin(cells)).inputFiles()) <= len(index.rows.inputFiles())
    exact = {r.key for r in found.collect()}
    probed = {r.key for r in cell_index.search_cells(index, query, 5, "key", "vec", probes=1).collect()}
    assert len(exact & probed) >= 4


def test_bounds_hold(stored):
    _, index, matrix, _ = stored
    cells = {r.key: r.cell for r in index.rows.collect()}
    rng = np.random.default_rng(1)
    for query in (*rng.normal(size=(20, 16)), matrix[9], -matrix[9]):
        for metric in ("cosine", "dot", "l2"):
            bound = dict(zip(index.numbers.tolist(), cell_index.cell_bounds(index, query, metric)))
            scores = {
                "cosine": matrix @ query / np.linalg.norm(matrix, axis=1) / np.linalg.norm(query),
                "dot": matrix @ query,
                "l2": -np.linalg.norm(matrix - query, axis=1),
            }[metric]
            assert all(round(float(s), 6) <= bound[cells[i]] for i, s in enumerate(scores))


def test_large_cells_are_several_files(stored):
    _, index, _, path = stored
    files = index.rows.inputFiles()
    by_cell = [sum(f"/cell={c}/" in f for f in files) for c in index.numbers.tolist()]
    assert max(by_cell) > 1 and all(n <= -(-count // 40) for n, count in zip(by_cell, index.counts))
    assert index.rows.count() == index.counts.sum()


def test_wrong_input(spark, stored, tmp_path):
    _, index, _, _ = stored
    with pytest.raises(ValueError):
        cell_index.search_cells(index, [], 3, "key", "vec")
    with pytest.raises(ValueError):
        cell_index.write_cell_index(spark.createDataFrame([], SCHEMA), str(tmp_path), "key", "vec")
