import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.llm import topk_search as topk

SCHEMA = "vec_id long, embedding array<float>, rank string, query string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k, every=50):
    """Sorted (query, rank, id, score); every row is its own, whatever its id."""
    whole = [(i, r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows) if usable(r[1])]
    found = []
    for i, q, a in whole:
        if q is None or q % every:
            continue
        hits = [(-sum(x * y for x, y in zip(a, b)), v is None, v or 0, j) for j, v, b in whole if j != i and len(a) == len(b)]
        for rank, (score, none, v, _) in enumerate(sorted(hits)[:k], 1):
            found.append((q, rank, None if none else v, -score))
    return sorted(found, key=str)


def got(frame, k=5, **options):
    rows = topk.top_k_search(frame, F.col("vec_id") % 50 == 0, k, **options).collect()
    return sorted([tuple(r) for r in rows], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    listed = [[float(x) for x in rng.normal(size=6)] for _ in range(300)]
    hot = listed[7]
    listed += [hot] * 200 + [[0.0] * 6] * 20
    order = rng.permutation(len(listed))
    made = [(int(i), listed[n], "clash", "clash") for i, n in enumerate(order)]
    odd = [None, [], [1.0, None] + [0.0] * 4, [float("nan")] * 6, [float("inf")] * 6, [1.0, 2.0], [2.0, 2.0]]
    made += [(50 * (20 + i), v, None, None) for i, v in enumerate(odd)]
    made += [(2000, hot, None, None), (2000, hot, None, None), (None, hot, None, None), (None, [9.0] * 6, None, None)]
    return made


@pytest.mark.parametrize("options", [{}, {"block_queries": 3}, {"k": 1}, {"k": 700}])
def test_equals_brute_force(spark, rows, options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(frame, **options) == brute(rows, options.get("k", 5))


@pytest.mark.parametrize("bits", [1, 3, 11])
def test_any_width_of_bins(spark, rows, bits):
    assert got(spark.createDataFrame(rows[:150], SCHEMA), bin_bits=bits) == brute(rows[:150], 5)


def test_whole_table(spark):
    from framesift.llm.queries import op13_topk_search

    sf = "/root/testdata/sf0.01"
    frame = pd.read_parquet(f"{sf}/embeddings.parquet")
    expected = brute(list(zip(frame.vec_id, frame.embedding)), 5)
    assert sorted([tuple(r) for r in op13_topk_search(spark, sf).collect()], key=str) == expected


def test_few_ties_held(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "HELD_TIES", 10)
    monkeypatch.setattr(topk, "MATRIX_ENTRIES", 64)
    block = topk._block(topk.keyed(spark.createDataFrame([(50, [1, 2])], "vec_id long, v array<long>"), "vec_id", vec="v"), 2, 10.0)
    block.low[:], block.needed[:] = 5, 2
    batch = pa.RecordBatch.from_pydict({"__row": [9, 4, 7, 50], "_id": [9, 4, 7, 50], "vec": [[1, 2]] * 4})
    names = ["query_row", "query_id", "vec_id", "score"]
    out = pa.Table.from_batches(list(topk._winners(block, names)([batch, batch.slice(0, 1)])))
    assert out["vec_id"].to_pylist() == [4, 7] and out["score"].to_pylist() == [5, 5]


def test_large_values_end_at_a_bound(spark):
    big = [3e37, -1.0]
    rows = [(50, big, None, None), (51, big, None, None), (52, [-3e37, 0.0], None, None), (53, [1.0, 1.0], None, None)]
    assert [(r[2], r[3]) for r in got(spark.createDataFrame(rows, SCHEMA))] == [
        (51, topk.MOST), (53, topk.MOST), (52, -topk.MOST)
    ]
    middle = [(50, [2.0**20, 1.0], None, None), (51, [2.0**20, 2.0], None, None)]
    assert got(spark.createDataFrame(middle, SCHEMA)) == brute(middle, 5)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (100, 1 << 25, 1 << 40):
        a, b = rng.integers(-size, size, (4, 5)), rng.integers(-size, size, (3, 5))
        exact = [[max(-topk.MOST, min(topk.MOST, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert topk.inner_products(a, b).tolist() == exact


def test_no_scores_are_shuffled(spark, rows):
    """A task's histogram has at most k bins a query, whatever its rows."""
    frame = spark.createDataFrame(rows, SCHEMA)
    vectors = topk.keyed(frame.filter("size(embedding) = 6 and vec_id < 520"), "vec_id", vec="embedding")
    vectors = vectors.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 256))).coalesce(1)
    block = topk._block(vectors.filter("_id % 50 = 0"), 5, 3000.0)
    counted = vectors.mapInArrow(topk._histograms(block), "query int, bin int, n long").collect()
    assert len(block.rows) == 11 and len(counted) <= 5 * len(block.rows)
    per_query = {}
    for r in counted:
        per_query[r["query"]] = per_query.get(r["query"], 0) + r["n"]
    assert all(n >= 5 for n in per_query.values()) and len(per_query) == 11


def test_empty(spark):
    empty = topk.top_k_search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0, 5)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0
    assert got(spark.createDataFrame([(50, [1.0], None, None)], SCHEMA)) == []


def test_string_ids(spark):
    frame = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [1.0])], "vec_id string, embedding array<double>")
    rows = topk.top_k_search(frame, F.col("vec_id") == "c", 1).collect()
    assert [tuple(r) for r in rows] == [("c", 1, "a", 65536)]
