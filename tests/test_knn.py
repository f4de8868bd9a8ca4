import numpy as np
import pytest
from helpers import VECTORS, nearest, planted, vector_rows

from framesift.operators import knn
from framesift.operators.blocks import choose_pivots
from framesift.operators.knn import best_per_query, knn_join
from framesift.operators.labels import kmeans_clusters, label_vectors, nearest_label
from framesift.plans.stand_ins import HashEncoder


def answer(frame):
    return {(r.query_key, r["rank"]): (r.key, r.score) for r in frame.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for place, (key, score) in want.items():
        assert got[place][0] == key and abs(got[place][1] - score) <= 2e-6, (place, got[place], want[place])


SMALL = {"max_broadcast_bytes": 8 * 16 * 10, "block_rows": 40}


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("options", [{}, SMALL], ids=["broadcast", "cells"])
def test_equals_brute_force(spark, metric, options):
    matrix = planted()
    vectors = spark.createDataFrame(vector_rows(matrix), VECTORS).repartition(3)
    for exclude in (False, True):
        got = knn_join(vectors, vectors, 4, metric, exclude_self=exclude, **options)
        want = nearest(matrix, matrix, 4, metric, exclude)
        # Copies give many equal scores; rounding may order near-equal ones of
        # different formulas differently, so compare scores, and keys on ties by rule.
        result = answer(got)
        assert result.keys() == want.keys()
        for place in want:
            assert abs(result[place][1] - want[place][1]) <= 2e-6


@pytest.mark.parametrize("options", [{}, SMALL], ids=["broadcast", "cells"])
def test_keys_on_ties(spark, options):
    rng = np.random.default_rng(0)
    matrix = np.repeat(rng.integers(-3, 4, size=(20, 16)), 10, axis=0).astype(np.float32)
    matrix[:, 0] = 5
    vectors = spark.createDataFrame(vector_rows(matrix), VECTORS).repartition(5)
    same(answer(knn_join(vectors, vectors, 7, **options)), nearest(matrix, matrix, 7))


@pytest.mark.parametrize("options", [{}, SMALL], ids=["broadcast", "cells"])
def test_text_keys_and_other_queries(spark, options):
    rng = np.random.default_rng(9)
    matrix, asked = rng.normal(size=(150, 16)).astype(np.float32), rng.normal(size=(30, 16)).astype(np.float32)
    vectors = spark.createDataFrame(vector_rows(matrix, key=lambda i: f"v{i:04d}"), "key string, vec array<float>")
    queries = spark.createDataFrame(vector_rows(asked), VECTORS)
    got = answer(knn_join(queries, vectors, 3, **options))
    want = {place: (f"v{key:04d}", score) for place, (key, score) in nearest(asked, matrix, 3).items()}
    same(got, want)


@pytest.mark.parametrize("scale", [1, 30, 1000])
def test_distances_of_long_vectors(spark, scale):
    """Both ways give the distances by difference, to themselves 0, however long the vectors."""
    rng = np.random.default_rng(3)
    matrix = (scale * rng.normal(size=(120, 16)) / 4).astype(np.float32)
    matrix[60:] = matrix[:60] + np.float32(scale * 1e-6)
    vectors = spark.createDataFrame(vector_rows(matrix), VECTORS)
    exact = np.sqrt(((matrix[:, None].astype(float) - matrix[None].astype(float)) ** 2).sum(axis=2))
    exact = np.round(exact, 6)
    found = []
    for options in ({}, SMALL):
        found.append({(r.query_key, r["rank"]): (r.key, r.score) for r in knn_join(vectors, vectors, 3, "l2", **options).collect()})
        for q in range(120):
            order = np.lexsort((np.arange(120), exact[q]))[:3]
            assert [found[-1][q, n + 1] for n in range(3)] == [(i, exact[q, i]) for i in order.tolist()]
    assert found[0] == found[1]


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 1, "block_rows": 4}], ids=["broadcast", "cells"])
@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_unusable_vectors_are_left_out(spark, options, metric):
    rng = np.random.default_rng(1)
    good = vector_rows(rng.normal(size=(20, 4)).astype(np.float32))
    bad = [(100, [float("nan")] * 4), (101, None), (102, [0.0] * 4), (103, [1.0]), (104, [None, 1.0, 1.0, 1.0]), (105, [float("inf")] * 4)]
    clean = spark.createDataFrame(good, VECTORS)
    mixed = spark.createDataFrame(good + bad, VECTORS)
    assert answer(knn_join(mixed, mixed, 3, metric, dim=4, **options)) == answer(knn_join(clean, clean, 3, metric, **options))


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 1, "block_rows": 4}], ids=["broadcast", "cells"])
@pytest.mark.parametrize("kind", ["smallint", "date", "string"])
def test_key_types(spark, options, kind):
    keyed = "CAST(date_add(DATE'2020-01-01', key) AS date)" if kind == "date" else f"CAST(key AS {kind})"
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0, 0.0, 0.0]) for i in range(12)], "key int, vec array<float>")
    rows = rows.selectExpr(f"{keyed} AS key", "vec")
    got = knn_join(rows, rows, 1, **options)
    assert got.schema["key"].dataType == rows.schema["key"].dataType and got.filter("query_key = key").count() == 12


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 1, "block_rows": 2}], ids=["broadcast", "cells"])
def test_more_neighbours_than_rows(spark, options):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], VECTORS)
    assert knn_join(vectors, vectors, 10, **options).count() == 9
    assert knn_join(vectors.limit(0), vectors, 10, **options).count() == 0


def test_plan_has_no_cross_join(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS key", "embedding AS vec")
    for options in ({}, {"max_broadcast_bytes": 8 * 64 * 50, "block_rows": 100}):
        plan = knn_join(vectors, vectors, 5, **options)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "WindowGroupLimit" in plan


def test_pivots(spark):
    vectors = spark.createDataFrame(vector_rows(planted()), VECTORS)
    keys, matrix = choose_pivots(vectors, 20, vectors.count())
    assert 1 <= len(keys) <= 20 and matrix.shape == (len(keys), 16)
    assert keys == choose_pivots(vectors.repartition(7), 20, vectors.count())[0]
    assert len(choose_pivots(vectors, 1, 10**9)[0]) == 1


def test_best_per_query():
    queries = np.array([0, 0, 0, 1, 1])
    kept = best_per_query(queries, np.array(["b", "a", "c", "x", "y"], dtype=object), np.array([1.0, 1.0, 2.0, 0.0, 1.0]), 2)
    assert [(queries[i], i) for i in kept] == [(0, 2), (0, 1), (1, 4), (1, 3)]


@pytest.mark.parametrize("budget", [10**6, 8 * 16 * 3], ids=["broadcast", "join"])
def test_nearest_label(spark, budget):
    matrix = planted(dim=16)
    table = spark.createDataFrame(vector_rows(matrix), VECTORS)
    texts = ["Maize", "Sugarcane", "Wheat", "Rice", "Jute"]
    labels = label_vectors(table, texts, lambda: HashEncoder(16))
    prototypes = np.array(HashEncoder(16).encode_text(sorted(texts)))
    got = {r.key: (r.label, r.score) for r in nearest_label(table, "key", "vec", labels, max_broadcast_bytes=budget).collect()}
    want = nearest(matrix, prototypes, 1)
    assert len(got) == len(matrix)
    for q in got:
        index, score = want[q, 1]
        assert got[q][0] == sorted(texts)[index] and abs(got[q][1] - score) < 2e-6


def test_kmeans_finds_planted_clusters(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(8)[:3] * 5
    matrix = np.array([centres[i % 3] + 0.05 * rng.normal(size=8) for i in range(90)])
    table = spark.createDataFrame(vector_rows(matrix) + [(1000, [0.0] * 8), (1001, None)], VECTORS)
    got = {r.key: r.cluster for r in kmeans_clusters(table, "key", "vec", 3).collect()}
    assert len(got) == 90
    assert len({(i % 3, c) for i, c in got.items()}) == 3


def test_rows_shuffled_are_bounded(spark, monkeypatch):
    """However many partitions the vectors have, no more tasks than `search_tasks` return rows."""
    from framesift.operators import knn

    rng = np.random.default_rng(5)
    matrix, queries = rng.normal(size=(600, 8)), rng.normal(size=(4, 8))
    vectors = spark.createDataFrame(vector_rows(matrix), VECTORS).repartition(60)
    asked = spark.createDataFrame(vector_rows(queries), VECTORS)
    monkeypatch.setattr(knn, "search_tasks", lambda spark: 3)
    returned, plain = [], knn._knn_by_broadcast

    def counted(*args):
        scored = plain(*args)
        returned.append(scored.count())
        return scored

    monkeypatch.setattr(knn, "_knn_by_broadcast", counted)
    got = {(r.query_key, r.rank): (r.key, r.score) for r in knn.knn_join(asked, vectors, 5).collect()}
    assert returned == [3 * 4 * 5] and got == nearest(queries, matrix, 5)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_copies_follow_the_rows(spark, monkeypatch, metric):
    """Unrelated vectors in small blocks: cells are made fewer, so no query is copied for a share of all rows."""
    monkeypatch.setattr(knn.B, "FREE_BYTES", 0)
    matrix = np.random.default_rng(5).normal(size=(1200, 24))
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    copied, plain = [], knn.B.compare_blocks

    def counted(rows, *rest, **named):
        copied.append((rows.count(), rest[4]))
        return plain(rows, *rest, **named)

    monkeypatch.setattr(knn.B, "compare_blocks", counted)
    got = knn.knn_join(frame, frame, 3, metric, dim=24, block_rows=8, max_broadcast_bytes=1).collect()
    expected = nearest(matrix.astype(np.float32), matrix.astype(np.float32), 3, metric)
    assert {(r.query_key, r["rank"]): r.key for r in got} == {place: key for place, (key, _) in expected.items()}
    ((rows, block_rows),) = copied
    assert rows <= (knn.B.COPIES + 2) * len(matrix) and block_rows >= len(matrix) // knn.B.COPIES
