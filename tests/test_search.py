import numpy as np
import pytest
from helpers import nearest
from pyspark.sql import functions as F

from framesift.plans.stand_ins import HashEncoder
from framesift.operators import search


def make(spark, n=200, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, dim)).astype(np.float32)
    folders = ["Rice", "price_list", "wheat", "", None]
    rows = [
        (f"/d/{i:04d}.{'jpg' if i % 3 else 'txt'}", f"{i:04d}", folders[i % 5], i, [float(x) for x in v])
        for i, v in enumerate(matrix)
    ]
    schema = "file_path string, file_name string, folder string, n int, embeddings array<float>"
    return spark.createDataFrame(rows, schema), matrix


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_equals_brute_force(spark, metric):
    table, matrix = make(spark)
    query = [float(x) for x in matrix[7] * 2]
    got = search.search(table, query, 20, "file_path", columns=["n"], metric=metric).orderBy("rank").collect()
    want = nearest([query], matrix, 20, metric)
    assert [(r["rank"], r.n, r.score) for r in got] == [(k, *want[0, k]) for k in range(1, 21)]


def test_ties_broken_rows_and_large_k(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0])]
    table = spark.createDataFrame(rows, "id int, embeddings array<float>")
    got = search.search(table, [1.0, 0.0], 50, "id").orderBy("rank").collect()
    assert [(r.id, r.score, r["rank"]) for r in got] == [(1, 1.0, 1), (3, 1.0, 2), (2, 0.0, 3)]


def test_filters(spark):
    table, _ = make(spark)
    query = [1.0] * 8

    def keys(filters):
        return sorted(r.n for r in search.search(table, query, 500, "file_path", columns=["n"], filters=filters).collect())

    assert keys({"n NOT": (0, 1)}) == list(range(2, 200))
    assert keys("n NOT IN (0, 1)") == list(range(2, 200))
    assert keys({"n": [5, 6]}) == [5, 6]
    assert keys({"n": 5}) == [5]
    assert keys({"n >=": 10, "n <": 12}) == [10, 11]
    assert keys(F.col("n") == 3) == [3]
    with pytest.raises(ValueError):
        keys({"n LIKE": "x"})


def test_filter_and_columns_reach_the_scan(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = search.search(table, [1.0] * 64, 5, "vec_id", "embedding", ["vec_id"], filters={"label": 3})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_text_is_bound(spark):
    table, _ = make(spark)
    vector = search.encode_query(table, lambda: HashEncoder(8), "it's a \"quote\"; DROP TABLE x")
    assert vector == pytest.approx([float(x) for x in HashEncoder(8).encode_text(["it's a \"quote\"; DROP TABLE x"])[0]])
    with pytest.raises(ValueError):
        search.encode_query(table, HashEncoder, "")


def test_search_flow(spark):
    table, matrix = make(spark)

    def encoder():
        return HashEncoder(8)

    free = search.search_images(table, encoder, "rice field").orderBy("rank").collect()
    assert len(free) == 50 and [r["rank"] for r in free] == list(range(1, 51))
    query = [float(x) for x in HashEncoder(8).encode_text(["rice field"])[0]]
    best = nearest([query], matrix, 200)
    order = [best[0, k][0] for k in range(1, 201)]
    matching = [n for n in order[:50] if n % 5 in (0, 1)]
    after = search.search_images(table, encoder, "rice field", ["RICE"]).orderBy("rank").collect()
    assert [int(r.file_name) for r in after] == matching[:12]
    short = search.search_images(table, encoder, "rice field", ["wheat"], depth=10).collect()
    assert len(short) == len([n for n in order[:10] if n % 5 == 2])
    before = search.search_images(table, encoder, "rice field", ["wheat"], depth=10, filter_first=True)
    first = before.orderBy("rank").collect()
    assert [int(r.file_name) for r in first] == [n for n in order if n % 5 == 2][:10]
    assert search.search_images(table, encoder, "rice field", ["maize"]).count() == 0


def test_results(spark):
    table, _ = make(spark)
    hits = search.search(table, [1.0] * 8, 9, "file_path", columns=["file_path", "file_name", "folder", "n"])
    shown = search.displayable(hits)
    assert {r.file_path[-3:] for r in shown.collect()} == {"jpg"}
    ranks = {r.file_path: r["rank"] for r in hits.collect()}
    assert all(ranks[r.file_path] == r["rank"] for r in shown.collect())
    rows = search.as_text_rows(hits).orderBy("Rank").collect()
    assert list(rows[0].asDict()) == ["Rank", "file_path", "file_name", "folder"]
    document = search.as_documents(hits, ["file_name", "folder", "n"]).filter("rank = 1").first().document
    top = hits.filter("rank = 1").first()
    assert document.page_content == top.file_name
    assert document.metadata == {"folder": top.folder, "n": str(top.n)}
    images = table.select("file_path", F.lit("bytes").alias("image_base64"))
    filled = search.with_content(hits, images, ["image_base64"])
    assert filled.count() == 9 and filled.select("image_base64").distinct().count() == 1


def test_like_and_smoke(spark):
    table, matrix = make(spark)
    like = search.search_like(table, "/d/0007.jpg", 5, "file_path", columns=["n"]).orderBy("rank").collect()
    want = nearest([matrix[7]], matrix, 6)
    assert [r.n for r in like] == [want[0, k][0] for k in range(2, 7)]
    with pytest.raises(ValueError):
        search.search_like(table, "/nowhere", 5, "file_path")
    check = search.smoke_check(table, "file_path").orderBy("rank").collect()
    assert len(check) == 3 and check[0].is_self and check[0].score == 1.0
