import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from helpers import VECTORS, components, planted, scores, vector_rows
from pyspark.sql import functions as F

from framesift.operators import duplicates, lsh, near_duplicates
from framesift.operators.components import connected_groups
from framesift.operators.skew import hot_keys, salted_join


def brute_pairs(matrix, threshold):
    """Pairs of distinct vectors, each under its lowest key."""
    lowest = {}
    for i, row in enumerate(matrix):
        lowest.setdefault(row.tobytes(), i)
    kept = sorted(lowest.values())
    table = scores(matrix[kept], matrix[kept])
    return {
        (kept[a], kept[b]): table[a, b]
        for a, b in itertools.combinations(range(len(kept)), 2)
        if table[a, b] >= threshold
    }


def brute_groups(matrix, threshold):
    table = scores(matrix, matrix)
    return components([(a, b) for a, b in zip(*np.nonzero(table >= threshold)) if a < b])


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.999])
@pytest.mark.parametrize("block_rows", [8192, 25])
def test_pairs_equal_brute_force(spark, threshold, block_rows):
    matrix = planted()
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS).repartition(4)
    got = near_duplicates.near_duplicate_pairs(frame, "key", "vec", threshold, block_rows=block_rows).collect()
    want = brute_pairs(matrix, threshold)
    assert len(got) == len({(r.key_a, r.key_b) for r in got})
    assert {(r.key_a, r.key_b) for r in got} == set(want)
    assert all(abs(r.score - want[r.key_a, r.key_b]) < 2e-6 for r in got)


@pytest.mark.parametrize("threshold", [0.3, 0.9])
@pytest.mark.parametrize("block_rows", [8192, 25])
def test_groups_equal_brute_force(spark, threshold, block_rows):
    matrix = planted(seed=8)
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS).repartition(4)
    groups = duplicates.near_duplicate_groups(frame, "key", "vec", threshold, block_rows=block_rows)
    assert {r.key: r.group_id for r in groups.collect()} == brute_groups(matrix, threshold)


def test_links_of_a_dense_cluster_are_linear(spark):
    rng = np.random.default_rng(1)
    matrix = (np.ones(16) + 0.01 * rng.normal(size=(600, 16))).astype(np.float32)
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    links = near_duplicates.near_duplicate_links(frame, "key", "vec", 0.95, block_rows=50)
    count = links.count()
    assert 599 <= count < 600 * 25  # all pairs would be 179700
    groups = connected_groups(links)
    assert groups.count() == 600 and groups.select("group_id").distinct().count() == 1


@pytest.mark.parametrize("threshold, cells", [(0.95, 2), (0.6, 3), (0.99, 1)])
def test_cells_within_cells(spark, threshold, cells):
    """Few pivots for many rows: large cells get pivots of their own, and no pair is lost or found twice."""
    matrix = planted(spread=0.05, groups=16, copies=12, noise=150)
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    options = {"block_rows": 12, "most_cells": cells, "split_blocks": 2}
    want = brute_pairs(matrix, threshold)
    got = [((r.key_a, r.key_b), r.score) for r in near_duplicates.near_duplicate_pairs(frame, "key", "vec", threshold, **options).collect()]
    assert len(got) == len(want) and dict(got) == dict(want)
    whole = components(zip(*np.nonzero(np.triu(scores(matrix, matrix) >= threshold, 1))))
    groups = duplicates.near_duplicate_groups(frame, "key", "vec", threshold, **options)
    assert {r.key: r.group_id for r in groups.collect()} == whole


def test_finer_cells_are_bounded(spark):
    """With a bound on the pivots, cells grow with the rows; those cut again do not."""
    rng = np.random.default_rng(3)
    largest = []
    for n in (400, 1600):
        vectors = spark.createDataFrame(vector_rows(rng.normal(size=(n, 8))), VECTORS)
        rows = near_duplicates._assign(vectors, np.array([[1.0] * 8, [-1.0] * 8]), 0.999, "bigint", False, False)
        large = rows.groupBy("cell").count().withColumnRenamed("count", "n")
        finer = near_duplicates._assign_again(rows, large, 0.999, 20, 8).groupBy("cell").count()
        largest.append(max(r["count"] for r in finer.collect()))
        assert max(r.n for r in large.collect()) > n / 3
    assert largest[1] < 2.5 * largest[0]


def test_shifted_vectors_are_found(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(50, 64))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shifted = matrix + rng.choice([-0.005, 0.005], size=matrix.shape)
    rows = vector_rows(matrix) + vector_rows(shifted, first=1000) + [(5000, [0.0] * 64), (5001, None), (5002, [1.0])]
    frame = spark.createDataFrame(rows, VECTORS)
    got = {(r.key_a, r.key_b) for r in near_duplicates.near_duplicate_pairs(frame, "key", "vec", 0.95, dim=64).collect()}
    assert got == {(i, 1000 + i) for i in range(50)}
    pairs = lsh.near_duplicate_pairs_lsh(frame.filter("size(vec) = 64"), "key", "vec", 0.95)
    found = {(r.key_a, r.key_b) for r in pairs.collect()}
    assert found <= got and len(found) >= 45


def test_lsh_splits_hot_buckets(spark):
    matrix = planted()
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    want = brute_pairs(matrix, 0.99)
    got = lsh.near_duplicate_pairs_lsh(
        frame, "key", "vec", 0.99, bits=1, bands=4, block_rows=20
    ).collect()  # two buckets a band: both hot
    found = {(r.key_a, r.key_b) for r in got}
    assert len(found) == len(got)
    assert found <= set(want) and len(found) >= 0.95 * len(want)


def test_lsh_bands_are_small(spark, sf):
    """On vectors without structure no bucket holds more than a small share, and few pairs are compared."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS key", "embedding AS vec")
    n = vectors.count()
    bits, bands = lsh.band_plan(n, 0.95)
    sizes = [r["count"] for r in lsh.band_rows(vectors, bits, bands, 7).groupBy("cell").count().collect()]
    assert max(sizes) < 0.1 * n and sum(s * (s - 1) / 2 for s in sizes) < 0.2 * n * (n - 1) / 2
    same = 1 - np.arccos(0.95) / np.pi
    for rows in (10, 10**4, 10**9):
        bits, bands = lsh.band_plan(rows, 0.95)
        assert 1 - (1 - same**bits) ** bands >= lsh.RECALL
    assert lsh.band_plan(10**9, 0.95)[0] > lsh.band_plan(10**3, 0.95)[0]


def pairs_at(cosines, dim=64, seed=11):
    """A vector and one at just this cosine to it, for each of ``cosines``; pairs are unrelated."""
    rng = np.random.default_rng(seed)
    rows = []
    for cosine in cosines:
        a, b = rng.normal(size=(2, dim))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        rows += [a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)]
    return np.array(rows)


@pytest.mark.parametrize("threshold", [0.9, 0.95])
def test_lsh_recall_at_the_threshold(spark, threshold):
    """Nearly all pairs that are barely close enough are found, as pairs and as groups."""
    matrix = pairs_at([threshold + 2e-6] * 300)
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    want = {(2 * i, 2 * i + 1) for i in range(300)}
    found = {(r.key_a, r.key_b) for r in lsh.near_duplicate_pairs_lsh(frame, "key", "vec", threshold).collect()}
    assert len(found & want) >= 0.97 * len(want)
    groups = {r.key: r.group_id for r in lsh.near_duplicate_groups_lsh(frame, "key", "vec", threshold).collect()}
    assert sum(groups.get(b) == a for a, b in want) >= 0.97 * len(want)
    below = spark.createDataFrame(vector_rows(pairs_at([threshold - 1e-4] * 100)), VECTORS)
    assert lsh.near_duplicate_links_lsh(below, "key", "vec", threshold).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot_rows": 20, "block_rows": 25}, {"bits": 2, "bands": 6}])
def test_lsh_groups(spark, options):
    """Clusters, a hot vector and chains: the groups of brute force, from links linear in the rows."""
    matrix = planted(spread=0.03)
    frame = spark.createDataFrame(vector_rows(matrix) + [(9000, None), (9001, [0.0] * 16)], VECTORS)
    want = components(zip(*np.nonzero(np.triu(scores(matrix, matrix) >= 0.98, 1))))
    links = lsh.near_duplicate_links_lsh(frame, "key", "vec", 0.98, dim=16, **options)
    assert links.count() < 3 * len(matrix)
    assert {r.key: r.group_id for r in connected_groups(links).collect()} == want


def test_candidates_carry_no_vectors(spark):
    vectors = spark.createDataFrame(vector_rows(planted()), VECTORS)
    assert lsh.band_rows(vectors, 8, 5, 7).columns == ["cell", "key", "sketch"]


def test_vectors_are_fetched_for_survivors_only(spark, monkeypatch):
    """Unrelated rows share buckets, but hardly one of them has its vector fetched."""
    rng = np.random.default_rng(4)
    matrix = np.concatenate([rng.normal(size=(400, 64)), pairs_at([0.99] * 10)])
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    checked = []
    plain = lsh.verified
    monkeypatch.setattr(lsh, "verified", lambda pairs, *rest: checked.append(pairs.count()) or plain(pairs, *rest))
    links = lsh.near_duplicate_links_lsh(frame, "key", "vec", 0.95, bits=4, bands=30)
    assert {(r.key, r.root) for r in links.collect()} == {(401 + 2 * i, 400 + 2 * i) for i in range(10)}
    assert sum(checked) < 0.01 * 420 * 419 / 2  # nearly all pairs share a bucket somewhere


def test_sketch_limit():
    assert lsh.sketch_limit(1.0) == 0 and 10 < lsh.sketch_limit(0.95) < lsh.sketch_limit(0.9) < 32


def test_links_read_the_table_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(vector_rows(planted()), VECTORS)
    groups = duplicates.near_duplicate_groups(rows.mapInArrow(counted, VECTORS), "key", "vec", 0.9, block_rows=25)
    assert groups.count() and runs.value == rows.count()


def test_negative_zero_is_a_copy(spark):
    frame = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [-0.0, 1.0]), ("c", [1.0, 0.0])], "key string, vec array<float>")
    groups = duplicates.near_duplicate_groups(frame, "key", "vec", 0.95)
    assert {(r.key, r.group_id) for r in groups.collect()} == {("a", "a"), ("b", "a")}


def test_empty_and_wrong_threshold(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert near_duplicates.near_duplicate_pairs(frame, "key", "vec", 0.9).count() == 0
    assert lsh.near_duplicate_pairs_lsh(frame, "key", "vec", 0.9).count() == 0
    assert lsh.near_duplicate_groups_lsh(frame, "key", "vec", 0.9).count() == 0
    assert duplicates.near_duplicate_groups(frame, "key", "vec", 0.9).count() == 0
    with pytest.raises(ValueError):
        near_duplicates.near_duplicate_pairs(frame, "key", "vec", 1.5)


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_connected_groups(spark, hot_rows):
    rng = np.random.default_rng(6)
    chain = [(i, i + 1) for i in rng.permutation(120).tolist()]
    hub = [(500, 600 + i) for i in range(100)] + [(999, 600 + i) for i in range(100)]
    loose = [(int(a), int(b)) for a, b in rng.integers(2000, 2200, size=(80, 2))]
    links = chain + hub + loose
    frame = spark.createDataFrame(links, "key bigint, root bigint").repartition(3)
    got = {r.key: r.group_id for r in connected_groups(frame, hot_rows=hot_rows).collect()}
    want = components([(a, b) for a, b in links if a != b])
    assert got == want


def test_salted_join(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    hot = hot_keys(groups, ["k"], 100)
    assert [(h.k, h.pieces) for h in hot] == [(0, 9)]
    for how in ("inner", "left"):
        joined = salted_join(rows, groups.drop("n"), ["k"], hot, F.col("id"), how)
        assert joined.count() == 1000 and joined.filter("low <> k").count() == 0


def test_unreadable_contents_are_no_copies(spark):
    files = spark.createDataFrame([("a", None), ("b", None), ("c", b"x"), ("d", b"x")], "path string, content binary")
    groups = duplicates.exact_duplicate_groups(files, "path", F.col("content"), F.length("content"))
    assert [(r.first_key, r.copies) for r in groups.collect()] == [("c", 2)]


def test_rows_of_unknown_size_are_not_preferred(spark):
    members = spark.createDataFrame([("a", "g", None), ("b", "g", 500), ("c", "g", 900)], "key string, group_id string, size_bytes bigint")
    for descending, want in ((True, "c"), (False, "b")):
        kept = duplicates.keep_one(members, ["size_bytes"], [descending]).filter("kept").collect()
        assert [r.key for r in kept] == [want]


CONTENTS = [("c", b"x"), ("a", b"x"), ("b", b"yy"), ("d", b"x"), ("e", b"zz"), ("f", b"zz"), ("g", None)]


def test_exact_duplicates(spark):
    files = spark.createDataFrame(CONTENTS, "path string, content binary")
    groups = duplicates.exact_duplicate_groups(files, "path", F.col("content"), F.length("content"))
    found = {(r.copies, r.first_key, r.redundant_bytes) for r in groups.collect()}
    assert {(3, "a", 2), (2, "e", 2)} <= found
    members = duplicates.exact_duplicate_members(files, "path", F.col("content"))
    assert {(r.key, r.group_id) for r in members.collect()} == {("a", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e")}


def test_one_content_holds_a_third(spark):
    rows = [(f"k{i:04d}", b"hot" if i % 3 == 0 else b"%d" % (i // 2)) for i in range(600)]
    files = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    lowest, counts = {}, {}
    for key, content in rows:
        lowest[content] = min(key, lowest.get(content, key))
        counts[content] = counts.get(content, 0) + 1
    want = {(k, lowest[c]) for k, c in rows if counts[c] > 1}
    members = duplicates.exact_duplicate_members(files, "path", F.col("content"), hot_rows=30)
    assert {(r.key, r.group_id) for r in members.collect()} == want
    decided = duplicates.keep_one(members, hot_rows=30)
    assert {r.key for r in decided.filter("kept").collect()} == {g for _, g in want}
    assert decided.count() == len(want)


def test_mixed_lengths_need_a_dimension(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 4.1])], VECTORS)
    with pytest.raises(PySparkException):
        near_duplicates.near_duplicate_pairs(frame, "key", "vec", 0.9).collect()
    pairs = near_duplicates.near_duplicate_pairs(frame, "key", "vec", 0.9, dim=2).collect()
    assert [(r.key_a, r.key_b) for r in pairs] == [(1, 4)]


def test_keep_one_and_savings(spark):
    rows = [("a", "g", 5, "x"), ("b", "g", 9, "x"), ("c", "g", 9, "y"), ("d", "h", 1, "y"), ("e", "h", 1, "y")]
    members = spark.createDataFrame(rows, "key string, group_id string, size_bytes bigint, folder string")
    largest = duplicates.keep_one(members, ["size_bytes"], [True])
    assert {r.key for r in largest.filter("kept").collect()} == {"b", "d"}
    smallest = duplicates.keep_one(members, [F.col("size_bytes")])
    assert {r.key for r in smallest.filter("kept").collect()} == {"a", "d"}
    lowest = duplicates.keep_one(members)
    assert {r.key for r in lowest.filter("kept").collect()} == {"a", "d"}
    report = {(r.folder, r.grouped_files, r.dropped_files, r.saved_bytes) for r in duplicates.savings_report(largest).collect()}
    assert report == {("x", 2, 1, 5), ("y", 3, 2, 10)}
    images = spark.createDataFrame([(k,) for k in "abcdez"], "file_path string")
    kept = duplicates.without_dropped(images, largest, "file_path")
    assert sorted(r.file_path for r in kept.collect()) == ["b", "d", "z"]


@pytest.mark.parametrize("options", [{}, {"most_cells": 4, "split_blocks": 2}])
def test_copies_follow_the_rows(spark, monkeypatch, options):
    """Unrelated vectors in small blocks: cells are made fewer, so no row is copied for a share of all others."""
    from framesift.operators import blocks

    monkeypatch.setattr(blocks, "FREE_BYTES", 0)
    matrix = np.random.default_rng(5).normal(size=(1500, 24))
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    copied, plain = [], blocks.compare_blocks

    def counted(rows, sizes, *rest, **named):
        copied.append((rows.count(), sizes.agg({"n": "max"}).first()[0], rest[3]))
        return plain(rows, sizes, *rest, **named)

    monkeypatch.setattr(blocks, "compare_blocks", counted)
    found = near_duplicates.near_duplicate_pairs(frame, "key", "vec", 0.5, block_rows=8, **options).collect()
    table = scores(matrix.astype(np.float32), matrix.astype(np.float32))
    expected = {(i, j) for i, j in zip(*np.nonzero(table >= 0.5)) if i < j}
    assert {(r.key_a, r.key_b) for r in found} == expected and expected
    assert sum(rows for rows, _, _ in copied) <= 2 * blocks.COPIES * len(matrix)
    assert all(block_rows >= len(matrix) // blocks.COPIES for _, _, block_rows in copied)


def test_codes_are_made_some_rows_at_a_time(spark):
    """However many planes there are, one product holds a bounded number of entries."""
    from unittest.mock import MagicMock

    import pyarrow as pa

    from framesift.operators import blocks

    matrix = np.random.default_rng(5).normal(size=(3000, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(3000)), "vec": pa.array(list(matrix), pa.list_(pa.float32()))})
    frame = MagicMock()
    frame.schema["key"].dataType.simpleString.return_value = "bigint"
    lsh.band_rows(frame, 20, 50, 7)
    run = frame.select.return_value.mapInArrow.call_args[0][0]
    made = list(run(iter([batch])))
    assert max(part.num_rows for part in made) * (20 * 50 + lsh.SKETCH_BITS) <= blocks.MATRIX_ENTRIES
    assert [k for part in made for k in part["key"].to_pylist()] == list(range(3000))


@pytest.mark.parametrize("budget", [None, 24 * 4 * 40])
def test_rows_that_no_cell_keeps_apart_are_shuffled_once(spark, monkeypatch, budget):
    """Unrelated vectors: blocks are written once and their product compared, so no row is copied for a cell or a block."""
    from framesift.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 50)
    if budget:
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", budget)  # more blocks, of 40 rows
    monkeypatch.setattr(blocks, "compare_blocks", None)
    matrix = np.random.default_rng(5).normal(size=(300, 24))
    matrix[200:220] = matrix[:20] + 0.01
    frame = spark.createDataFrame(vector_rows(matrix), VECTORS)
    want = brute_pairs(matrix.astype(np.float32), 0.7)
    got = near_duplicates.near_duplicate_pairs(frame, "key", "vec", 0.7, block_rows=50).collect()
    assert len(got) == len(want) > 20 and {(r.key_a, r.key_b) for r in got} == set(want)
    groups = duplicates.near_duplicate_groups(frame, "key", "vec", 0.7, block_rows=50)
    assert {r.key: r.group_id for r in groups.collect()} == components(want)


def test_cells_that_prune_or_link_are_kept():
    rng = np.random.default_rng(6)
    corners = np.repeat(np.eye(16), 20, axis=0) + 0.1 * rng.normal(size=(320, 16))
    corners /= np.linalg.norm(corners, axis=1, keepdims=True)
    loose = rng.normal(size=(320, 16))
    loose /= np.linalg.norm(loose, axis=1, keepdims=True)
    assert not near_duplicates._prunes_nothing(corners, np.eye(16), 0.99)  # clusters prune
    assert not near_duplicates._prunes_nothing(corners, np.eye(16), 0.7)  # pivots link their clusters
    assert near_duplicates._prunes_nothing(loose, loose[:16] @ np.linalg.qr(rng.normal(size=(16, 16)))[0], 0.9)


@pytest.mark.parametrize("same", [True, False])
def test_tiles_cover_all_pairs(monkeypatch, same):
    """Large blocks are compared in tiles of many rows, not in strips of a few rows and all columns."""
    from framesift.operators import blocks

    assert len({part.start for part, _ in near_duplicates._tiles(1000, 131072, False)}) < 10
    monkeypatch.setattr(near_duplicates, "TILE_COLUMNS", 7)
    monkeypatch.setattr(blocks, "MATRIX_ENTRIES", 21)
    left = np.random.default_rng(7).normal(size=(40, 5))
    right = left if same else np.random.default_rng(8).normal(size=(33, 5))
    found = [(int(a), int(b)) for i, j, _ in near_duplicates._hits(left, right, 0.2, same) for a, b in zip(i, j)]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(scores(left, right) >= 0.2)) if a < b or not same}
    assert len(found) == len(set(found)) and set(found) == want


def test_small_buckets_are_joined(spark, monkeypatch):
    """Only buckets of many rows become groups in Python; the pairs are those of all buckets, by roles."""
    rng = np.random.default_rng(9)
    rows = [(int(c), "n" if k % 3 else "c", int(k), int(rng.integers(0, 1 << 12))) for k in range(600) for c in rng.integers(1, 300, 2)]
    rows += [(0, "n" if k % 3 else "c", int(k), int(rng.integers(0, 1 << 12))) for k in range(90)]
    rows = list({(c, k): (c, r, k, s) for c, r, k, s in rows}.values())
    frame = spark.createDataFrame(rows + [(1, "n", None, 5)], "cell long, role string, key long, sketch long")
    frame = lsh.cut_lineage(frame.repartition(4))
    want = {
        (max(a[2], b[2]), min(a[2], b[2]))
        for a, b in itertools.combinations(rows, 2)
        if a[0] == b[0] and (a[1], b[1]) != ("c", "c") and (a[3] ^ b[3]).bit_count() <= 4
    }
    grouped, plain = [], lsh.B.compare_blocks
    monkeypatch.setattr(
        lsh.B, "compare_blocks", lambda rows, *rest, **named: grouped.append({r.cell for r in rows.collect()}) or plain(rows, *rest, **named)
    )
    rules = [("n", "n", 0), ("n", "c", 1)]
    for joined_rows, cells in ((50, [{0}]), (1000, [])):
        del grouped[:]
        pairs = [(r.key, r.other) for r in lsh._alike(frame, rules, 4, 30, joined_rows).collect()]
        assert len(pairs) == len(want) and set(pairs) == want and grouped == cells
