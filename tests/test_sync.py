import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framesift.plans.stand_ins import HashEncoder
from framesift.operators import changes, embed, index
from framesift.operators.keys import filter_by_keys
from framesift.sources import image_files, tables
from framesift.streaming.files import sync_files
from framesift.streaming.sync import arriving_rows, sync_index

ROWS = "file_path string, embeddings array<float>"


def test_changes_compare_values(spark):
    schema = "k string, a string, b int"
    old = spark.createDataFrame([("same", "x", 1), ("null", None, 1), ("gone", "x", 1), ("edit", "x", 1), ("both", None, None)], schema)
    new = spark.createDataFrame([("same", "x", 1), ("null", "", 1), ("new", "x", 1), ("edit", "x", None), ("both", None, None)], schema)
    feed = changes.snapshot_changes(old, new, "k", ["a", "b"])
    assert {(r.k, r.change) for r in feed.collect()} == {
        ("null", "update"),
        ("gone", "delete"),
        ("new", "insert"),
        ("edit", "update"),
    }
    fresh = changes.rows_to_write(new, feed, "k")
    assert {r.k for r in fresh.collect()} == {"null", "new", "edit"}
    after = changes.apply_changes(old, fresh, feed, "k")
    assert sorted(map(str, after.collect())) == sorted(map(str, new.collect()))


@pytest.mark.parametrize("limit", [10**6, 1], ids=["sent", "joined"])
def test_filter_by_keys(spark, limit):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int").repartition(2)
    keys = spark.createDataFrame([("b",), ("b",), ("z",)], "k string")
    assert [r.v for r in filter_by_keys(rows, keys, "k", True, limit).collect()] == [2]
    assert sorted(r.v for r in filter_by_keys(rows, keys, "k", False, limit).collect()) == [1, 3]


def test_digest_has_no_seams(spark):
    schema = "k int, a string, b string"
    old = spark.createDataFrame([(1, "ab", "c"), (2, "-", None)], schema)
    new = spark.createDataFrame([(1, "a", "bc"), (2, None, "-")], schema)
    feed = changes.snapshot_changes(old, new, "k", ["a", "b"])
    assert {(r.k, r.change) for r in feed.collect()} == {(1, "update"), (2, "update")}


def test_vectors_in_the_payload(spark):
    old = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], ROWS)
    new = spark.createDataFrame([("a", [1.0, 2.5]), ("b", None)], ROWS)
    feed = changes.snapshot_changes(old, new, "file_path", ["embeddings"])
    assert [(r.file_path, r.change) for r in feed.collect()] == [("a", "update")]


def test_sync_reads_only_new_files(spark, tmp_path):
    source, built, progress = (str(tmp_path / name) for name in ("source", "index", "progress"))
    first = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 0.0])], ROWS)
    first.write.parquet(source)

    def run():
        arriving = arriving_rows(spark, source, first.schema, files_per_batch=1)
        return sync_index(arriving, built, progress, "file_path", "embeddings", 2)

    assert {(r.file_path, r.norm) for r in run().collect()} == {("a", 1.0)}
    spark.createDataFrame([("e", [3.0, 4.0])], ROWS).write.mode("append").parquet(source)
    assert {(r.file_path, r.norm) for r in run().collect()} == {("a", 1.0), ("e", 5.0)}
    assert run().count() == 2


def test_sync_replaces_and_deletes(spark, tmp_path):
    source, built, progress = (str(tmp_path / name) for name in ("source", "index", "progress"))
    schema = "file_path string, embeddings array<float>, at int, gone boolean"

    def run(*rows):
        frame = spark.createDataFrame(list(rows), schema)
        frame.coalesce(1).write.mode("append").parquet(source)
        arriving = arriving_rows(spark, source, frame.schema)
        synced = sync_index(arriving, built, progress, "file_path", "embeddings", 2, newest="at", deleted="gone")
        return sorted((r.file_path, r.embeddings) for r in synced.collect())

    assert run(("a", [1.0, 0.0], 1, False), ("b", [1.0, 0.0], 1, None), ("b", [2.0, 0.0], 2, None)) == [("a", [1.0, 0.0]), ("b", [2.0, 0.0])]
    assert run(("a", [0.0, 5.0], 3, False), ("b", None, 3, True), ("c", [1.0, 1.0], 3, False)) == [("a", [0.0, 5.0]), ("c", [1.0, 1.0])]
    assert run(("b", [3.0, 3.0], 4, False), ("c", None, 4, False), ("d", [0.0, 0.0], 4, False)) == [("a", [0.0, 5.0]), ("b", [3.0, 3.0])]
    again = spark.read.parquet(built)
    assert again.count() == 8  # the log keeps what was written; readers take the last


def test_sync_of_one_file_and_of_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "id int, v array<float>").repartition(5)
    rows.write.parquet(str(tmp_path / "table.parquet"))
    pandas = rows.toPandas()
    pandas.to_parquet(tmp_path / "one.parquet")
    for name in ("table.parquet", "one.parquet"):
        arriving = arriving_rows(spark, f"{tmp_path}/{name}", rows.schema)
        assert sync_index(arriving, f"{tmp_path}/i-{name}", f"{tmp_path}/p-{name}", "id", "v", 2).count() == 50


def test_sync_of_nothing_fails(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    arriving = arriving_rows(spark, str(tmp_path / "empty"), spark.createDataFrame([], "id int, v array<float>").schema)
    with pytest.raises(FileNotFoundError):
        sync_index(arriving, str(tmp_path / "i"), str(tmp_path / "p"), "id", "v", 2)


def test_one_row_per_key_breaks_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "x"), ("b", None, "x"), ("c", 1, None)]
    schema = "key string, at int, value string"
    found = []
    for parts in (1, 3, 5):
        frame = spark.createDataFrame(rows, schema).repartition(parts)
        found.append(sorted(map(str, index.one_row_per_key(frame, "key", "at").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    assert index.one_row_per_key(spark.createDataFrame(rows, schema), "key").count() == 3


def test_failed_embeddings_are_pending(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    done = spark.createDataFrame([("a", [1.0]), ("b", None)], "file_path string, embeddings array<float>")
    for limit in (10**6, 1):
        pending = embed.not_yet_embedded(images, done, limit=limit, vector="embeddings")
        assert sorted(r.file_path for r in pending.collect()) == ["b", "c"]


def test_sync_embeds_on_the_way(spark, tmp_path):
    source = str(tmp_path / "source")
    texts = spark.createDataFrame([("a", "x"), ("b", None)], "file_path string, text string")
    texts.write.parquet(source)
    synced = sync_index(
        arriving_rows(spark, source, texts.schema),
        str(tmp_path / "index"),
        str(tmp_path / "progress"),
        "file_path",
        "embeddings",
        64,
        embed=lambda rows: embed.embed_texts(rows, HashEncoder, "text"),
    )
    assert [(r.file_path, r.text, len(r.embeddings)) for r in synced.collect()] == [("a", "x", 64)]


def test_index_table(spark):
    rows = [("a", "f", [3.0, 4.0]), ("b", "f", None), ("c", "g", [1.0]), ("d", "g", [0.0, 0.0])]
    source = spark.createDataFrame(rows, "file_path string, folder string, embeddings array<float>")
    tables.save_table(source, "vectors_source")
    made = []

    def create():
        made.append(1)
        return index.create_index(spark, "vectors_source", "vectors_index", "file_path", "embeddings", 2)

    assert not index.is_ready(spark, "vectors_index")
    for _ in range(2):
        table = index.get_or_create_index(spark, "vectors_index", create)
        assert [(r.file_path, r.folder, r.norm) for r in table.collect()] == [("a", "f", 5.0)]
    assert made == [1] and index.is_ready(spark, "vectors_index")
    with pytest.raises(PySparkException):
        create()

    def broken():
        raise RuntimeError("not a missing table")

    with pytest.raises(RuntimeError):
        index.get_or_create_index(spark, "other_index", broken)
    report = index.profile(source, "file_path", "embeddings", 2, table.limit(0)).first()
    assert report.asDict() == {
        "total_rows": 4,
        "null_vectors": 1,
        "wrong_dimension": 1,
        "searchable": 1,
        "not_synced": 1,
    }
    assert index.profile(source, "file_path", "embeddings", 2, table).first().not_synced == 0
    assert "not_synced" not in index.profile(source, "file_path", "embeddings", 2).columns
    index.delete_index(spark, "vectors_index")
    assert not spark.catalog.tableExists("vectors_index")
    tables.drop_table(spark, "vectors_source")


def test_keys(spark):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k int, at int, v string")
    assert {(r.k, r.at, r.v) for r in index.one_row_per_key(rows, "k", "at").collect()} == {(1, 2, "new"), (2, 1, "only")}
    assert [(r.k, r.rows) for r in index.duplicate_keys(rows, "k").collect()] == [(1, 2)]


def test_text_index(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    rows = index.text_index_rows(texts, "id", "text", lambda: HashEncoder(8), 8).select("id", F.size("embeddings"))
    assert [tuple(r) for r in rows.collect()] == [(1, 8)]


def test_sync_of_many_files(spark, tmp_path, monkeypatch):
    """The listing is not the driver's; what changed, went and came between two runs is taken in."""
    monkeypatch.setattr(image_files, "DRIVER_FILES", 1)
    load = type(spark.read).load
    root, listed = tmp_path / "crops", []

    def watched(self, path=None, *args, **options):
        listed.append(str(path))
        return load(self, path, *args, **options)

    monkeypatch.setattr(type(spark.read), "load", watched)
    (root / "deep").mkdir(parents=True)
    for n in range(12):
        (root / ("deep" if n % 2 else "") / f"{n}.jpg").write_bytes(b"x" * n)

    def run():
        found = sync_files(
            spark, str(root), str(tmp_path / "index"), str(tmp_path / "progress"), lambda rows: embed.embed_images(rows, HashEncoder, "image_base64"), 64
        )
        return {(r.folder, r.file_name, r.size_bytes, len(r.embeddings)) for r in found.collect()}

    expected = {("deep" if n % 2 else "", f"{n}.jpg", n, 64) for n in range(1, 12)}
    assert run() == expected
    (root / "2.jpg").unlink()
    (root / "4.jpg").write_bytes(b"changed")
    (root / "new.jpg").write_bytes(b"new")
    expected -= {("", "2.jpg", 2, 64), ("", "4.jpg", 4, 64)}
    assert run() == expected | {("", "4.jpg", 7, 64), ("", "new.jpg", 3, 64)}
    assert not [path for path in listed if str(root) in path]
