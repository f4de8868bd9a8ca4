import base64
import os
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framesift.functions import encoders
from framesift.functions.encoders import register_ai_query, text_encoder
from framesift.plans.stand_ins import HashEncoder, PatternTagger
from framesift.operators import embed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests


class Fragile:
    """Fails on "bad", returns nothing for "empty", and notes every call in a file."""

    dimension = 2

    def __init__(self, log=None):
        self.log = log

    def encode_text(self, texts):
        if self.log:
            with open(self.log, "a") as file:
                file.writelines(f"{t}\n" for t in texts)
        if "bad" in texts:
            raise RuntimeError("model failure")
        return [[] if t == "empty" else [float(len(t)), 1.0] for t in texts]

    def encode_image(self, images):
        if b"bad" in images:
            raise RuntimeError("model failure")
        return [[float(len(i)), 1.0] for i in images]


def texts(spark, values):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)], "id int, text string")


def test_null_policy(spark):
    rows = embed.embed_texts(texts(spark, ["aa", None, "bad", "empty", "c"]), Fragile, "text").orderBy("id").collect()
    assert [r.embeddings for r in rows] == [[2.0, 1.0], None, None, None, [1.0, 1.0]]


def test_fail_policy(spark):
    ok = embed.embed_texts(texts(spark, ["aa", None]), Fragile, "text", on_error="fail").orderBy("id").collect()
    assert [r.embeddings for r in ok] == [[2.0, 1.0], None]
    with pytest.raises(PySparkException):
        embed.embed_texts(texts(spark, ["aa", "bad"]), Fragile, "text", on_error="fail").collect()
    with pytest.raises(ValueError):
        embed.embed_texts(texts(spark, ["a"]), Fragile, "text", on_error="ignore")


def test_images_from_base64_and_bytes(spark):
    good = base64.b64encode(b"abc").decode()
    rows = [(0, good), (1, "%%%"), (2, None), (3, base64.b64encode(b"bad").decode())]
    frame = spark.createDataFrame(rows, "id int, image_base64 string")
    got = embed.embed_images(frame, Fragile, "image_base64").orderBy("id").collect()
    assert [r.embeddings for r in got] == [[3.0, 1.0], None, None, None]
    with pytest.raises(PySparkException):
        embed.embed_images(frame.filter("id = 1"), Fragile, "image_base64", on_error="fail").collect()
    raw = spark.createDataFrame([(bytearray(b"abcd"),)], "content binary")
    assert embed.embed_images(raw, Fragile, tasks=2).first().embeddings == [4.0, 1.0]


def test_repeats_are_encoded_once_a_task(spark, tmp_path):
    log = str(tmp_path / "calls")
    frame = spark.createDataFrame([("same",)] * 500, "text string").coalesce(1)
    assert embed.embed_texts(frame, lambda: Fragile(log), "text").select("embeddings").distinct().count() == 1
    assert open(log).read().split() == ["same"]


def test_models_load_once_a_process(spark, tmp_path):
    log = str(tmp_path / "loads")

    def factory():
        with open(log, "a") as file:
            file.write(f"{os.getpid()}\n")
        return Fragile()

    frame = texts(spark, ["a", "b", "c"]).repartition(8)
    for _ in range(3):
        assert embed.embed_texts(frame, factory, "text").filter("embeddings IS NOT NULL").count() == 3
    loads = open(log).read().split()
    assert len(loads) == len(set(loads))


def test_once_per_value_even_if_all_rows_are_equal(spark, tmp_path):
    log = str(tmp_path / "calls")
    values = ["same"] * 300 + ["other", None, "other"]
    frame = spark.createDataFrame([(v,) for v in values], "text string").repartition(4)
    encode = text_encoder(lambda: Fragile(log), "fail")
    got = embed.apply_once_per_value(frame, "text", "v", encode)
    assert sorted((r.text or "", r.v[0] if r.v else None) for r in got.collect()) == sorted(
        (v or "", float(len(v)) if v else None) for v in values
    )
    assert sorted(open(log).read().split()) == ["other", "same"]


def test_model_runs_once_under_a_filter(spark):
    plan = embed.embed_texts(texts(spark, ["a"]), HashEncoder, "text").filter("embeddings IS NOT NULL")
    assert plan._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1


def test_input_column(spark):
    frame = texts(spark, ["a"])
    assert embed.input_column(frame) == "id"
    assert embed.input_column(frame.withColumnRenamed("text", "input")) == "input"
    assert embed.input_column(frame, "text") == "text"
    with pytest.raises(ValueError):
        embed.input_column(frame, "missing")


def test_max_chars_and_preview(spark):
    frame = texts(spark, ["x" * 100] * 30).withColumn("a", F.lit(1)).withColumn("b", F.lit(2)).withColumn("c", F.lit(3))
    cut = embed.embed_texts(frame, Fragile, "text", max_chars=77)
    assert cut.first().embeddings[0] == 77.0
    shown = embed.preview_embeddings(frame, lambda df: embed.embed_texts(df, Fragile, "text"), "text")
    assert shown.columns == ["text", "embeddings", "id", "a", "b"] and shown.count() == 10


def test_not_yet_embedded(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    done = images.filter("file_path <> 'b'").withColumn("embeddings", F.lit(None))
    for limit in (10**6, 100, 1):  # done keys sent, pending keys sent, both joined
        assert [r.file_path for r in embed.not_yet_embedded(images, done, limit=limit).collect()] == ["b"]
    assert embed.not_yet_embedded(images, done.limit(0)).count() == 3
    assert embed.not_yet_embedded(images, images).count() == 0


def test_ai_query(spark):
    models = {"words": ("text", Fragile), "pictures": ("image", Fragile)}
    register_ai_query(spark, models)
    named = spark.sql("SELECT ai_query('words', request => :t) AS e", args={"t": "it's"}).first().e
    assert named == [4.0, 1.0]
    image = base64.b64encode(b"abcde").decode()
    assert spark.sql("SELECT ai_query('pictures', :i) AS e", args={"i": image}).first().e == [5.0, 1.0]
    both = spark.sql(
        "SELECT ai_query(m, r) AS e FROM VALUES ('words', 'abc'), ('pictures', 'QUJD'), ('words', NULL) AS t(m, r)"
    ).collect()
    assert [r.e for r in both] == [[3.0, 1.0], [3.0, 1.0], None]
    for bad in ("SELECT ai_query('unknown', 'x')", "SELECT ai_query('words', 'bad')", "SELECT ai_query('pictures', '%')"):
        with pytest.raises(PySparkException):
            spark.sql(bad).collect()


def test_entities(spark):
    def tagger():
        return PatternTagger({"NAME": "[A-Z][a-z]+", "NUMBER": "[0-9]+"})

    frame = texts(spark, ["My name is John, 42", None, "none", "My name is John, 42"])
    rows = embed.tag_entities(frame, tagger).orderBy("id").collect()
    found = [(e.entity, e.word, e.start, e.end) for e in rows[0].ner]
    assert found == [("NAME", "My", 0, 2), ("NAME", "John", 11, 15), ("NUMBER", "42", 17, 19)]
    assert rows[1].ner is None and rows[2].ner == []
    again = embed.tag_entities(frame, tagger, once_per_value=True).orderBy("id").collect()
    assert [r.ner for r in again] == [r.ner for r in rows]


def test_hash_encoder():
    one, two = HashEncoder(64).encode_text(["a", "b"])
    assert len(one) == 64 and list(one) != list(two) and max(abs(one)) <= 1
    assert list(HashEncoder(40).encode_image([b"a"])[0]) == list(one[:40])


def test_filters_come_before_the_model(spark, sf):
    from framesift.operators import index

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    chosen = {"source NOT": ("src7", "src13")}
    made = {
        "texts": (embed.embed_texts(documents, HashEncoder, "text", filters=chosen), "source"),
        "index": (index.text_index_rows(documents, "doc_id", "text", HashEncoder, 64, filters=chosen), "source"),
        "vectors": (index.index_rows(vectors, "vec_id", "embedding", 64, filters="label = 3"), "label"),
    }
    for name, (frame, column) in made.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert column in pushed, (name, plan)
        assert plan.rindex("ArrowEvalPython") < plan.rindex("Filter ") < plan.index("FileScan"), (name, plan)


def test_remembered_results_are_bounded_by_bytes(monkeypatch):
    """Entities of long texts are not remembered by the thousand."""
    monkeypatch.setattr(encoders, "REUSE_BYTES", 1 << 20)
    asked = []

    def tag(texts):
        asked.extend(texts)
        return [[{"entity": text}] * 100 for text in texts]

    apply = encoders._reusing(tag, "fail", 8)
    for n in range(200):
        assert apply([str(n)]) == [[{"entity": str(n)}] * 100]
    assert apply(["199", None]) == [[{"entity": "199"}] * 100, None] and len(asked) == 200
    assert apply(["0"]) == [[{"entity": "0"}] * 100] and len(asked) == 201  # forgotten and made again


def test_batches_are_taken_in_pieces():
    pieces = list(encoders._pieces(iter([pa.array(range(1000)), pa.array([], pa.int64())])))
    assert [x for piece in pieces for x in piece.to_pylist()] == list(range(1000))
    assert max(map(len, pieces)) <= encoders.PIECE_ROWS


def test_windows_of_many_rows(spark):
    """More rows than a piece holds keep their order."""
    values = [f"text {i} " * (1 + i % 40) for i in range(700)] + [None, ""]
    rows = texts(spark, values).coalesce(1)
    got = {r.id: r.embeddings for r in embed.embed_long_texts(rows, Fragile, "text", window_chars=50).collect()}
    for i, text in enumerate(values):
        parts = [len(text[at : at + 50]) for at in range(0, max(1, len(text)), 50)] if text is not None else None
        expected = None if parts is None else sum(n * max(1, n) for n in parts) / sum(max(1, n) for n in parts)
        assert (got[i] is None) == (expected is None) and (expected is None or abs(got[i][0] - expected) < 1e-3)
