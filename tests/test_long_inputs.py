import re

import numpy as np
import pytest

from framesift.functions.encoding import text_windows
from framesift.operators import embed
from framesift.plans.stand_ins import HashEncoder, PatternTagger

TEXTS = "k int, text string"


@pytest.fixture
def counting():
    class Picky(HashEncoder):
        """Refuses some texts and gives others too little."""

        def encode_text(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[] if "none" in t else self._encode(t.encode())[: 3 if "short" in t else None] for t in texts]

    return lambda: Picky(8)


def test_reasons(spark, counting):
    rows = [(1, "fine"), (2, None), (3, "bad"), (4, "none"), (5, "short"), (6, "fine"), (7, "")]
    good, rejected, counts = embed.embed_reporting(spark.createDataFrame(rows, TEXTS), counting, "text", dim=8)
    assert {r.k: r.error for r in rejected.collect()} == {
        2: "no input", 3: "ValueError: bad text", 4: "empty vector", 5: "3 components, not 8"
    }
    assert rejected.columns == ["k", "text", "error"] and good.columns == ["k", "text", "embeddings"]
    plain = embed.embed_texts(spark.createDataFrame(rows, TEXTS).filter("k in (1, 6, 7)"), counting, "text")
    assert sorted(good.collect()) == sorted(plain.collect()) and counts == {"rows": 7, "rejected": 4}


def test_reasons_of_images(spark, counting):
    rows = [(1, "%broken"), (2, None), (3, "aGVsbG8=")]
    good, rejected, _ = embed.embed_reporting(spark.createDataFrame(rows, "k int, input string"), counting, kind="image")
    assert {r.k: r.error for r in rejected.collect()} == {1: "not base64", 2: "no input"} and [r.k for r in good.collect()] == [3]
    with pytest.raises(ValueError):
        embed.embed_reporting(good, counting, "input", kind="sound")
    empty = embed.embed_reporting(spark.createDataFrame([], TEXTS), counting, "text")
    assert empty[0].count() == empty[1].count() == 0 and empty[2] == {"rows": 0, "rejected": 0}


def test_one_model_call_a_row(spark):
    runs = spark.sparkContext.accumulator(0)

    class Once(HashEncoder):
        def encode_text(self, texts):
            runs.add(len(texts))
            return super().encode_text(texts)

    rows = spark.createDataFrame([(i, str(i)) for i in range(40)], TEXTS).repartition(3)
    good, rejected, _ = embed.embed_reporting(rows, lambda: Once(8), "text")
    assert good.count() == 40 and rejected.count() == 0 and good.filter("k > 3").count() == 36 and runs.value == 40


@pytest.mark.parametrize("size, overlap", [(5, 0), (5, 2), (5, 4), (100, 10)])
def test_windows(spark, size, overlap):
    texts = [None, "", "abc", "abcde", "abcdef", "äö日本語" * 9, "x" * 41]
    rows = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    for r in rows.select("text", text_windows(rows.text, size, overlap).alias("w")).collect():
        if r.text is None:
            assert r.w is None
            continue
        step = size - overlap
        assert all(w == r.text[n * step : n * step + size] for n, w in enumerate(r.w))
        assert "".join(w[:step] for w in r.w[:-1]) + r.w[-1] == r.text and all(len(w) > overlap for w in r.w[1:])


def test_long_texts_are_pooled(spark):
    texts = [None, "", "short", "a long text of several windows", "x" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    got = {r.k: r.embeddings for r in embed.embed_long_texts(rows, lambda: HashEncoder(8), "text", window_chars=10, overlap_chars=3).collect()}
    model = HashEncoder(8)
    assert got[0] is None and np.allclose(got[2], model.encode_text(["short"])[0])
    windows = [texts[3][i : i + 10] for i in range(0, 24, 7) if i == 0 or i + 3 < len(texts[3])]
    want = np.average(model.encode_text(windows), axis=0, weights=[len(w) for w in windows])
    assert np.allclose(got[3], want, atol=1e-6)


def test_entities_at_window_edges(spark):
    rng = np.random.default_rng(2)
    words = ["Anna", "Bo", "x", "12", "3456789", "yes", "Zoe"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 3, 40, 200)] + [None, "AnnaBo12Zoe" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), TEXTS)

    def tagger():
        return PatternTagger({"NAME": "[A-Z][a-z]+", "NUMBER": "[0-9]+"})

    whole = {r.k: r.ner for r in embed.tag_entities(rows, tagger).collect()}
    for size, overlap in ((20, 8), (11, 8), (1000, 8)):
        for once in (False, True):
            got = embed.tag_entities(rows, tagger, window_chars=size, overlap_chars=overlap, once_per_value=once)
            assert {r.k: r.ner for r in got.collect()} == whole
    assert len(whole[4]) == len(re.findall("[A-Z][a-z]+|[0-9]+", texts[4]))


def test_files_that_came_changed_and_went(spark, tmp_path):
    from framesift.streaming.files import sync_files

    root, index, progress = tmp_path / "images", str(tmp_path / "index"), str(tmp_path / "progress")
    (root / "sub dir").mkdir(parents=True)
    seen = spark.sparkContext.accumulator(0)

    def run():
        def embedded(records):
            seen.add(records.count())
            return embed.embed_images(records, lambda: HashEncoder(8), "image_base64")

        synced = sync_files(spark, str(root), index, progress, embedded, 8)
        return {r.file_path.rsplit("/", 1)[1]: [round(x, 4) for x in r.embeddings] for r in synced.collect()}

    def vector(content):
        return [round(float(x), 4) for x in HashEncoder(8).encode_image([content])[0]]

    with pytest.raises(FileNotFoundError):
        run()
    (root / "a.jpg").write_bytes(b"one")
    (root / "sub dir" / "b.JPG").write_bytes(b"two")
    (root / "c.txt").write_bytes(b"no image")
    assert run() == {"a.jpg": vector(b"one"), "b.JPG": vector(b"two")} and seen.value == 2
    assert len(run()) == 2 and seen.value == 2  # nothing new, nothing opened
    (root / "a.jpg").write_bytes(b"changed")
    (root / "sub dir" / "b.JPG").unlink()
    (root / "d.jpeg").write_bytes(b"three")
    assert run() == {"a.jpg": vector(b"changed"), "d.jpeg": vector(b"three")} and seen.value == 4
    (root / "sub dir" / "b.JPG").write_bytes(b"back")
    assert set(run()) == {"a.jpg", "d.jpeg", "b.JPG"} and seen.value == 5
