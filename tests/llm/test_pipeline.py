import numpy as np
import pandas as pd
import pytest
from test_exact_dedup import brute as brute_exact
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from framesift.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage returns, each given what the one before kept."""
    docs, frames = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        if name != "packing":
            assert result.columns == docs.columns
        frames[name] = result.toPandas()
        docs = spark.createDataFrame(frames[name]) if name != "packing" else None
    return frames


def test_each_stage_against_brute_force(staged, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    after = staged["language_id"]
    assert set(after.doc_id) == {i for i, t in zip(docs.doc_id, docs.text) if any(c.isalpha() for c in t or "")}

    exact = brute_exact(list(zip(after.doc_id, after.text)))
    assert set(staged["exact_dedup"].doc_id) == {i for i, (_, _, kept, _) in exact.items() if kept}

    after = staged["exact_dedup"]
    components = brute_components(sorted(after.doc_id), [brute_fingerprint(t) for t in after.sort_values("doc_id").text])
    assert set(staged["simhash_dedup"].doc_id) == set(components.values())

    packed = staged["packing"]
    assert set(packed.doc_id) == set(staged["mixing"].doc_id)
    assert (packed.groupby("sequence_id").length.sum().sort_index().to_numpy()[:-1] == 1024).all()


def test_mixing_takes_toxic_documents(staged, sf):
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    before, after = set(staged["simhash_dedup"].doc_id), set(staged["mixing"].doc_id)
    toxic = set(labels[labels.toxic == 1].doc_id) & before
    clean = set(labels[labels.toxic == 0].doc_id) & before
    assert after <= before and len(clean & after) > 0.9 * len(clean) and len(toxic & after) < 0.6 * len(toxic)


def test_run_equals_its_stages(spark, sf, staged):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == staged["packing"].groupby("doc_id").length.sum().to_dict()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_relative_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i, int(t), p.tolist()) for i, (t, p) in enumerate(zip(rng.integers(1, 90, 200), rng.dirichlet([0.05, 0.05], 200)))]
    frame = spark.createDataFrame(rows, "__row long, _id long, _tokens long, _p array<double>")
    _, report = mixing.fit_rates(frame, ["a", "b"], {"a": 1.0, "b": 0.1}, relative=True)
    a, b = report
    assert a["met"] and b["met"] and abs(a["target"] - a["tokens"]) < 1e-6 and abs(b["target"] - 0.1 * b["tokens"]) < 1e-6
