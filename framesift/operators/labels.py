"""Clusters and labels from vectors."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.encoders import Encoder, text_encoder
from framesift.functions.vectors import as_vector, check_metric, closeness, rounded, searchable_vectors, to_matrix
from framesift.operators.blocks import BROADCAST_BYTES, rows_within_budget
from framesift.operators.knn import knn_join

log = logging.getLogger(__name__)


def kmeans_clusters(
    table: DataFrame, key: str, vector: str, k: int, seed: int = 17, max_iter: int = 100
) -> DataFrame:
    """(key, cluster) by MLlib k-means with cosine distance; only centres leave the executors.

    Rounds go on until the centres stand still, ``max_iter`` of them at most;
    stopping there with the centres still moving is logged as a warning.
    """
    rows = table.select(F.col(key).alias("key"), as_vector(F.col(vector)).alias("vec"))
    points = searchable_vectors(rows, "vec").select("key", array_to_vector("vec").alias("features"))
    kmeans = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine", predictionCol="cluster")
    held = points.persist(StorageLevel.MEMORY_AND_DISK)  # read once per iteration
    try:
        model = kmeans.fit(held)
    finally:
        held.unpersist()
    if model.summary.numIter >= max_iter:
        log.warning("the centres still moved after %d rounds", max_iter)
    return model.transform(points).select("key", "cluster")


def nearest_label(
    table: DataFrame,
    key: str,
    vector: str,
    labels: DataFrame,
    metric: str = "cosine",
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Closest label of every row: (key, label, score); equal scores go to the lower label.

    ``labels`` has (key, vec). Labels that fit the measured budget are sent to
    every task and the rows are never shuffled; more labels go through the
    general nearest-neighbour join.
    """
    check_metric(metric)
    size = labels.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not size.n:
        raise ValueError("no labels")
    rows = searchable_vectors(
        table.select(F.col(key).alias("key"), as_vector(F.col(vector)).alias("vec")), "vec", size.dim
    )
    if size.n > rows_within_budget(size.dim, max_broadcast_bytes):
        nearest = knn_join(
            rows.select("key", "vec"), labels, 1, metric, dim=size.dim, max_broadcast_bytes=max_broadcast_bytes
        )
        return nearest.select(F.col("query_key").alias("key"), F.col("key").alias("label"), "score")

    few = labels.select("key", "vec").toArrow().sort_by("key")
    shared = table.sparkSession.sparkContext.broadcast(
        (few.column("key").combine_chunks(), to_matrix(few.column("vec")))
    )
    label_type = labels.schema["key"].dataType.simpleString()

    def best(vectors: pa.Array) -> pa.Array:
        names, prototypes = shared.value
        if len(vectors) == 0:
            picked, score = np.empty(0, dtype=np.int64), np.empty(0)
        else:
            scores = rounded(closeness(to_matrix(vectors), prototypes, metric))
            picked = scores.argmax(axis=1)
            score = scores[np.arange(len(picked)), picked]
        score = np.abs(score) if metric == "l2" else score
        return pa.StructArray.from_arrays([names.take(pa.array(picked)), pa.array(score)], names=["label", "score"])

    choose = F.arrow_udf(best, f"struct<label:{label_type},score:double>").asNondeterministic()
    return rows.select("key", choose("vec").alias("best")).select("key", "best.label", "best.score")


def label_vectors(table: DataFrame, texts: Sequence[str], factory: Callable[[], Encoder]) -> DataFrame:
    """(key, vec) of label texts."""
    spark = table.sparkSession
    named = spark.createDataFrame([(text,) for text in texts], "key string")
    return named.select("key", text_encoder(factory, "fail")(F.col("key")).alias("vec"))
