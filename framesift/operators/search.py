"""Similarity search over an index table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.encoders import Encoder, text_encoder
from framesift.functions.encoding import document_of
from framesift.functions.filters import Filters, filter_condition, filtered
from framesift.functions.paths import has_extension, matches_any_term
from framesift.functions.vectors import check_metric, similarity_to
from framesift.schemas import (
    DISPLAYABLE_EXTENSIONS,
    FILTERED_RESULTS,
    RESULT_COLUMNS,
    SEARCH_DEPTH,
)

#: Hits whose keys are fetched and given to a scan, at most.
LISTED_HITS = 1000


def _best_first(metric: str, key: str) -> list[Column]:
    """Ordering of results; NULL scores (broken vectors) go last."""
    score = F.col("score")
    return [score.asc_nulls_last() if metric == "l2" else score.desc_nulls_last(), F.col(key)]


def _add_rank(results: DataFrame, key: str, metric: str = "cosine") -> DataFrame:
    """1-based position. ``results`` is a top-k list, so one task orders k rows."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*_best_first(metric, key))))


def search(
    table: DataFrame,
    query_vector: Sequence[float],
    k: int,
    key: str,
    vector: str = "embeddings",
    columns: Sequence[str] | None = None,
    filters: Filters = None,
    metric: str = "cosine",
    exclude_key: Any = None,
) -> DataFrame:
    """The ``k`` rows nearest to ``query_vector``: requested columns, score, rank.

    Filters apply before the ranking and reach the file scan. Each task keeps
    its own best ``k``; nothing else is shuffled. Equal scores go by key. As in
    an index, rows whose vector is NULL, zero, of another length or has NULL,
    NaN or infinity inside are not searched. ``columns`` are the key alone
    unless named, so that nothing wide goes through the ranking.
    """
    check_metric(metric)
    if len(query_vector) == 0:
        raise ValueError("empty query vector")
    wanted = list(columns) if columns is not None else [key]
    rows = filtered(table, filters)
    if exclude_key is not None:
        rows = rows.filter(F.col(key) != F.lit(exclude_key))
    carried = list(dict.fromkeys([*wanted, key]))
    scored = rows.filter(F.size(vector) == len(query_vector)).select(
        *carried, similarity_to(query_vector, metric)(F.col(vector)).alias("score")
    )
    best = scored.orderBy(*_best_first(metric, key)).limit(k).filter(F.col("score").isNotNull())
    return _add_rank(best, key, metric).select(*wanted, "score", "rank")


def stored_vector(table: DataFrame, key: str, value: Any, vector: str = "embeddings") -> list[float]:
    """The vector stored under one key."""
    row = table.filter((F.col(key) == F.lit(value)) & F.col(vector).isNotNull()).select(vector).first()
    if row is None:
        raise ValueError(f"no vector stored under {value!r}")
    return row[0]


def encode_query(table: DataFrame, factory: Callable[[], Encoder], text: str) -> list[float]:
    """Vector of one query text, encoded on an executor; the text is a bound value, quotes and all."""
    if not text:
        raise ValueError("empty search query")
    one = table.sparkSession.sql("SELECT :text AS input_text", args={"text": text})
    return one.select(text_encoder(factory, "fail")(F.col("input_text"))).first()[0]


def search_text(table: DataFrame, factory: Callable[[], Encoder], text: str, k: int, key: str, **options: Any) -> DataFrame:
    """`search` by a text; ``options`` as there."""
    return search(table, encode_query(table, factory, text), k, key, **options)


def search_like(table: DataFrame, value: Any, k: int, key: str, vector: str = "embeddings", **options: Any) -> DataFrame:
    """Rows most like a stored one, without itself."""
    query = stored_vector(table, key, value, vector)
    return search(table, query, k, key, vector, exclude_key=value, **options)


def search_images(
    table: DataFrame,
    factory: Callable[[], Encoder],
    text: str,
    folder_terms: Sequence[str] = (),
    key: str = "file_path",
    vector: str = "embeddings",
    columns: Sequence[str] = RESULT_COLUMNS,
    metric: str = "cosine",
    depth: int = SEARCH_DEPTH,
    shown: int = FILTERED_RESULTS,
    filter_first: bool = False,
) -> DataFrame:
    """The search page's flow: embed the text, take the best ``depth``, keep chosen folders.

    With folder terms at most ``shown`` rows come back, fewer when the best
    ``depth`` hold fewer matches; ``filter_first`` filters before ranking
    instead, so that matches further down are found too. Without terms the
    whole depth comes back.
    """
    query = encode_query(table, factory, text)
    wanted = list(dict.fromkeys([*columns, "folder", key]))
    chosen = matches_any_term(F.col("folder"), folder_terms) if folder_terms else None
    hits = search(
        table, query, depth, key, vector, wanted, filters=chosen if filter_first else None, metric=metric
    )
    if chosen is not None:
        hits = hits.filter(chosen).orderBy("rank").limit(shown)
    return _add_rank(hits.drop("rank"), key, metric).select(*columns, "score", "rank")


def displayable(hits: DataFrame, path: str = "file_path") -> DataFrame:
    """Hits whose file can be shown. Ranks are kept, so they may have gaps."""
    return hits.filter(has_extension(F.col(path), DISPLAYABLE_EXTENSIONS))


def with_content(hits: DataFrame, images: DataFrame, columns: Sequence[str], key: str = "file_path") -> DataFrame:
    """Add columns of the image table to a result list.

    A short result list, as a search gives, is fetched first, so that the image
    scan is given its keys and can pass over files and row groups that hold
    none; only then are the wide columns read. A list of more than
    `LISTED_HITS` rows is joined instead.
    """
    spark = images.sparkSession
    found = hits.limit(LISTED_HITS + 1).collect()
    wide = images.select(key, *columns)
    if len(found) > LISTED_HITS:
        return wide.join(hits, key)
    listed = spark.createDataFrame(found, hits.schema)
    return wide.filter(F.col(key).isin([row[key] for row in found])).join(F.broadcast(listed), key)


def as_text_rows(hits: DataFrame, columns: Sequence[str] = RESULT_COLUMNS) -> DataFrame:
    """Rank and the named columns as strings, for display."""
    return hits.select(F.col("rank").alias("Rank"), *(F.col(c).cast("string").alias(c) for c in columns))


def as_documents(hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rank, document): first column as content, the others as metadata; the score is dropped."""
    return hits.select("rank", document_of(columns).alias("document"))


def smoke_check(table: DataFrame, key: str, vector: str = "embeddings", k: int = 3, metric: str = "cosine") -> DataFrame:
    """Search with the vector of the lowest key; its nearest row should be itself."""
    row = table.filter(F.col(vector).isNotNull()).orderBy(key).select(key, vector).first()
    if row is None:
        raise ValueError("no vectors to check with")
    found = search(table, row[1], k, key, vector, [key], metric=metric)
    return found.withColumn("is_self", F.col(key) == F.lit(row[0]))
