"""Running an encoder or tagger over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framesift.functions.encoders import (
    Encoder,
    Tagger,
    entity_tagger,
    image_encoder,
    pooled_text_encoder,
    reporting_encoder,
    stitching_tagger,
    text_encoder,
)
from framesift.functions.encoding import from_base64, model_text, text_windows
from framesift.functions.filters import Filters, filtered
from framesift.operators.keys import KEY_BYTES, filter_by_keys, fits_broadcast
from framesift.operators.skew import hot_keys, salted_join
from framesift.schemas import MAX_TEXT_CHARS, PREVIEW_ROWS
from framesift.session import cut_lineage


def input_column(df: DataFrame, name: str | None = None) -> str:
    """The column a model reads: the one named, else ``input``, else the first."""
    if name is not None:
        if name not in df.columns:
            raise ValueError(f"no column {name!r} in {df.columns}")
        return name
    if not df.columns:
        raise ValueError("no columns to read a model input from")
    return "input" if "input" in df.columns else df.columns[0]


def _over_tasks(df: DataFrame, tasks: int | None) -> DataFrame:
    return df if tasks is None else df.repartition(tasks)


def embed_texts(
    df: DataFrame,
    factory: Callable[[], Encoder],
    column: str | None = None,
    output: str = "embeddings",
    on_error: str = "null",
    max_chars: int | None = None,
    tasks: int | None = None,
    filters: Filters = None,
) -> DataFrame:
    """Add the vector of a text column. NULL stays NULL; see `text_encoder` for errors.

    The model runs where the rows are read. ``tasks`` spreads them first, which
    costs a shuffle of the rows: for slow models on tables of few partitions.
    ``filters`` (see `filter_condition`) choose rows before the model runs; a
    filter on the result would come after it, since Spark moves none below it.
    """
    df = filtered(df, filters)
    text = F.col(input_column(df, column))
    if max_chars is not None:
        text = model_text(text, max_chars)
    return _over_tasks(df, tasks).withColumn(output, text_encoder(factory, on_error)(text))


def embed_long_texts(
    df: DataFrame,
    factory: Callable[[], Encoder],
    column: str | None = None,
    output: str = "embeddings",
    window_chars: int = MAX_TEXT_CHARS,
    overlap_chars: int = 0,
) -> DataFrame:
    """Add a vector of the whole text, however long: the mean over windows the model can take, by their lengths.

    The windows of a row stay in its task. A text of one window has the
    model's own vector; NULL stays NULL.
    """
    windows = text_windows(F.col(input_column(df, column)), window_chars, overlap_chars)
    return df.withColumn(output, pooled_text_encoder(factory)(windows))


def embed_reporting(
    df: DataFrame,
    factory: Callable[[], Encoder],
    column: str | None = None,
    kind: str = "text",
    output: str = "embeddings",
    dim: int | None = None,
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows with their vector, rejected rows with the reason ``error``, counts of both).

    ``kind`` is text or image; images are bytes or base64. The model runs once
    over the rows, whose results are written to the shared folder; the counts
    come from that same run.
    """
    if kind not in ("text", "image"):
        raise ValueError(f"kind must be text or image, not {kind!r}")
    name = input_column(df, column)
    given = F.col(name) if kind == "text" else image_bytes(df, name, "null")
    reported = df.withColumn("_report", reporting_encoder(factory, f"encode_{kind}", dim)(given))
    broken = F.col(name).isNotNull() & (F.col("_report.error") == "no input")
    error = F.when(broken, "not base64").otherwise(F.col("_report.error"))
    told = reported.select(*df.columns, F.col("_report.vector").alias(output), error.alias("error"))
    counts = Observation()
    failed = F.coalesce(F.sum(F.col("error").isNotNull().cast("long")), F.lit(0))
    told = cut_lineage(told.observe(counts, F.count("*").alias("rows"), failed.alias("rejected")))
    good = told.filter("error IS NULL").drop("error")
    return good, told.filter("error IS NOT NULL").drop(output), dict(counts.get)


def image_bytes(df: DataFrame, column: str, on_error: str) -> Column:
    """Bytes of an image column holding either bytes or base64 text."""
    if df.schema[column].dataType.typeName() == "binary":
        return F.col(column)
    decode = from_base64 if on_error == "null" else lambda c: F.to_binary(c, F.lit("base64"))
    return decode(F.col(column))


def embed_images(
    df: DataFrame,
    factory: Callable[[], Encoder],
    column: str | None = None,
    output: str = "embeddings",
    on_error: str = "null",
    tasks: int | None = None,
    filters: Filters = None,
) -> DataFrame:
    """Add the vector of an image column (base64 text or bytes).

    Under "null" a NULL, undecodable or unencodable image gives a NULL vector;
    under "fail" the latter two end the job. ``tasks`` and ``filters`` as in
    `embed_texts`.
    """
    df = filtered(df, filters)
    name = input_column(df, column)
    return _over_tasks(df, tasks).withColumn(output, image_encoder(factory, on_error)(image_bytes(df, name, on_error)))


def preview_embeddings(
    df: DataFrame, embed: Callable[[DataFrame], DataFrame], column: str, output: str = "embeddings", n: int = PREVIEW_ROWS
) -> DataFrame:
    """A few embedded rows: input, vector and the first three other columns."""
    others = [name for name in df.columns if name not in (column, output)][:3]
    return embed(df.limit(n)).select(column, output, *others)


def not_yet_embedded(
    images: DataFrame, embedded: DataFrame, key: str = "file_path", limit: int = KEY_BYTES, vector: str | None = None
) -> DataFrame:
    """Rows of ``images`` without a vector in ``embedded``.

    With a ``vector`` column of ``embedded`` named, a row whose vector is NULL,
    because encoding failed, is pending again. Image rows are wide, so whichever list of keys is short, done or pending,
    goes to them; the pending keys are found from keys alone. Only if both
    lists are long do the images themselves take part in a shuffle.
    """
    done = (embedded if vector is None else embedded.filter(F.col(vector).isNotNull())).select(key)
    if fits_broadcast(done, key, limit):
        return images.join(F.broadcast(done), key, "left_anti")
    pending = images.select(key).join(done, key, "left_anti")
    return filter_by_keys(images, pending, key, keep=True, limit=limit)


def apply_once_per_value(df: DataFrame, column: str, output: str, model: Callable[[Column], Column]) -> DataFrame:
    """Run ``model`` once for each distinct value of ``column`` in the whole table.

    The encoders already skip repeats within a task, at no cost. This form is
    for models dear enough to pay two shuffles for skipping all repeats. The
    join back is salted by input partition, so a value held by a third of the
    rows stays spread even where the rows are equal in every column.
    """
    digest = F.unhex(F.sha2(F.col(column), 256))
    keyed = df.withColumn("_digest", digest)
    values = keyed.filter(F.col(column).isNotNull()).groupBy("_digest", column).agg(F.count("*").alias("n"))
    results = cut_lineage(values.select("_digest", "n", model(F.col(column)).alias(output)))
    hot = hot_keys(results, ["_digest"])
    joined = salted_join(keyed, results.drop("n"), ["_digest"], hot, F.spark_partition_id(), how="left")
    return joined.select(*df.columns, output)


def tag_entities(
    df: DataFrame,
    factory: Callable[[], Tagger],
    column: str = "text",
    output: str = "ner",
    once_per_value: bool = False,
    window_chars: int | None = None,
    overlap_chars: int = 0,
) -> DataFrame:
    """Add the entities of a text column as an array of structs.

    With ``window_chars`` texts are tagged in windows of so many characters,
    for taggers that take no more; entities of up to ``overlap_chars`` are
    found whole wherever the windows end.
    """
    tagger = entity_tagger(factory)
    if window_chars is not None:
        windowed = stitching_tagger(factory, window_chars - overlap_chars, overlap_chars)

        def tagger(text: Column) -> Column:
            return windowed(text_windows(text, window_chars, overlap_chars))

    if once_per_value:
        return apply_once_per_value(df, column, output, tagger)
    return df.withColumn(output, tagger(F.col(column)))
