"""Base64, JSON payloads and text shortening as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.schemas import MAX_TEXT_CHARS, PREVIEW_CHARS


def to_base64(content: Column) -> Column:
    """Base64 on one line, whatever the session says about chunking."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def from_base64(text: Column) -> Column:
    """Decoded bytes, or NULL where the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def model_text(text: Column, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """First ``max_chars`` characters: the request a short-context text model takes."""
    return F.substring(text, 1, max_chars)


def text_windows(text: Column, size: int, overlap: int) -> Column:
    """The text in windows of ``size`` characters, each sharing ``overlap`` with the next; NULL stays NULL.

    A text of no more than ``size`` characters is one window, the empty one too.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than the window")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), last), lambda n: F.substring(text, n * step + 1, F.lit(size)))
    return F.when(text.isNotNull(), windows)


def shorten(value: Column, limit: int = PREVIEW_CHARS) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def json_record(columns: Sequence[str]) -> Column:
    """One JSON object per row, NULL fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def document_of(columns: Sequence[str]) -> Column:
    """First column as page content, the others as string metadata keyed by name."""
    content, *rest = columns
    entries = [part for name in rest for part in (F.lit(name), F.col(name).cast("string"))]
    metadata = F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)")
    return F.struct(F.col(content).cast("string").alias("page_content"), metadata.alias("metadata"))
