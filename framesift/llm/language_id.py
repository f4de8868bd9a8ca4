"""Language identification by rank-order profiles of letter n-grams.

A language is described by its most frequent n-grams in order. A text is given
the language whose profile its own most frequent n-grams are least out of place
in (Cavnar and Trenkle, "N-Gram-Based Text Categorization", 1994).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, keyed, text_batches, with_row_key, write_shared
from framesift.operators.keys import filter_by_keys

#: Lengths of n-grams, n-grams per profile, and letters of a text counted at a time.
SIZES, PROFILE, PIECE = (1, 2, 3), 400, 1 << 18

#: Distinct n-grams of a language that a task holds before it passes their counts on.
HELD_GRAMS = 1 << 20

UNKNOWN = "und"

_BITS = 21  # of a code point

#: Stands for everything between letters. Not 0, so that packed n-grams of different lengths differ.
BLANK = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Lower-case letters with every run of other characters as one blank, in bounded pieces."""
    letters = _letters()
    tail = np.zeros(0, dtype=np.int64)
    for first in range(0, len(text), PIECE):
        points = np.frombuffer(text[first : first + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points = np.where(letters[points], points, BLANK).astype(np.int64)
        if not first:
            points = np.append(BLANK, points)
        if first + PIECE >= len(text):
            points = np.append(points, BLANK)
        last = tail[-1] if len(tail) else -1
        kept = (points != BLANK) | (np.append(last, points[:-1]) != BLANK)
        points = np.append(tail, points[kept])
        yield points
        tail = points[-(max(SIZES) - 1) :]


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, as packed code points, and how often each occurs.

    A blank is part of an n-gram at most as its first or last place, so words
    end to end make none. Empty if the text has no letter.
    """
    found, counts = [], []
    overlap = 0
    for points in _pieces(text):
        grams = []
        for n in SIZES:
            codes = np.zeros(max(0, len(points) - n + 1), dtype=np.int64)
            inner = np.ones(len(codes), dtype=bool)
            for k in range(n):
                place = points[k : k + len(codes)]
                codes = codes << _BITS | place
                if n == 1 or 0 < k < n - 1:
                    inner &= place != BLANK
            new = slice(max(0, overlap - n + 1), None)  # those wholly in the last piece were counted with it
            grams.append(codes[new][inner[new]])
        overlap = min(len(points), max(SIZES) - 1)
        values, n = np.unique(np.concatenate(grams), return_counts=True)
        found.append(values)
        counts.append(n)
    if len(found) == 1:
        return found[0], counts[0]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    values, place = np.unique(np.concatenate(found), return_inverse=True)
    return values, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def _most_frequent(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` values by falling count, equal counts by value."""
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        enough = counts >= least
        values, counts = values[enough], counts[enough]
    return values[np.lexsort((values, -counts))[:size]]


class Profiles:
    """The rank of every profile's n-grams, for all languages at once."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.languages, self.size = sorted(ranked), size
        self.grams = np.unique(np.concatenate([np.array(g, dtype=np.int64) for g in ranked.values()]))
        self.ranks = np.full((len(self.languages), len(self.grams)), -1, dtype=np.int64)
        for row, language in enumerate(self.languages):
            places = np.searchsorted(self.grams, np.array(ranked[language], dtype=np.int64))
            self.ranks[row, places] = np.arange(len(places))

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is one less the out-of-place distance as a share of the largest possible."""
        values, counts = count_grams(text or "")
        if not len(values):
            return UNKNOWN, 0.0
        top = _most_frequent(values, counts, self.size)
        place = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where(self.grams[place] == top, self.ranks[:, place], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))))
        distance = apart.sum(axis=1)
        best = int(distance.argmin())  # the first in order of the names, if equal
        return self.languages[best], float(1 - distance[best] / (self.size * len(top)))


def learn_profiles(docs: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> dict[str, list[int]]:
    """The most frequent n-grams of each language over all rows of ``docs``, counted by Spark.

    Rows whose text or language is null are left out. Equal counts are ordered by the n-gram.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def summed(language: str) -> None:
            values, place = np.unique(np.concatenate([v for v, _ in held[language]]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([c for _, c in held[language]]))
            held[language] = [(values, counts.astype(np.int64))]

        def out(language: str) -> pa.RecordBatch:
            summed(language)
            values, counts = held.pop(language)[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([language] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"]
            )

        waiting: dict[str, int] = {}
        for batch in batches:
            for text, language in zip(batch["text"], batch["lang"]):
                language = language.as_py()
                values, counts = count_grams(text.as_py())
                held.setdefault(language, []).append((values, counts))
                waiting[language] = waiting.get(language, 0) + len(values)
                if waiting[language] > HELD_GRAMS:
                    summed(language)
                    waiting[language] = len(held[language][0][0])
                    if waiting[language] > HELD_GRAMS // 2:
                        yield out(language)
                        waiting[language] = 0
        for language in list(held):
            yield out(language)

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = write_shared(counted, "grams")
    ranked = {}
    for row in counted.select("lang").distinct().collect():  # languages, not rows
        best = counted.filter(F.col("lang") == row.lang).orderBy(F.desc("n"), "gram").limit(size)
        ranked[row.lang] = [r.gram for r in best.collect()]
    return {language: grams for language, grams in ranked.items() if grams}


def predict_language(
    docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE
) -> DataFrame:
    """One row per document: (id, lang_pred, score). Only the text is looked at.

    ``und`` with score 0 if the text is null, has no letter, or there are no
    profiles. Whole texts are counted, long ones in pieces.
    """
    rows = keyed(docs, id_col, _text=text_col)
    id_type = rows.schema["_id"].dataType.simpleString()
    text_batches(docs.sparkSession)
    models = Profiles(profiles, size) if profiles else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [models.classify(t.as_py()) if models else (UNKNOWN, 0.0) for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays(
                [batch[ROW], batch["_id"], pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())],
                [ROW, id_col, "lang_pred", "score"],
            )

    result = rows.mapInArrow(run, f"{ROW} long, `{id_col}` {id_type}, lang_pred string, score double")
    return result if ROW in docs.columns else result.drop(ROW)


def held_out(id_col: str) -> Column:
    """The fixed quarter of ids that nothing is learned from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE
) -> DataFrame:
    """One row per document: (id, held_out, lang_pred, score).

    Profiles are learned from the rows with a language that are not held out;
    rows with a null id are never learned from. Every row is predicted from its
    text alone. Repeated ids are rows of their own. Other columns are not read.
    """
    known = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    profiles = learn_profiles(known, text_col, lang_col, size)
    told = predict_language(docs, profiles, id_col, text_col, size)
    extra = [ROW] if ROW in docs.columns else []
    return told.select(*extra, id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents some language was found for, with all their columns."""
    rows = with_row_key(docs, id_col)
    rejected = identify_languages(rows, id_col, text_col, lang_col).filter(F.col("lang_pred") == UNKNOWN)
    return filter_by_keys(rows, rejected, ROW, keep=False).select(*docs.columns)
