import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from framesift.llm import language_id as lid

SCHEMA = "doc_id long, text string, lang string, score string"


def brute_counts(text):
    line = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
    grams = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    return {g: n for g, n in grams.items() if g != " " and not (len(g) == 3 and g[1] == " ")}


def packed(gram):
    code = 0
    for c in gram:
        code = code << 21 | (1 if c == " " else ord(c))
    return code


TEXTS = [None, "", "12 -- 3", "a", " É", "The cat; the CAT", "x" * 200, "wörter über\nalles 99 ok", "日本語 text", "ab " * 400]


@pytest.mark.parametrize("piece", [1 << 18, 3, 7])
def test_counts(monkeypatch, piece):
    monkeypatch.setattr(lid, "PIECE", piece)
    for text in TEXTS:
        values, counts = lid.count_grams(text or "")
        want = brute_counts(text) if any(c.isalpha() for c in text or "") else {}
        assert dict(zip(values.tolist(), counts.tolist())) == {packed(g): n for g, n in want.items()}


def brute_predict(text, ranked, size):
    counts = Counter({packed(g): n for g, n in brute_counts(text).items()})
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    top = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]
    distances = []
    for language in sorted(ranked):
        place = {g: i for i, g in enumerate(ranked[language])}
        distances.append((sum(abs(place[g] - i) if g in place else size for i, g in enumerate(top)), language))
    distance, language = min(distances)
    return language, 1 - distance / (size * len(top))


def test_prediction_equals_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    learned = [(t, l) for i, t, l in zip(docs.doc_id, docs.text, docs.lang) if zlib.crc32(str(i).encode()) % 4 != 2]
    totals = {}
    for text, language in learned:
        totals.setdefault(language, Counter()).update({packed(g): n for g, n in brute_counts(text).items()})
    ranked = {l: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: lid.PROFILE]] for l, c in totals.items()}
    from framesift.llm.queries import op4_language_id

    got = {r.doc_id: r for r in op4_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, text, language in zip(docs.doc_id, docs.text, docs.lang):
        want, score = brute_predict(text, ranked, lid.PROFILE)
        assert got[i].lang_pred == want and abs(got[i].score - score) < 1e-12
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [got[i].lang_pred == l for i, l in zip(docs.doc_id, docs.lang) if got[i].held_out]
    assert np.mean(held) > 0.97


def test_nulls_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(lid, "HELD_GRAMS", 8)
    rows = [(i, t, "en", None) for i, t in enumerate(["the cat and the dog", "this that there"] * 4)]
    rows += [(100 + i, "der hund und die katze", "de", "x") for i in range(8)]
    rows += [(None, "the that", "en", None), (None, None, None, None), (7, "und der die", None, None), (200, "12", "de", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = lid.identify_languages(frame)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    seen = sorted((str(r.doc_id), r.lang_pred) for r in got.collect())
    assert len(seen) == len(rows)
    assert ("None", "en") in seen and ("None", "und") in seen and ("7", "de") in seen and ("200", "und") in seen
    stay = lid.with_known_language(frame)
    assert stay.columns == frame.columns and stay.count() == len(rows) - 2


def test_without_languages_or_rows(spark):
    frame = spark.createDataFrame([(1, "text", None, None), (2, None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in lid.identify_languages(frame).collect()] == [("und", 0.0)] * 2
    assert lid.identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0
