import hashlib
import re

import pandas as pd
import pytest

from framesift.llm.exact_dedup import exact_duplicates, without_exact_duplicates

SCHEMA = "doc_id long, text string, kept string"


def brute(rows):
    squeezed = [(i, t or "", re.sub("[\x20\x09-\x0d]", "", t or "")) for i, t, *_ in rows]
    out = {}
    for i, _, body in squeezed:
        group = [(-len(t), j) for j, t, b in squeezed if b == body]
        keep = min(group)[1]
        out[i] = (keep, len(group), keep == i, hashlib.sha256(body.encode()).hexdigest())
    return out


LONG = "abc déf " * 9000
ROWS = [
    (1, "same text", "x"),
    (2, "same  text\n", None),
    (3, "same text!", None),
    (4, None, None),
    (5, "", None),
    (6, " \t\r\n\x0b\x0c", None),
    (7, LONG + "x", None),
    (8, LONG + "y", None),
    (9, LONG + " x", None),
    (10, "a b", None),
    (11, "ab", None),
    *((i, "many copies", None) for i in range(100, 160)),
]


@pytest.mark.parametrize("options", [{}, {"first_bytes": 1, "growth": 3, "most_bytes": 4096}])
def test_planted(spark, options):
    got = exact_duplicates(spark.createDataFrame(ROWS, SCHEMA), **options).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute(ROWS)


def test_rows_without_usable_ids(spark):
    rows = [(None, "a", "1"), (None, "a", "2"), (3, "a", "3"), (3, "a", "4"), (3, "b", "5"), (None, "c", "6")]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    seen = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got.collect())
    assert seen == [
        ("3", "3", 1, True), ("3", "3", 4, False), ("3", "3", 4, True),
        ("None", "3", 4, False), ("None", "3", 4, False), ("None", "None", 1, True),
    ]
    stay = without_exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert stay.columns == ["doc_id", "text", "kept"] and stay.count() == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(empty).count() == 0 and without_exact_duplicates(empty).count() == 0


def test_filter_keeps_clean_rows(spark):
    stay = {r.doc_id for r in without_exact_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert stay == {i for i, (_, _, kept, _) in brute(ROWS).items() if kept}


def test_whole_table(spark, sf):
    from framesift.llm.queries import op1_exact_dedup

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op1_exact_dedup(spark, sf).collect()}
    assert got == brute(list(zip(docs.doc_id, docs.text)))
