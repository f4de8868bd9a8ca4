import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from framesift.llm import collocations as col

SCHEMA = "text string, lang string, phrase string, score string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least=100, first=2000):
    langs = {}
    for text, lang, *_ in rows:
        f = langs.setdefault("und" if lang is None else lang, Counter())
        for words in split(text):
            for size in range(1, 6):
                f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, f in langs.items():
        n = sum(c for phrase, c in f.items() if len(phrase) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for q, c in candidates.items():
            for size in range(2, len(q)):
                dropped |= {q[i : i + size] for i in range(len(q) - size + 1) if 100 * c >= 100 * f[q[i : i + size]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (score, a, p, l, r, n) in enumerate(sorted(scored)[:first], 1):  # noqa: E741
            found.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(found)


def got(frame, **options):
    rows = col.mine_collocations(frame, **options)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in rows.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["The", "of", "a", "Ä", "é|", "日本", "b\x00", *(f"w{n}" for n in range(40))]
    weights = [1 / (n + 1) for n in range(len(words))]

    def text(n):
        return "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in rng.choices(words, weights, k=n))

    made = [(text(rng.randrange(1, 40)), rng.choice(["en", "fr", None, "und", "a\tb"]), "x", "y", "z") for _ in range(150)]
    made += [("in the course of time, in the course of", "en", None, None, None)] * 60
    made += [("x x x x x x x x x", "en", None, None, None)] * 5
    made += [(None, "en", None, None, None), ("", None, None, None, None), (text(20000), "fr", None, None, None), (" .;! ", "de", None, None, None)]
    return made


@pytest.mark.parametrize("options", [{}, {"group_words": 40}, {"group_words": 7}, {"hot_rows": 5}, {"first": 3}])
def test_equals_brute_force(spark, rows, options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(frame, least=8, **options) == brute(rows, 8, options.get("first", 2000))


def test_prefixes_are_divided(spark, rows):
    """Groups stay within the budget; slots over it go on to longer prefixes."""
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = col._texts(frame, "text", "lang")
    plan = col._plan(texts, col._count_words(texts), 8, 5, 60, 128)
    assert len(plan.groups) == 4 and all((g < 0).any() for g in plan.groups[:-1])
    loads = Counter()
    for batch in texts.toArrow().to_batches():
        for suffixes in col._suffixes(plan, [batch]):
            depth, _, group = plan.dealt(suffixes)
            loads.update(zip(group.tolist(), depth.tolist()))
    assert len(loads) > 20 and all(n <= 60 for (_, depth), n in loads.items() if depth < 3)
    counted = col._count_phrases(texts, plan, 8)
    whole = col.Plan(plan.bits, 5, [np.zeros(1, dtype=np.int32)])
    assert sorted(counted.collect()) == sorted(col._count_phrases(texts, whole, 8).collect())


def test_packing():
    loads = np.array([5, 90, 40, 0, 101, 60])
    groups = col.packed(loads, 100, 7)
    assert groups[4] == -1 and groups.min() == -1 and sorted(set(groups) - {-1})[0] == 7
    assert all(loads[groups == g].sum() <= 100 for g in set(groups) - {-1})


def test_small_holds(rows, monkeypatch):
    """Looking at few texts at a time finds the same suffixes."""
    plan = col.Plan(np.full(8, 255, dtype=np.uint8), 5, [np.zeros(16, dtype=np.int32)])
    batch = pa.RecordBatch.from_pydict({"text": [r[0] for r in rows], "lang": [r[1] or "und" for r in rows]})

    def summed():
        total = Counter()
        for s in col._suffixes(plan, [batch.slice(i, 20) for i in range(0, len(rows), 20)]):
            total.update((s.lang, *(s.names[w] for w in row if w >= 0)) for row in s.words.tolist())
        return total

    whole = summed()
    monkeypatch.setattr(col, "HELD_WORDS", 30)
    assert summed() == whole and sum(whole.values()) > 1000 and {len(k) for k in whole} == {3, 4, 5, 6}


@pytest.mark.parametrize("most", [0, 1, 255, 256, 70000, 2**30])
def test_planes(most):
    numbers = np.random.default_rng(1).integers(0, most + 1, (17, 5))
    numbers[3, 2] = most
    assert (col._from_planes(col._planes(numbers), 5) == numbers).all()


def test_arithmetic_is_exact(spark):
    big = 10**14 - 3
    frame = spark.createDataFrame([(big, big - 5, 10**5 + 7, 10**5 + 9)], "a long, n long, l long, r long")
    exact = "({0} * {1} * 1000BD) div ({2} * {3})".format(*(f"cast({c} as decimal(15, 0))" for c in "anlr"))
    small = 10**9
    frame = frame.selectExpr(f"a div {small} as a", "n", "l", "r")
    assert frame.selectExpr(f"{exact} as s").first().s == 1000 * (big // small) * (big - 5) // ((10**5 + 7) * (10**5 + 9))


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([("a b", None, None, None, None)], SCHEMA)) == []


def test_whole_table(spark, sf):
    from framesift.llm.queries import op12_collocations

    docs = pd.read_parquet(f"{sf}/documents.parquet")[["text", "lang"]].values.tolist()
    assert sorted(tuple(r) for r in op12_collocations(spark, sf).collect()) == brute(docs)
