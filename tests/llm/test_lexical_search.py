import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from framesift.llm import lexical_search as lexical

DOCS = "doc_id long, text string, score string, item_id string"
ITEMS = "item_id long, text string, set string, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(key, Counter(split(text))) for key, text, *_ in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    held = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text, *_ in items:
        hits = []
        for key, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = 0
            for t in set(split(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                hits.append((-score, key is None, key or 0))
        for rank, (score, none, key) in enumerate(sorted(hits)[:k], 1):
            found.append((item, rank, None if none else key, -score))
    return sorted(found, key=str)


def got(spark, docs, items, parts=4, **options):
    d, i = spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS)
    return sorted([tuple(r) for r in lexical.rank_documents(d, i, **options).collect()], key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    words = [f"w{n}" for n in range(150)] + ["ÄÖ", "éa", "A1", "日本"]
    weights = [1 / (n + 1) for n in range(len(words))]
    text = lambda n: rng.choice([" ", ", ", "\x00", "-"]).join(rng.choices(words, weights, k=n))
    docs = [(n, text(rng.randrange(1, 60)), "clash", "clash") for n in range(250)]
    common = text(30)
    docs += [(300 + n, common, None, None) for n in range(120)]
    docs += [(900, None, None, None), (901, "", None, None), (902, " .,;", None, None), (903, text(20000), None, None)]
    docs += [(5, docs[5][1], None, None), (None, docs[6][1], None, None), (None, common, None, None)]
    items = [(n, text(rng.randrange(1, 25)), "clash", None) for n in range(40)]
    items += [(50 + n, common + " w1 w2", None, None) for n in range(30)]
    items += [(90, None, None, None), (91, "!", None, None), (92, "nowhere", None, None), (3, "w1", None, None), (None, "w2 W2", None, None)]
    return docs, items


@pytest.mark.parametrize(
    "options", [{}, {"pass_bytes": 3000}, {"graph_items": 7}, {"hot_rows": 9}, {"k": 1}, {"k": 1000}]
)
def test_equals_brute_force(spark, tables, options):
    assert got(spark, *tables, **options) == brute(*tables, k=options.get("k", 10))


def test_cuts_change_nothing(spark, tables, monkeypatch):
    docs, items = tables
    graph = lexical.assembled(lexical.share([(str(n).encode(), lexical.terms(t)) for n, (_, t, *_) in enumerate(items) if lexical.terms(t)]))
    known = {t: n for n, t in enumerate(graph.terms)}
    rng = np.random.default_rng(2)
    scorer = lexical.Scorer([graph], known, rng.integers(0, 99, len(known)), 9, 300)
    counts = [Counter(known[t] for t in lexical.terms(text) if t in known) for _, text, *_ in docs[:50]]
    lists = [sum(c.values()) for c in counts], *([np.array(list(f(c)), dtype=k).tobytes() for c in counts] for f, k in ((Counter.keys, "<i4"), (Counter.values, "<i8")))
    whole = next(scorer.batch(*lists))[2]
    monkeypatch.setattr(lexical, "SUMS", 3 * graph.size)
    pieces = list(scorer.batch(*lists))
    assert len(pieces) == 17 and (np.concatenate([p[2] for p in pieces], axis=1) == whole).all()


def test_shared_sets_are_summed_once(tables):
    """Every item is the sum of its own terms, in fewer additions than one by one."""
    sets = [(str(n).encode(), sorted(set(lexical.terms(t)))) for n, (_, t, *_) in enumerate(tables[1]) if lexical.terms(t)]
    nodes = lexical.share(sets)
    graph = lexical.assembled(nodes)
    sums = graph.sums(np.eye(len(graph.terms), dtype=np.int64))
    for (name, _), row in zip(graph.items, sums):
        assert [t for t, n in zip(graph.terms, row) for _ in range(n)] == dict(sets)[name]
    additions = sum(len(children) - 1 for _, children, _, _ in nodes if children)
    assert additions < 0.6 * sum(len(words) - 1 for _, words in sets)
    parents = Counter(child for _, children, _, _ in nodes for child in children)
    inner = {node for node, children, _, _ in nodes if children}
    assert sum(parents[node] > 1 for node in inner) > 5


def test_terms():
    for text in ("Ab-1_c É\x7fx\u0080y İ", "", None, "a\x00b"):
        assert [t.decode() for t in lexical.terms(text)] == split(text)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    assert got(spark, [(1, None, None, None)], items) == []


def test_whole_table(spark, sf):
    from framesift.llm.queries import op11_lexical_search

    docs = pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]].values.tolist()
    items = pd.read_parquet(f"{sf}/benchmark.parquet")[["item_id", "text"]].values.tolist()
    rows = op11_lexical_search(spark, sf)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in rows.collect()], key=str) == brute(docs, items)
