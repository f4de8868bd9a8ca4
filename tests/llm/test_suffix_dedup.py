import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from framesift.llm import suffix_dedup as dedup
from framesift.llm.suffix_array import lyndon_groups, suffix_array

SCHEMA = "doc_id long, text string, kept string"


def brute(rows, length):
    seen, out = set(), {}
    for key, text, *_ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, dtype=bool)
        for start in range(len(data) - length + 1):
            window = data[start : start + length]
            if window in seen:
                covered[start : start + length] = True
            seen.add(window)
        covered = covered[:-1]
        kept = np.frombuffer(data, dtype=np.uint8)[~covered].tobytes()
        spans = int((np.diff(np.append(0, covered.astype(int))) == 1).sum())
        out[key] = (len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in list(range(30)) * 4:
        codes = [rng.randint(1, letters) for _ in range(n)] + [0]
        assert suffix_array(codes) == sorted(range(len(codes)), key=lambda i: codes[i:])


def test_groups_are_lyndon_prefixes():
    codes = [ord(c) for c in "bananabandbandanabanana"] + [0]

    def lyndon(i):  # the longest prefix smaller than all its own suffixes
        return max(
            (codes[i:j] for j in range(i + 1, len(codes) + 1) if all(codes[i:j] < codes[k:j] for k in range(i + 1, j))), key=len
        )

    group, _ = lyndon_groups(codes)
    words = {g: {tuple(lyndon(i)) for i, x in enumerate(group) if x == g} for g in set(group)}
    assert all(len(w) == 1 for w in words.values())
    assert sorted(words) == sorted(words, key=lambda g: next(iter(words[g])))


def rows_of(seed, length):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passages = [text(rng.randint(length // 2, 4 * length)) for _ in range(6)]
    line = text(length - 8)
    rows = [(0, None), (1, ""), (2, "x" * (length - 1)), (3, "x" * (5 * length)), (4, "ab" * (3 * length))]
    for key in range(5, 60):
        parts = [text(rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, length))]
        if rng.random() < 0.6:
            parts += [line, text(40)]
        rows.append((key, "".join(parts)))
    base = text(6 * length)
    rows += [(60 + i, base[: 50 * i % len(base)] + "#" + base[50 * i % len(base) :]) for i in range(12)]
    rows += [(80 + i, rows[7][1]) for i in range(4)]
    return [(k, t, "clash") for k, t in rows]


@pytest.mark.parametrize("length, anchor, most", [(100, 32, 4096), (100, 32, 2), (24, 8, 3), (16, 16, 2)])
def test_equals_brute_force(spark, length, anchor, most, monkeypatch):
    rows = rows_of(length, length)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = dedup.remove_repeats(frame, length=length, anchor=anchor, most_contexts=most)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    seen = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()}
    assert seen == brute(rows, length)


def test_pieces_of_long_texts(monkeypatch):
    data = ("word " * 30 + "other text " * 9).encode() * 4
    whole = [np.concatenate(c) for c in zip(*dedup.contexts(data))]
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[2], whole[3])])
    monkeypatch.setattr(dedup, "PIECE", 64)
    cut = [np.concatenate(c) for c in zip(*dedup.contexts(data))]
    assert (windows == np.arange(len(data) - 99)).all()
    assert (np.repeat(whole[0], whole[3] - whole[2] + 1) == np.repeat(cut[0], cut[3] - cut[2] + 1)).all()


@pytest.mark.parametrize("length, anchor, most", [(100, 32, 4096), (24, 8, 3)])
def test_equals_brute_force_in_pieces(spark, length, anchor, most, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE", 64)
    rows = rows_of(length, length)
    rng = random.Random(5)
    once = "".join(rng.choice("abcdefgh") for _ in range(20 * length))
    rows += [(200, once + rows[20][1] + "-" * 3 + once, None), (201, "".join(reversed(once)) * 3, None)]
    got = dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length, anchor=anchor, most_contexts=most)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute(rows, length)


def test_repeats_within_a_document_longer_than_a_piece(spark):
    rng = random.Random(2)
    passage, between = ("".join(rng.choices("abcdefghijkl ", k=n)) for n in (3000, dedup.PIECE + 1000))
    rows = [(1, passage + between + passage + between[:500], None), (2, "other " + passage[:400], None)]
    got = dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    seen = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert seen[1][1] == 3500 and seen == brute(rows, 100)


def test_odd_ids_and_empty_table(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(150))
    rows = [(None, text, None), (None, text, None), (7, text, None), (7, "x", None)]
    got = dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(1, 0), (150, 0), (150, 150), (150, 150)]
    assert dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf):
    from framesift.llm.queries import op8_suffix_dedup

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_dedup(spark, sf).collect()}
    assert got == brute(list(zip(docs.doc_id, docs.text)), 100)


@pytest.mark.parametrize("kind", ["null", "repeated", "string"])
def test_earlier_is_by_id_not_by_read_order(spark, kind):
    """Equal texts read in falling order of their ids: the smallest id keeps its text, null ids are last."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    other = "".join(rng.choice("ijklmnop ") for _ in range(150))
    ids = {"null": [None, 9, 5, 3, 1], "repeated": [7, 7, 5, 3, 1], "string": ["b", "aa", "a", "Z", "B"]}[kind]
    schema = f"doc_id {'string' if kind == 'string' else 'long'}, text string, kept string"
    rows = [(i, text, None) for i in ids] + [(ids[1], other, None), (ids[0], other, None)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        frame = spark.createDataFrame(order, schema).repartition(1).unionAll(spark.createDataFrame([], schema))
        got = [(r.doc_id, r.n_bytes, r.n_removed) for r in dedup.remove_repeats(frame).collect()]
        whole = {(i, n == 0) for i, size, n in got if size == 300}
        first = min(i for i in ids if i is not None)
        assert whole == {(i, i == first) for i in ids} and all(n in (0, size) for _, size, n in got)
        again = sorted((n, str(i)) for i, size, n in got if size == 150)
        assert [n for n, _ in again] == [0, 150]
        if kind == "null":
            assert again == [(0, "9"), (150, "None")]


def test_row_keys_are_in_order_of_ids(spark):
    from framesift.llm.common import ROW, with_row_key

    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), str(rng.random())) for _ in range(500)] + [(3, "x")] * 200
    frame = spark.createDataFrame(rows, "id long, t string").repartition(7)
    keyed = sorted((r[ROW], r.id) for r in with_row_key(frame, "id").collect())
    ids = [i for _, i in keyed]
    assert ids == sorted(ids, key=lambda i: (i is None, i)) and len({k for k, _ in keyed}) == 700
