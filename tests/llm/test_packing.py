import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framesift.llm import packing

SCHEMA = "doc_id long, text string, start string"
LONG = "Wörter und words\n\nof 12,5 text  here. " * 400


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, texts, tokenizer, size=1024):
    """Every id in exactly one piece, sequences gapless and full; the tokenizer's own ids."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        place = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == place and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[place : place + r.length].tobytes())
            place += r.length
        assert place == len(ids)
    filled = {}
    for key, pieces in by_sequence.items():
        place = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        filled[key] = place
    assert sorted(filled) == list(range(len(filled)))
    assert all(filled[k] == size for k in range(len(filled) - 1)) and filled[len(filled) - 1] <= size


def test_planted(spark, tokenizer, monkeypatch):
    texts = {1: None, 2: "", 3: " ", 4: "a", 5: LONG, 6: "x" * 5000, 7: "<|endoftext|> b", 8: LONG, 9: "\n\n  \t x", 10: "日本 語"}
    frame = spark.createDataFrame([(k, v, None) for k, v in texts.items()], SCHEMA).repartition(3)
    pieces = packing.pack(frame, sequence_tokens=64)
    checked(pieces.collect(), texts, tokenizer, 64)
    joined = packing.sequences(pieces).orderBy("sequence_id").collect()
    stream = b"".join(r.ids for r in joined)
    assert sum(r.n_tokens for r in joined) * 4 == len(stream)


def test_named_tokens(tokenizer, monkeypatch):
    """At starts, ends and cuts of pieces, next to spaces, repeated and in part."""
    name = "<|endoftext|>"
    texts = [name, f"a{name}b", f"{name} b  {name}", f"{name}{name}", f"x  {name}  y\n{name}\n\nz", name[:-2], f" {name[1:]} {name}"]
    path = public_tokenizers.path(packing.TOKENIZER)
    for size in (1 << 16, 3, 20):
        monkeypatch.setattr(packing, "PIECE_CHARS", size)
        for text in [*texts, f"one two {name} three four{name}five six " * 40]:
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert packing.encode(text, path).tolist() == [*want, 0]
    assert 50256 in packing.encode(f"a{name}b", path)


def test_cuts_do_not_change_ids(tokenizer, monkeypatch):
    path = public_tokenizers.path(packing.TOKENIZER)
    whole = packing.encode(LONG, path)
    monkeypatch.setattr(packing, "PIECE_CHARS", 50)
    assert len(list(packing._pieces(LONG))) > 100 and "".join(packing._pieces(LONG)) == LONG
    assert (packing.encode(LONG, path) == whole).all() and list(whole[:-1]) == tokenizer.encode(LONG, add_special_tokens=False).ids


def test_odd_ids_and_empty_table(spark, tokenizer):
    frame = spark.createDataFrame([(None, "a b", None), (5, "a b", None), (5, "c", None)], SCHEMA)
    rows = packing.pack(frame).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t).ids) + 1 for t in ("a b", "a b", "c"))
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf, tokenizer):
    from framesift.llm.queries import op7_packing

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    checked(op7_packing(spark, sf).collect(), dict(zip(docs.doc_id, docs.text)), tokenizer)
