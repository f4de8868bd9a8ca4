"""Packing documents into sequences of tokens: concatenate and cut.

All documents are one stream of tokens, in the order of the partitions they are
read in. The first pass counts tokens: every document knows its place within
its partition, and the partitions' totals, summed up in order, give each
partition its place in the stream. The second pass cuts the stream at every
multiple of the sequence length; a document across a cut has a piece on either
side. No row is shuffled, and only the last sequence is not full.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, keyed, text_batches, write_shared

SEQUENCE_TOKENS, END_OF_DOCUMENT = 1024, 0

#: Names of tokens that are one id wherever they occur in a text.
NAMED_TOKENS = {"<|endoftext|>": 50256}

#: The ranks of the same vocabulary as byte_bpe_50k.json; `tests/llm` holds the ids against that file's.
TOKENIZER = "byte_bpe_50k.tiktoken"

#: Characters encoded at a time, tokens of a document in one row, and bytes of tokens in one batch.
PIECE_CHARS, ROW_TOKENS, BATCH_BYTES = 1 << 16, 1 << 16, 4 << 20


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=NAMED_TOKENS)


def _pieces(text: str) -> Iterator[str]:
    """``text`` cut where the vocabulary's pattern always begins a new word.

    That is at a single space between other characters, so never inside the
    name of a token. A text without one is one piece.
    """
    first = 0
    while len(text) - first > PIECE_CHARS:
        cut = first + PIECE_CHARS
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = len(text)
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        yield text[first:cut]
        first = cut
    yield text[first:]


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of a text, named tokens being their own ids, and the end of the document."""
    encoding = _encoding(path)
    parts = [np.array(encoding.encode(piece, allowed_special="all"), dtype="<u4") for piece in _pieces(text or "")]
    return np.concatenate([*parts, np.array([END_OF_DOCUMENT], dtype="<u4")])


def _tokens(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """First pass: ids of each document, and the tokens before it in its partition.

    Written out, so that the order of documents and their tokens is settled.
    """
    rows = keyed(docs, id_col, _text=text_col)
    id_type = rows.schema["_id"].dataType
    names = ["_part", "_before", "_id", "_start", "_doc_tokens", "_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0
        kinds = [pa.int32(), pa.int64(), None, pa.int64(), pa.int64(), pa.binary()]

        def out() -> pa.RecordBatch:
            columns = list(zip(*held))
            kinds[2] = id_kind
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            id_kind = batch["_id"].type
            for key, text in zip(batch["_id"], batch["_text"]):
                ids = encode(text.as_py(), path)
                for start in range(0, len(ids), ROW_TOKENS):
                    some = ids[start : start + ROW_TOKENS]
                    held.append((part, before, key.as_py(), start, len(ids), some.tobytes()))
                    before += len(some)
                    size += some.nbytes
                    if size > BATCH_BYTES:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    schema = f"_part int, _before long, _id {id_type.simpleString()}, _start long, _doc_tokens long, _ids binary"
    return write_shared(rows.mapInArrow(run, schema), "tokens")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A document's tokens are its text's ids and then id 0. The piece holds
    ``length`` of them from ``start`` on and lies at ``offset`` of its
    sequence; ``ids`` are little-endian unsigned 32-bit. All sequences but the
    last are full.

    A null or empty text is one token. Rows with null or repeated ids are
    documents of their own. Long texts are encoded in pieces, and a document of
    more than 65,536 tokens is cut there too. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    tokens = _tokens(docs, id_col, text_col, path)
    id_type = tokens.schema["_id"].dataType.simpleString()

    count = F.sum(F.octet_length("_ids") / 4).cast("long").alias("n")
    totals = tokens.groupBy("_part").agg(count).orderBy("_part").collect()  # one row per partition read
    bases = zip([r._part for r in totals], accumulate([r.n for r in totals], initial=0))
    placed = tokens.join(F.broadcast(spark.createDataFrame(list(bases), "_part int, _base long")), "_part")
    placed = placed.select("_id", "_start", "_doc_tokens", "_ids", (F.col("_base") + F.col("_before")).alias("_place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, *[pa.int64()] * 6, pa.binary()]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            kinds[0] = batch["_id"].type
            pieces = []
            for key, start, total, ids, place in zip(*(batch[c].to_pylist() for c in ("_id", "_start", "_doc_tokens", "_ids", "_place"))):
                done, size = 0, len(ids) // 4
                while done < size:
                    sequence, offset = divmod(place + done, sequence_tokens)
                    length = min(size - done, sequence_tokens - offset)
                    some = ids[4 * done : 4 * (done + length)]
                    pieces.append((key, start + done, length, zlib.crc32(some), total, sequence, offset, some))
                    done += length
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)

    schema = (
        f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, ids binary"
    )
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) with the ids of each sequence's pieces in order."""
    listed = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda acc, part: F.concat(acc, part["ids"]))
    return listed.select("sequence_id", "n_tokens", joined.alias("ids"))
