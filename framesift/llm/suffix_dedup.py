"""Repeated passages, found in suffix arrays and cut out byte by byte.

Equal windows of ``length`` bytes are brought together by their anchor: of the
short strings in a window the one with the least hash, the first if equal, so
that equal windows have the same anchor at the same place. The windows of a
document that share an anchor are one context. Contexts that occur again as a
whole are settled by their digest. Different contexts of one anchor may still
share windows: they are put one after the other, their suffixes sorted by
linear grouping (see `suffix_array`), and neighbours in that order compared.

An anchor in more contexts than a suffix array should have is told apart by the
bytes around it: a window that reaches `slack` bytes beyond what is known to be
equal has half of them on one side at least. Nothing is sampled or cut off.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import ROW, drop_written, keyed, shuffle_partitions, text_batches, write_shared
from framesift.llm.suffix_array import suffix_array

#: Bytes of a window and of an anchor.
LENGTH, ANCHOR = 100, 32

#: Windows of a document looked at together.
PIECE = 1 << 20

#: Contexts of an anchor in one suffix array at most, and bytes after which contexts of the next anchor go to another one.
MOST_CONTEXTS, ARRAY_BYTES = 4096, 4096

#: Contexts handed on together.
BATCH_CONTEXTS = 1 << 16

#: Bytes of contexts in one task.
TASK_BYTES = 1 << 20

_MIX = 0x9E3779B97F4A7C15


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) from each place on."""
    with np.errstate(over="ignore"):
        values = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
        n = 1
        while n < size:
            factor = np.uint64(pow(_MIX, 2 * n + 1, 1 << 64))
            values = (values[:-n] * factor) ^ (values[n:] + (values[n:] >> np.uint64(29)))
            n *= 2
        values ^= values >> np.uint64(31)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        return values ^ (values >> np.uint64(29))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of the ``size`` values from each place on, the first if equal."""
    place, n = np.arange(len(values)), 1
    while 2 * n <= size:
        a, b = place[:-n], place[n:]
        place = np.where(values[b] < values[a], b, a)
        n *= 2
    a, b = place[: len(values) - size + 1], place[size - n : len(values) - n + 1]
    return np.where(values[b] < values[a], b, a)


def contexts(
    data: bytes, length: int = LENGTH, anchor: int = ANCHOR, piece: int | None = None
) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, anchor place, first window, last window) of each run of windows with the same anchor."""
    piece = piece or PIECE
    for first in range(0, max(0, len(data) - length + 1), piece):
        some = np.frombuffer(data, dtype=np.uint8, offset=first, count=min(len(data) - first, piece + length - 1))
        values = _hashes(some, anchor)
        place = _least(values, length - anchor + 1)
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        end = np.append(start[1:], len(place)) - 1
        yield values[place[start]], place[start] + first, start + first, end + first


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap made one. Returned in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, dtype=bool)
    return starts[new], ends[np.append(new[1:], True)] if len(ends) else ends


_PLACES = f"anchor long, digest long, {ROW} long, place int, start int, size int, repeat boolean"


def _places(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """Each document's contexts; of those it repeats itself only the first, and the others as ``repeat``.

    Contexts are read in pieces, but repeats looked for in all pieces of a document.
    """
    piece = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            held: list[tuple] = []
            count = 0
            for row, text in zip(batch[ROW].to_pylist(), batch["_text"]):
                data = (text.as_py() or "").encode()
                read: list[tuple] = []
                for h, place, start, end in contexts(data, length, anchor, piece):
                    size = (end - start + length).astype(np.int32)
                    c = np.array([digest(data[s : s + n]) for s, n in zip(start.tolist(), size.tolist())], dtype=np.uint64)
                    read.append((h, c, place.astype(np.int32), start.astype(np.int32), size))
                if not read:
                    continue
                h, c, place, start, size = read[0] if len(read) == 1 else map(np.concatenate, zip(*read))
                order = np.lexsort((c, h))  # keeps the order of equal contexts
                equal = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
                repeat = np.zeros(len(h), dtype=bool)
                repeat[order[1:][equal]] = True
                held.append((h.view(np.int64), c.view(np.int64), np.full(len(h), row), place, start, size, repeat))
                count += len(h)
                if count > BATCH_CONTEXTS:
                    yield from _cut(_arrow(held))
                    held, count = [], 0
            if held:
                yield from _cut(_arrow(held))

    def _cut(made: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (made.slice(i, BATCH_CONTEXTS) for i in range(0, made.num_rows, BATCH_CONTEXTS))

    def _arrow(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        names = ["anchor", "digest", ROW, "place", "start", "size", "repeat"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds)], names)

    return rows.select(ROW, "_text").mapInArrow(run, _PLACES)


def _window_keys(text: bytes, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place of ``text`` on."""
    size = 1 << (length.bit_length() - 1)
    part = _hashes(np.frombuffer(text, dtype=np.uint8), size)
    with np.errstate(over="ignore"):
        return part[: len(text) - length + 1] * np.uint64(_MIX) + part[length - size :]


def may_share(groups: np.ndarray, items: list[bytes], length: int) -> np.ndarray:
    """Whether an item may have a window in common with another of its group, by hashes of all windows.

    Items for which this is false need no place in a suffix array.
    """
    text = b"".join(items)
    sizes = np.array([len(data) for data in items])
    kept = np.zeros(len(items), dtype=bool)
    if len(text) < length:
        return kept
    ends = np.cumsum(sizes)
    item = np.repeat(np.arange(len(items)), sizes)[: len(text) - length + 1]
    inside = np.arange(len(item)) + length <= ends[item]
    keys, item = _window_keys(text, length)[inside], item[inside]
    order = np.lexsort((keys, groups[item]))
    keys, item = keys[order], item[order]
    same = (keys[1:] == keys[:-1]) & (groups[item[1:]] == groups[item[:-1]])
    kept[item[1:][same]] = True
    kept[item[:-1][same]] = True
    return kept


#: Codes of bytes in a suffix array: 0 ends it and 1 ends an item. No UTF-8 text has the two highest bytes.
_CODES = bytes(min(c + 2, 255) for c in range(256))


def shared_windows(items: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(item, from, to): spans of windows that an earlier item has too.

    An item is (row, start, bytes), and earlier means a smaller row, or the
    same with a smaller start of the window. Only windows wholly inside an item
    are compared; all of them are, by their neighbours in the suffix array.
    """
    text = b"\x01".join(data.translate(_CODES) for _, _, data in items) + b"\x01\x00"
    sizes = np.array([len(data) + 1 for _, _, data in items] + [1])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(items) + 1), sizes)
    at = np.arange(len(text)) - begins[owner]
    whole = at + length < sizes[owner]  # a size counts the end of the item
    order = np.array(suffix_array(list(text)))
    order = order[whole[order]]

    found: list[tuple[int, int]] = []
    same: list[tuple[int, int, int]] = []  # (row, start, item) of equal windows

    def settle() -> None:
        if len(same) > 1:
            first = min(same)[:2]
            found.extend((item, start) for row, start, item in same if (row, start) != first)

    last = b""
    for suffix, item, place in zip(order.tolist(), owner[order].tolist(), at[order].tolist()):
        window = text[suffix : suffix + length]
        if window != last:
            settle()
            same, last = [], window
        row, start, _ = items[item]
        same.append((row, start + place, item))
    settle()

    spans: list[tuple[int, int, int]] = []
    found.sort()
    for item, start in found:
        if spans and spans[-1][0] == item and spans[-1][2] >= start:
            spans[-1] = (item, spans[-1][1], start + length)
        else:
            spans.append((item, start, start + length))
    return spans


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that were written out and are gone."""
    gc.collect()
    spark._jvm.System.gc()


def _read_contexts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """``wanted`` (anchor, row key, place, start, size) and the contexts' bytes, ``data``."""
    listed = wanted.groupBy(ROW).agg(F.collect_list(F.struct("anchor", "place", "start", "size")).alias("wanted"))
    joined = rows.select(ROW, "_text").join(listed.hint("merge"), ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", ROW, "place", "start", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for row, text, want in zip(batch[ROW], batch["_text"], batch["wanted"]):
                data, row = (text.as_py() or "").encode(), row.as_py()
                anchor, place, start, size = (want.values.field(k).to_pylist() for k in range(4))
                for i in range(0, len(anchor), 32768):
                    part = slice(i, i + 32768)
                    cut = [data[s : s + n] for s, n in zip(start[part], size[part])]
                    columns = [anchor[part], [row] * len(cut), place[part], start[part], cut]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return joined.mapInArrow(run, f"anchor long, {ROW} long, place int, start int, data binary")


def _sharing(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[str, int, int, bytes]]:
    """The rows (group, row key, start, data), in order of their groups, that `may_share` with another."""
    held: list[tuple] = []
    size = 0

    def kept() -> list[tuple]:
        names = np.unique([group for group, _, _, _ in held], return_inverse=True)[1]
        chosen = may_share(names, [data for _, _, _, data in held], length)
        return [row for row, some in zip(held, chosen) if some]

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("group", ROW, "start", "data"))):
            if size > TASK_BYTES and row[0] != held[-1][0]:
                yield from kept()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield from kept()


def _sorted_spans(groups: DataFrame, length: int, tasks: int) -> DataFrame:
    """(row key, start, end) from the suffix arrays of groups (group, row key, start, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, bytes]] = []
        size, current = 0, None

        def out(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
            spans = shared_windows(items, length)
            if not spans:
                return None
            columns = [[items[i][0] for i, _, _ in spans], [a for _, a, _ in spans], [b for _, _, b in spans]]
            kinds = [pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [ROW, "start", "end"])

        for group, row, start, data in _sharing(batches, length):
            if group != current and size > ARRAY_BYTES:
                if (made := out(waiting)) is not None:
                    yield made
                waiting, size = [], 0
            current = group
            waiting.append((row, start, data))
            size += len(data)
        if waiting and (made := out(waiting)) is not None:
            yield made

    dealt = groups.select("group", ROW, "start", "data").repartition(tasks, "group").sortWithinPartitions("group", ROW, "start")
    return dealt.mapInArrow(run, f"{ROW} long, start long, end long")


def _large_groups(found: DataFrame, length: int, anchor: int, most: int) -> list[DataFrame]:
    """Spans from anchors with more than ``most`` contexts, told apart by the bytes around the anchor.

    ``found`` has (anchor, row key, place, start, data). Each round knows
    ``left`` bytes before and ``right`` bytes after the anchor to be equal. Of
    the ``slack`` bytes that a window has beyond these, more than half lie on
    one side, so every context goes to two groups, and equal windows meet in one.
    """
    spark = found.sparkSession
    spans = []
    rows = found.select(
        F.col("anchor").cast("string").alias("group"), ROW, "place", "start", "data",
        F.lit(0).alias("left"), F.lit(0).alias("right"),
    )
    while True:
        sizes = rows.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = write_shared(sizes, "group-sizes")
        rows = rows.join(sizes.hint("merge"), "group")
        rows = write_shared(rows, "groups")
        total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        tasks = max(1, -(-total // TASK_BYTES))
        spans.append(_sorted_spans(rows.filter(F.col("n") <= most), length, tasks))
        slack = F.lit(length - anchor) - F.col("left") - F.col("right")
        large = rows.filter(F.col("n") > most).withColumn("slack", slack)
        # with no slack left, all contexts of a group share one window: the first has it, the others repeat it
        whole = large.filter("slack = 0").withColumn("window", F.col("place") - F.col("left"))
        first = whole.groupBy("group").agg(F.min(F.struct(ROW, "window")).alias("first"))
        whole = whole.join(write_shared(first, "first-windows").hint("merge"), "group")
        whole = whole.filter(F.struct(ROW, "window") != F.col("first"))
        spans.append(whole.select(ROW, F.col("window").cast("long").alias("start"), (F.col("window") + length).cast("long").alias("end")))
        large = large.filter("slack > 0")
        if large.isEmpty():
            return spans
        # slack s: more than (s - 1) / 2 of it before the anchor, or at least s - that after it
        before, after = F.ceil(F.col("slack") / 2).cast("int"), F.floor(F.col("slack") / 2).cast("int") + 1
        offset = F.col("place") - F.col("start")
        lefts = large.withColumn("left", F.col("left") + before).withColumn("side", F.lit("L"))
        rights = large.withColumn("right", F.col("right") + F.least(after, F.col("slack"))).withColumn("side", F.lit("R"))
        both = lefts.unionAll(rights)
        there = (F.col("left") <= offset) & (offset + anchor + F.col("right") <= F.octet_length("data"))
        known = F.substring("data", offset - F.col("left") + 1, F.col("left") + F.col("right") + anchor)
        rows = both.filter(there).select(
            F.concat_ws("/", "group", "side", F.xxhash64(known).cast("string"), F.hash(known).cast("string")).alias("group"),
            ROW, "place", "start", "data", "left", "right",
        )
        rows = write_shared(rows, "finer-groups")
        _free_shuffles(spark)


def repeated_spans(
    rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """(row key, start, end): spans of bytes covered by windows that also start earlier. They may overlap.

    ``rows`` has the row key and ``_text``. Earlier means a smaller row key, or
    the same row and a smaller start.
    """
    spark = rows.sparkSession
    places = write_shared(_places(rows, length, anchor), "contexts")
    once = places.filter("NOT repeat").drop("repeat")
    end = (F.col("start") + F.col("size")).cast("long").alias("end")
    spans = [write_shared(places.filter("repeat").select(ROW, F.col("start").cast("long").alias("start"), end), "own-repeats")]

    again = once.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    again = write_shared(again, "repeated-anchors")
    candidates = write_shared(once.join(again.hint("merge"), "anchor", "left_semi"), "candidates")
    drop_written(places)
    _free_shuffles(spark)

    firsts = candidates.groupBy("anchor", "digest").agg(F.min(ROW).alias("first"), F.count("*").alias("copies"))
    firsts = write_shared(firsts, "first-contexts")
    kinds = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    kinds = write_shared(kinds, "mixed-anchors")
    copied = firsts.filter("copies > 1").select("anchor", "digest", "first")
    copies = candidates.join(copied.hint("merge"), ["anchor", "digest"]).filter(F.col(ROW) != F.col("first"))
    spans.append(write_shared(copies.select(ROW, F.col("start").cast("long").alias("start"), end), "copies"))

    mixed = firsts.join(kinds.hint("merge"), "anchor").select("anchor", "digest", F.col("first").alias(ROW), "kinds")
    mixed = candidates.join(mixed.hint("merge"), ["anchor", "digest", ROW])
    mixed = write_shared(mixed.select("anchor", ROW, "place", "start", "size", "kinds"), "mixed-contexts")
    _free_shuffles(spark)
    if mixed.isEmpty():
        return spans[0].unionAll(spans[1])

    total = mixed.agg(F.sum("size").alias("n")).first().n
    tasks = max(shuffle_partitions(spark), -(-total // TASK_BYTES))
    few = _read_contexts(mixed.filter(F.col("kinds") <= most_contexts), rows)
    few = few.select(F.col("anchor").cast("string").alias("group"), ROW, "start", "data")
    spans.append(write_shared(_sorted_spans(few, length, tasks), "sorted-spans"))
    _free_shuffles(spark)
    many = mixed.filter(F.col("kinds") > most_contexts)
    if not many.isEmpty():
        many = write_shared(_read_contexts(many, rows), "large-groups")
        spans += [write_shared(s, "sorted-spans") for s in _large_groups(many, length, anchor, most_contexts)]
        _free_shuffles(spark)
    result = spans[0]
    for some in spans[1:]:
        result = result.unionAll(some)
    return result


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    most_contexts: int = MOST_CONTEXTS,
) -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    Removed is each byte of the UTF-8 text covered by a string of ``length``
    bytes that also starts earlier: in a document with a smaller id, or in the
    same one further left. Strings are judged on the input, and overlaps count.
    ``kept`` has the bytes that remain, one after the other; they may be no
    valid UTF-8.

    A null text is empty. Null ids come after all others; rows of one id, or
    with none, are ordered by a hash of their contents (`with_row_key`), whatever order
    they are read in. Long texts are read in pieces. An empty table gives an empty result. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    rows = keyed(docs, id_col, _text=text_col)
    id_type = rows.schema["_id"].dataType.simpleString()
    spans = repeated_spans(rows, length, anchor, most_contexts)
    listed = spans.groupBy(ROW).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(listed.hint("merge"), ROW, "left")
    keep_row = ROW in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [ROW, id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            made = []
            for text, starts, ends in zip(batch["_text"], batch["starts"], batch["ends"]):
                data, removed, n = (text.as_py() or "").encode(), 0, 0
                kept = data
                if starts.is_valid:
                    a, b = _merge(*(np.array(x.as_py(), dtype=np.int64) for x in (starts, ends)))
                    removed, n = int((b - a).sum()), len(a)
                    kept = b"".join(data[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)]))
                made.append((len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
            if made:
                yield pa.RecordBatch.from_arrays([batch[ROW], batch["_id"], *columns], names)

    schema = (
        f"{ROW} long, `{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    result = joined.select(ROW, "_id", "_text", "starts", "ends").mapInArrow(run, schema)
    return result if keep_row else result.drop(ROW)
