"""Near duplicates by SimHash, searched in a hierarchical index in Gray order.

Fingerprints in the order of their Gray rank have neighbours that share most of
their bits. The index factors these shared bits, as a mask and a pattern, into
upper nodes, each node holding only the bits that its parent does not. A search
adds up the differing bits on the way down and leaves out a whole group as soon
as they exceed the limit.

The top level is spread over the cluster. With a limit of k bits and the 64
bits cut into m > k segments, any two fingerprints to be linked agree on m - k
segments at least. Every choice of m - k segments is one mask; fingerprints with
the same pattern under it are one top node, and only inside it, where the
difference is still zero, can links be left. The lower levels are built by the
task that holds the node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, keyed, shuffle_partitions, text_batches, with_row_key, write_shared
from framesift.operators.components import connected_groups
from framesift.operators.keys import filter_by_keys
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42

#: Bytes of a text split into words at a time.
PIECE_BYTES = 1 << 20

#: Children of a node.
FANOUT = 16

#: Fingerprints a top node may have to be searched by one task. Beyond it, its
#: members meet at the values one bit away from them, without any comparison.
NODE_FINGERPRINTS = 32768

#: Fingerprints a task holds beside those of its largest node, and queries it looks up at a time.
TASK_FINGERPRINTS, QUERIES_AT_ONCE = 200_000, 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONES = np.uint64(2**64 - 1)


def _word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data``, in lists from pieces of bounded size cut at white space."""
    first = 0
    while len(data) - first > PIECE_BYTES:
        piece = data[first : first + PIECE_BYTES]
        cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:  # one word fills the piece: take as many pieces as it needs
            rest = data[first:].split(None, 1)
            yield rest[:1]
            first = len(data) - len(rest[1]) if len(rest) > 1 else len(data)
            continue
        yield piece[:cut].split()
        first += cut + 1
    yield data[first:].split()


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text; zero if it has no words."""
    data = (text or "").encode().translate(_LOWER)
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(shingles: list[bytes]) -> None:
        nonlocal total
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        for i in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[:] += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for piece in _word_pieces(data):
        listed = tail + piece
        if len(listed) >= words:
            if words == 3:
                add([b"%b %b %b" % s for s in zip(listed, listed[1:], listed[2:])])
            else:
                add([b" ".join(listed[i : i + words]) for i in range(len(listed) - words + 1)])
        tail = listed[-(words - 1) :] if words > 1 else []
    if not total and tail:
        add([b" ".join(tail)])
    if not total:
        return 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(row key, _id, _fp) with the fingerprint as a signed long."""
    text_batches(docs.sparkSession)
    rows = keyed(docs, id_col, _text=text_col)
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(text.as_py(), words) for text in batch["_text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch[ROW], batch["_id"], pa.array(values.view(np.int64))], [ROW, "_id", "_fp"])

    return rows.mapInArrow(run, f"{ROW} long, _id {id_type}, _fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order below levels of nodes with ever wider masks of shared bits."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        masks, patterns = [np.full(len(values), _ONES)], [self.values]
        while len(masks[-1]) > FANOUT:
            starts = np.arange(0, len(masks[-1]), FANOUT)
            first = np.repeat(patterns[-1][starts], np.diff(np.append(starts, len(masks[-1]))))
            common = np.bitwise_and.reduceat(masks[-1], starts)
            common &= ~np.bitwise_or.reduceat(patterns[-1] ^ first, starts)
            masks.append(common)
            patterns.append(patterns[-1][starts] & common)
        #: From the top down: the pattern of each node, and the bits of its mask that its parent's lacks.
        self.levels = []
        for depth in range(len(masks) - 1, -1, -1):
            own = masks[depth]
            if depth + 1 < len(masks):
                own = own & ~np.repeat(masks[depth + 1], FANOUT)[: len(own)]
            self.levels.append((patterns[depth], own))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, place of a value) of all pairs within ``limit`` bits."""
        query = np.repeat(np.arange(len(queries)), len(self.levels[0][0]))
        node = np.tile(np.arange(len(self.levels[0][0])), len(queries))
        differing = np.zeros(len(query), dtype=np.uint8)
        for level, (patterns, bits) in enumerate(self.levels):
            if level:
                children = node[:, None] * FANOUT + np.arange(FANOUT)
                there = children < len(patterns)
                query = np.repeat(query, FANOUT)[there.ravel()]
                differing = np.repeat(differing, FANOUT)[there.ravel()]
                node = children[there]
            differing = differing + np.bitwise_count((queries[query] ^ patterns[node]) & bits[node])
            close = differing <= limit
            query, node, differing = query[close], node[close], differing[close]
        return query, node


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the linked places one label, the lowest, in ``labels``."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        apart = low < high
        if not apart.any():
            return
        np.minimum.at(labels, high[apart], low[apart])
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def node_links(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within ``limit`` bits connect: at most one for each value."""
    index = GrayIndex(values)
    labels = np.arange(len(values))
    for first in range(0, len(values), QUERIES_AT_ONCE):
        query, place = index.search(index.values[first : first + QUERIES_AT_ONCE], limit)
        _joined(labels, query + first, place)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return index.values[linked], index.values[labels[linked]]


def _masks(count: int, limit: int) -> list[int]:
    """Masks of the top level: as few segments as keep an even node near 64 fingerprints."""
    segments = limit + 1
    while segments < 12 and count / 2 ** (64 * (segments - limit) // segments) > 64:
        segments += 1
    edges = [64 * i // segments for i in range(segments + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, segments - limit)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint_links(distinct: DataFrame, limit: int, node_fingerprints: int = NODE_FINGERPRINTS) -> DataFrame:
    """(key, root): links between distinct fingerprints that connect all pairs within ``limit`` bits.

    ``distinct`` has one row per fingerprint, in ``_fp``.
    """
    count = distinct.count()
    masks = [_signed(mask) for mask in _masks(count, limit)]
    places = F.array(*(F.struct(F.lit(i).alias("t"), F.col("_fp").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(masks)))
    placed = distinct.select("_fp", F.explode(places).alias("p")).select("_fp", "p.t", "p.pattern")

    sizes = placed.groupBy("t", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") > node_fingerprints)
    large = write_shared(sizes.select("t", "pattern"), "large-nodes")
    found = []
    if not large.isEmpty():
        members = placed.join(large, ["t", "pattern"], "left_semi").select("_fp").distinct()
        found.append(_links_by_neighbours(members, limit))
        placed = placed.join(large, ["t", "pattern"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        t, pattern, values = (rows.column(c).to_numpy() for c in ("t", "pattern", "_fp"))
        order = np.lexsort((pattern, t))
        t, pattern, values = t[order], pattern[order], values[order].view(np.uint64)
        new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (pattern[1:] != pattern[:-1])))
        for start, end in zip(new, np.append(new[1:], len(t))):
            if end - start > 1:
                a, b = node_links(values[start:end], limit)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "root"])

    tasks = max(shuffle_partitions(distinct.sparkSession), -(-count * len(masks) // TASK_FINGERPRINTS))
    dealt = placed.select("t", "pattern", "_fp").repartition(tasks, "t", "pattern")
    found.append(dealt.mapInArrow(run, "key long, root long"))
    links = found[0] if len(found) == 1 else found[0].unionAll(found[1])
    return links.distinct()


def _links_by_neighbours(members: DataFrame, limit: int) -> DataFrame:
    """Links among the members of nodes too large for one task, without comparing them.

    Two values that differ in at most 2 h bits have a value within h bits of
    both. Each member goes to all such values; those who meet there are within
    2 h bits of each other. At most 65 members meet at a value for h = 1, so
    the work is proportional to the members.
    """
    if limit != 2:
        raise ValueError("nodes beyond the limit of one task need a limit of 2 bits")
    flips = F.array(*(F.lit(_signed(1 << i)) for i in range(64)), F.lit(0).cast("long"))
    near = members.select("_fp", F.explode(F.transform(flips, lambda bit: F.col("_fp").bitwiseXOR(bit))).alias("near"))
    met = near.groupBy("near").agg(F.collect_list("_fp").alias("met")).filter(F.size("met") > 1)
    pairs = met.select(F.explode("met").alias("key"), F.array_min("met").alias("root"))
    return pairs.filter("key != root")


def simhash_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    node_fingerprints: int = NODE_FINGERPRINTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per document: (id, fingerprint, component_id, kept).

    A-Z is lower-cased, words are runs of other bytes than white space, and
    shingles of ``words`` words are hashed with XXH64, seed 42. Documents are
    linked when their fingerprints differ in ``max_bits`` bits or fewer; a
    component is what links connect and is named by its smallest id. The row
    with the smallest id stays; without any id, or with repeated ones, one row.

    Null and empty texts have fingerprint zero and are linked like any other.
    Texts of any length are read in pieces. A null id never names a component
    unless all its ids are null. An empty table gives an empty result. Other
    columns are not read.
    """
    had_row = ROW in docs.columns
    rows = write_shared(fingerprints(docs, id_col, text_col, words), "fingerprints")
    keys = F.struct(F.col("_id").isNull().alias("null"), "_id", ROW)
    distinct = write_shared(rows.groupBy("_fp").agg(F.min(keys).alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    groups = connected_groups(fingerprint_links(distinct.select("_fp"), max_bits, node_fingerprints))
    named = distinct.join(groups.withColumnRenamed("key", "_fp"), "_fp", "left").select(
        "_fp", "first", "n", F.coalesce("group_id", "_fp").alias("group_id")
    )
    named = write_shared(named, "named-fingerprints")
    # one component may hold most fingerprints, and one fingerprint most rows
    firsts = write_shared(named.groupBy("group_id").agg(F.min("first").alias("least"), F.count("*").alias("n")), "components")
    least = firsts.select("group_id", "least")
    member = salted_join(named, least, ["group_id"], hot_keys(firsts, ["group_id"], hot_rows), F.col("_fp")).select(
        "_fp", F.col("least._id").alias("component_id"), F.col(f"least.{ROW}").alias("_keep")
    )
    joined = salted_join(rows, member, ["_fp"], hot_keys(distinct, ["_fp"], hot_rows), F.col(ROW))
    result = joined.select(
        ROW,
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col(ROW) == F.col("_keep")).alias("kept"),
    )
    return result if had_row else result.drop(ROW)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns."""
    rows = with_row_key(docs, id_col)
    dropped = simhash_near_duplicates(rows, id_col, text_col, **options).filter("NOT kept")
    return filter_by_keys(rows, dropped, ROW, keep=False).select(*docs.columns)
