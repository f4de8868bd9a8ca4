"""Ranked lexical search for many items at once, by common subexpressions.

An item's score for a document is a sum over its terms, so what items have in
common is summed up once. Term sets shared by items are mined first: terms that
occur in exactly the same items become one node, and neighbouring nodes that
several items share are joined to further nodes, round by round. That gives a
graph in which every node is the sum of the nodes below it. Documents pass
through it in batches: the partial sums of all nodes are made once for a batch,
level by level, and the items at the top read theirs off.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import best_rows, text_batches, write_shared
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join

#: Term bytes of the items of one pass over the documents, and items in a graph of their own, about.
PASS_BYTES, GRAPH_ITEMS = 16 << 20, 1024

#: Partial sums held at a time, and rows kept before they are cut down to the best.
SUMS, HELD_ROWS = 1 << 22, 1 << 17

#: What every byte of a text becomes: lower-case letters, digits and bytes from 0x80 on make terms.
_FOLD = bytes(b | 0x20 if chr(b).isalpha() else b if b > 0x7F or chr(b).isdigit() else 0x20 for b in range(128)) + bytes(range(128, 256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; a null text has none."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Graph:
    """Items that share sums. Nodes are numbered with every node after those it is the sum of."""

    terms: list[bytes]  # the first nodes
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # nodes, their children, starts
    items: list[tuple[bytes, int]] = field(default_factory=list)  # (set of terms, its node)
    size: int = 0

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Every item's sums over documents, given those of the single terms (term, document)."""
        every = np.zeros((self.size, values.shape[1]), dtype=np.int64)
        every[: len(values)] = values
        for nodes, children, starts in self.levels:
            every[nodes] = np.add.reduceat(every[children], starts, axis=0)
        return every[[node for _, node in self.items]]


def share(sets: Sequence[tuple[bytes, Sequence[bytes]]]) -> list[tuple[int, list[int], bytes | None, bytes | None]]:
    """The graph of items' term sets as rows (node, children, term, item).

    Terms that occur in the same items become one node first. An item is then a
    row of nodes, the most widely shared ones first; in rounds, the most
    frequent pairs of neighbours become nodes themselves, until no two items
    share a pair. A round costs as much as the rows are long.
    """
    found_in: dict[bytes, list[int]] = {}
    for number, (_, words) in enumerate(sets):
        for word in sorted(set(words)):
            found_in.setdefault(word, []).append(number)
    nodes: list[tuple[int, list[int], bytes | None, bytes | None]] = []
    alike: dict[tuple[int, ...], list[int]] = {}
    for node, word in enumerate(sorted(found_in)):
        nodes.append((node, [], word, None))
        alike.setdefault(tuple(found_in[word]), []).append(node)

    def joined(children: list[int]) -> int:
        if len(children) == 1:
            return children[0]
        nodes.append((len(nodes), children, None, None))
        return len(nodes) - 1

    rows: list[list[int]] = [[] for _ in sets]
    for items in sorted(alike, key=lambda items: (-len(items), items)):
        node = joined(alike[items])
        for number in items:
            rows[number].append(node)
    while True:
        pairs = Counter(pair for row in rows for pair in zip(row, row[1:]))
        taken: set[int] = set()
        chosen: dict[tuple[int, int], int] = {}
        for pair, n in sorted(pairs.items(), key=lambda found: (-found[1], found[0])):
            if n > 1 and not taken & {*pair}:
                taken |= {*pair}
                chosen[pair] = joined(list(pair))
        if not chosen:
            break
        for number, row in enumerate(rows):
            shorter, at = [], 0
            while at < len(row):
                new = chosen.get((row[at], row[at + 1])) if at + 1 < len(row) else None
                shorter.append(row[at] if new is None else new)
                at += 1 if new is None else 2
            rows[number] = shorter
    tops = [joined(row) for row in rows]
    return nodes + [(top, [], None, name) for top, (name, _) in zip(tops, sets)]


def assembled(nodes: Sequence[tuple[int, list[int], bytes | None, bytes | None]]) -> Graph:
    """The graph of `share`'s rows, its sums in levels that need only those before them."""
    inner = {node: children for node, children, term, item in nodes if term is None and item is None}
    graph = Graph([term for _, _, term, _ in sorted(n for n in nodes if n[2] is not None)])
    graph.items = [(item, node) for node, _, _, item in nodes if item is not None]
    graph.size = len(graph.terms) + len(inner)
    depth: dict[int, int] = {}
    by_level: dict[int, list[int]] = {}
    for node in sorted(inner):
        depth[node] = 1 + max(depth.get(child, 0) for child in inner[node])
        by_level.setdefault(depth[node], []).append(node)
    for level in sorted(by_level):
        members = by_level[level]
        sizes = [len(inner[node]) for node in members]
        children = np.concatenate([np.array(inner[node]) for node in members])
        graph.levels.append((np.array(members), children, np.cumsum([0, *sizes[:-1]])))
    return graph


def _item_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, set, terms, bucket) of every item with a term; ``set`` tells sets of terms apart."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(terms(text.as_py()))) for text in batch["text"]]
            some = np.flatnonzero([bool(s) for s in sets])
            names = [hashlib.sha256(b" ".join(sets[n])).digest() for n in some]
            # items alike are likely to have their least hash in common
            least = [min(hashlib.blake2b(t, digest_size=7).digest() for t in sets[n]) for n in some]
            columns = [
                batch["item"].take(pa.array(some)),
                pa.array(names, pa.binary()),
                pa.array([sets[n] for n in some], pa.list_(pa.binary())),
                pa.array([int.from_bytes(h, "big") for h in least], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item", "set", "terms", "bucket"])

    item_type = rows.schema["item"].dataType.simpleString()
    return write_shared(rows.mapInArrow(run, f"item {item_type}, `set` binary, terms array<binary>, bucket long"), "items")


def _graphs(sets: DataFrame, graphs: int) -> list[Graph]:
    """Graphs mined in tasks, each of the sets of one part of the buckets; as large as a pass at most."""

    def mine(table: pa.Table) -> pa.Table:
        found = sorted(zip(table["set"].to_pylist(), table["terms"].to_pylist()))
        columns = list(zip(*share(found)))
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        arrays = [pa.array([table["graph"][0].as_py()] * len(columns[0]), pa.int32())]
        arrays += [pa.array(column, kind) for column, kind in zip(columns, kinds)]
        return pa.Table.from_arrays(arrays, ["graph", "node", "children", "term", "item"])

    dealt = sets.withColumn("graph", F.pmod(F.xxhash64("bucket"), F.lit(graphs)).cast("int"))
    schema = "graph int, node int, children array<int>, term binary, item binary"
    mined: dict[int, list] = {}
    for r in dealt.groupBy("graph").applyInArrow(mine, schema).collect():
        term, item = (bytes(v) if v is not None else None for v in (r.term, r["item"]))
        mined.setdefault(r.graph, []).append((r.node, list(r.children), term, item))
    return [assembled(mined[number]) for number in sorted(mined)]


def _postings(docs: DataFrame, id_col: str, text_col: str, known: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts): the terms a document has in all, and how often it has the known ones."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, numbers, counts = [], [], []
            for text in batch["text"]:
                words = terms(text.as_py())
                found = [(known[t], c) for t, c in Counter(words).items() if t in known]
                sizes.append(len(words))
                numbers.append(np.array([n for n, _ in found], dtype="<i4").tobytes())
                counts.append(np.array([c for _, c in found], dtype="<i8").tobytes())
            columns = [batch["doc"], pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())]
            whole = pa.RecordBatch.from_arrays(columns, ["doc", "n", "terms", "counts"])
            yield whole.filter(pa.array([size > 0 for size in sizes], pa.bool_()))

    doc_type = rows.schema["doc"].dataType.simpleString()
    return write_shared(rows.mapInArrow(run, f"doc {doc_type}, n long, terms binary, counts binary"), "postings")


def _document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each known term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), dtype="<i4"), minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["term", "df"])

    counts = np.zeros(size, dtype=np.int64)
    summed = postings.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in summed.collect():  # no more than a pass has terms
        counts[r.term] = r.df
    return counts


@dataclass
class Scorer:
    """All that scoring a document takes."""

    graphs: list[Graph]
    known: dict[bytes, int]
    weights: np.ndarray
    documents: int
    length: int  # of all documents together

    def batch(self, sizes: list[int], numbers: list[bytes], counts: list[bytes]) -> Iterator[tuple[Graph, int, np.ndarray]]:
        """(graph, first document, scores of its items and some documents from there on)."""
        number = np.frombuffer(b"".join(numbers), dtype="<i4")
        count = np.frombuffer(b"".join(counts), dtype="<i8")
        doc = np.repeat(np.arange(len(sizes)), [len(n) // 4 for n in numbers])
        middle = np.array([10 + 90 * n * self.documents // self.length for n in sizes], dtype=np.int64)
        value = self.weights[number] * (1_000_000_000 * count // (1000 * count + 8 * middle[doc]))
        for graph in self.graphs:
            place = np.full(len(self.weights), -1, dtype=np.int64)
            place[[self.known[term] for term in graph.terms]] = np.arange(len(graph.terms))
            row = place[number]
            step = max(1, SUMS // graph.size)
            for first in range(0, len(sizes), step):
                here = (row >= 0) & (doc >= first) & (doc < first + step)
                values = np.zeros((len(graph.terms), min(step, len(sizes) - first)), dtype=np.int64)
                values[row[here], doc[here] - first] = value[here]
                yield graph, first, graph.sums(values)


def _cut(table: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of every set; equal scores by ascending document, null ids last."""
    table = table.sort_by([("number", "ascending"), ("score", "descending"), ("doc", "ascending")])
    number = table["number"].to_numpy()
    starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    place = np.arange(len(number)) - np.repeat(starts, np.diff(np.append(starts, len(number))))
    return table.filter(pa.array(place < k))


def _best(scorer: Scorer, k: int):
    """Each task's best ``k`` documents for every set of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.cumsum([0, *(len(g.items) for g in scorer.graphs)])
        place = {id(graph): int(first) for graph, first in zip(scorer.graphs, firsts)}
        least = np.ones(firsts[-1], dtype=np.int64)  # a score has to reach this to matter
        held, size, fresh = [], 0, 0
        for batch in batches:
            lists = (batch[c].to_pylist() for c in ("n", "terms", "counts"))
            for graph, first, scores in scorer.batch(*lists):
                begin = place[id(graph)]
                i, j = np.nonzero(scores >= least[begin : begin + len(scores)][:, None])
                taken = batch["doc"].take(pa.array(j + first))
                held.append(pa.table({"number": i + begin, "score": scores[i, j], "doc": taken}))
                size, fresh = size + len(i), fresh + len(i)
                if size > HELD_ROWS or fresh > 4 * k * len(least):
                    held = [_cut(pa.concat_tables(held), k)]
                    size, fresh = held[0].num_rows, 0
                    number = held[0]["number"].to_numpy()
                    full = np.flatnonzero(np.bincount(number, minlength=len(least)) >= k)
                    worst = np.full(len(least), np.iinfo(np.int64).max)
                    np.minimum.at(worst, number, held[0]["score"].to_numpy())
                    least[full] = worst[full]
        if size:
            table = _cut(pa.concat_tables(held), k).combine_chunks()
            names = [name for graph in scorer.graphs for name, _ in graph.items]
            which = pa.array(names, pa.binary()).take(table["number"].combine_chunks())
            columns = [which, table["doc"].combine_chunks(), table["score"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, ["set", "doc", "score"])

    return run


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    pass_bytes: int = PASS_BYTES,
    graph_items: int = GRAPH_ITEMS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per hit: (item_id, rank, doc_id, score), each item's ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, with A-Z lower-cased. N documents have a term, together L of them; a
    term in df documents weighs w = floor(1000 ln((2N + 2) / (2df + 1))). A
    document of n terms has m = 10 + 90nN div L, and scores for every term of
    the item that it has tf times w (10^9 tf div (1000 tf + 8m)), all in whole
    numbers. Equal scores are ordered by ascending document id.

    A null or empty text, or one without a term, has no hits as an item and
    counts nothing as a document; very long texts are taken whole. Every row is
    an item or a document of its own, whatever its id: repeated ids are
    repeated in the result, null ids come last among equal scores. An empty
    table on either side gives an empty result. Other columns are not read.

    Items with the same terms are ranked once. A pass over the documents takes
    items of about ``pass_bytes`` of terms, so what every task is sent does not
    grow with the items, and a pass returns k rows per item and task.
    """
    spark = docs.sparkSession
    text_batches(spark)
    wanted = _item_sets(items, item_id, item_text)
    sets = wanted.groupBy("set").agg(F.first("terms").alias("terms"), F.first("bucket").alias("bucket"))
    sets = write_shared(sets, "sets")
    term_bytes = F.aggregate("terms", F.lit(0).cast("long"), lambda total, term: total + F.octet_length(term) + 64)
    size = sets.agg(F.sum(term_bytes).alias("bytes"), F.count("*").alias("n")).first()
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    if not size.n:
        return spark.createDataFrame([], f"`{item_id}` {item_type}, rank int, `{doc_id}` {doc_type}, score long")
    passes = math.ceil(size.bytes / pass_bytes)
    found = []
    for number in range(passes):
        chosen = sets.filter(F.pmod("bucket", F.lit(passes)) == number)
        graphs = _graphs(chosen, math.ceil(size.n / passes / graph_items))
        known = {term: n for n, term in enumerate(sorted({term for graph in graphs for term in graph.terms}))}
        if not known:
            continue
        postings = _postings(docs, doc_id, doc_text, known)
        whole = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not whole.documents:
            break
        held_by = _document_counts(postings, len(known)).tolist()
        weights = [math.floor(1000 * math.log((2 * whole.documents + 2) / (2 * df + 1))) for df in held_by]
        scorer = Scorer(graphs, known, np.array(weights, dtype=np.int64), whole.documents, whole.length)
        shared = spark.sparkContext.broadcast(scorer)
        hits = postings.mapInArrow(lambda b, s=shared: _best(s.value, k)(b), f"`set` binary, doc {doc_type}, score long")
        found.append(write_shared(hits, "hits"))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], f"`{item_id}` {item_type}, rank int, `{doc_id}` {doc_type}, score long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    best = best_rows(hits, ["set"], [F.desc("score"), F.col("doc").asc_nulls_last()], k)
    lists = best.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))).alias("hits"))
    hot = hot_keys(wanted.groupBy("set").agg(F.count("*").alias("n")), ["set"], hot_rows)
    spread = F.col("item")
    joined = salted_join(wanted.select("item", "set"), lists, ["set"], hot, spread).select("item", F.explode("hits").alias("hit"))
    return joined.select(
        F.col("item").alias(item_id), F.col("hit.rank").alias("rank"), F.col("hit.doc").alias(doc_id), F.col("hit.score").alias("score")
    )
