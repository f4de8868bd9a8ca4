"""Phrase collocations by vertical partitioning of the suffixes of pieces of text.

Every occurrence of two words or more that could start a frequent phrase gives
a suffix, cut at five words. Suffixes are partitioned by the words they begin
with: prefixes are dealt to slots, slots over the memory budget are divided by
one more word of the prefix, and the others are packed into groups within the
budget (Mansour et al., "ERA: Efficient Serial and Parallel Suffix Tree
Construction", 2011). A task then builds the truncated suffix subtree of each
of its groups on its own, by sorting, and reads the count of every phrase off
the totals of the leaves below its node.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import best_rows, drop_written, text_batches, write_shared
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join

MOST_WORDS, LEAST_COUNT, FIRST = 5, 100, 2000

#: Occurrences whose suffixes one group may hold, which bounds a task's memory.
GROUP_WORDS = 1 << 21

#: Groups a task builds one after the other, about.
GROUPS_PER_TASK = 2

#: Slots that prefixes are dealt to: at least so many, or so many per group, and at most.
LEAST_SLOTS, SLOTS_PER_GROUP, MOST_SLOTS = 1 << 12, 8, 1 << 18

#: Bits per frequent word of the table that sorts out rare ones, and bits at least and at most.
WORD_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 27

#: Different words a task counts before it passes them on, words of text it looks at together, and rows of a batch.
HELD, HELD_WORDS, BATCH_ROWS = 1 << 19, 1 << 21, 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)

NO_LANGUAGE = "und"

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of each piece of a text, as UTF-8."""
    for piece in (text or "").encode().translate(_FOLD).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(F.col(text_col).alias("text"), lang.alias("lang"))


def _count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, f) over all texts; tasks add up what they can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                words, numbers = pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())
                table = pa.table({"lang": pa.array([lang] * len(counts), pa.string()), "word": words.cast(pa.string()), "f": numbers})
                yield from table.to_batches(BATCH_ROWS)
            held.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                counts = held.setdefault(lang.as_py(), Counter())
                for words in pieces(text.as_py()):
                    counts.update(words)
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    counted = texts.mapInArrow(run, "lang string, word string, f long")
    return write_shared(counted.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")


def _key(lang: str, words: bytes) -> int:
    return zlib.crc32(words, zlib.crc32(lang.encode() + b"\t"))


def _frequent_bits(words: DataFrame, least: int) -> np.ndarray:
    """A bit for the hash of each frequent word. Bounded in size: a rare word may share a bit, no frequent one lacks it."""
    frequent = words.filter(F.col("f") >= least)
    bits = LEAST_BITS
    while bits < min(MOST_BITS, WORD_BITS * frequent.count()):
        bits *= 2
    place = F.pmod(F.crc32(F.concat("lang", F.lit("\t"), "word").cast("binary")), F.lit(bits)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = frequent.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in maps.collect():  # no more than MOST_BITS altogether
        first = (r.bucket - 1) * 4096
        table[first : first + 4096] = np.frombuffer(r.bits, dtype=np.uint8)[: bits // 8]
    return table


@dataclass
class Plan:
    """What tasks need to know of the partitioning: ``groups[d]`` has the group of every slot of prefixes of 2 + d words.

    A group below zero stands for a slot whose prefixes go on to the next depth.
    """

    bits: np.ndarray
    most_words: int
    groups: list[np.ndarray]

    def frequent(self, lang: str, word: bytes) -> bool:
        place = _key(lang, word) % (8 * len(self.bits))
        return bool(self.bits[place >> 3] >> (place & 7) & 1)

    def dealt(self, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(depth, slot, group) of each suffix: of its prefix at the first depth whose slot is not divided."""
        depth, slot = np.full(len(suffixes.words), len(self.groups)), np.full(len(suffixes.words), -1)
        group, left = np.full(len(suffixes.words), -1), np.arange(len(suffixes.words))
        for at, groups in enumerate(self.groups):
            places = (suffixes.hashes(at + 2, left) % np.uint64(len(groups))).astype(np.int64)
            depth[left], slot[left], group[left] = at, places, groups[places]
            left = left[groups[places] < 0]
        return depth, slot, group


class _Numbers(dict):
    """Numbers of the frequent words of one language in the order they are met; rare words have -1."""

    def __init__(self, plan: Plan, lang: str):
        super().__init__()
        self.plan, self.lang, self.words = plan, lang, []

    def __missing__(self, word: bytes) -> int:
        number = -1
        if self.plan.frequent(self.lang, word):
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number


@dataclass
class Suffixes:
    """Truncated suffixes of two words or more in texts of one language: numbers of ``names``, -1 after the end."""

    lang: str
    names: list[bytes]
    words: np.ndarray

    def hashes(self, length: int, some: np.ndarray) -> np.ndarray:
        """A hash of the first ``length`` words of some suffixes, or of all they have."""
        seed = zlib.crc32(self.lang.encode())
        single = np.array([xxhash.xxh3_64_intdigest(name, seed) for name in self.names] + [0], dtype=np.uint64)
        total = single[self.words[some, 0]]
        for column in self.words[some, 1:length].T:
            total = np.where(column >= 0, total * _MIX + single[column], total)
        return (total ^ (total >> np.uint64(29))) * _MIX >> np.uint64(20)


def _suffixes(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    """All suffixes of a task's texts, some texts of a language at a time."""
    held: dict[str, tuple[_Numbers, list[int]]] = {}

    def out() -> Iterator[Suffixes]:
        for lang, (numbers, line) in held.items():
            line = np.array(line + [-1] * plan.most_words, dtype=np.int32)
            starts = np.flatnonzero((line[:-1] >= 0) & (line[1:] >= 0))
            words = line[starts[:, None] + np.arange(plan.most_words)]
            words[np.logical_or.accumulate(words < 0, axis=1)] = -1
            if len(words):
                yield Suffixes(lang, numbers.words, words)
        held.clear()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            lang = lang.as_py()
            if lang not in held:
                held[lang] = _Numbers(plan, lang), []
            numbers, line = held[lang]
            for words in pieces(text.as_py()):
                line.extend(map(numbers.__getitem__, words))
                line.append(-1)
            if sum(len(line) for _, line in held.values()) > HELD_WORDS:
                yield from out()
    yield from out()


def _loads(plan: Plan):
    """(slot, n): occurrences in each slot of the plan's last depth, among those that get there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, slots = len(plan.groups) - 1, len(plan.groups[-1])
        loads = np.zeros(slots, dtype=np.int64)
        for suffixes in _suffixes(plan, batches):
            depth, slot, _ = plan.dealt(suffixes)
            loads += np.bincount(slot[depth == last], minlength=slots)
        some = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(loads[some])], ["slot", "n"])

    return run


def _order(words: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Order of rows of words, by ``before`` first; as many numbers of words make one key as fit into 63 bits."""
    bits = int(words.max(initial=0) + 1).bit_length()
    keys = []
    for first in range(0, words.shape[1], 63 // bits):
        key = np.zeros(len(words), dtype=np.int64)
        for column in words[:, first : first + 63 // bits].T:
            key = key << bits | (column + 1)
        keys.append(key)
    return np.lexsort([*reversed(keys), *reversed(before)])


def _planes(numbers: np.ndarray) -> bytes:
    """Rows of numbers by column and place of the byte, highest bytes that are all 0 left out; this packs better."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    single = np.ascontiguousarray(numbers.T.astype("<u4")).view(np.uint8).reshape(*numbers.shape[::-1], 4)
    return bytes([width]) + single[:, :, :width].transpose(0, 2, 1).tobytes()


def _from_planes(data: bytes, columns: int) -> np.ndarray:
    """What `_planes` was given."""
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(columns, width, -1)
    single = np.zeros((columns, planes.shape[2], 4), dtype=np.uint8)
    single[:, :, :width] = planes.transpose(0, 2, 1)
    return single.view("<u4")[:, :, 0].T


def _blobs(plan: Plan):
    """(group, lang, names, words, counts): a task's different suffixes of one group, sorted and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        columns = ["group", "lang", "names", "words", "counts"]
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        for suffixes in _suffixes(plan, batches):
            group = plan.dealt(suffixes)[2]
            order = _order(suffixes.words, group)
            words, group = suffixes.words[order], group[order]
            fresh = np.append(True, (words[1:] != words[:-1]).any(axis=1))  # equal words are in one group
            starts = np.flatnonzero(fresh)
            words, group, counts = words[starts], group[starts], np.diff(np.append(starts, len(words)))
            rows, size = [], 0
            for first, end in zip(*_runs(group)):
                used, numbers = np.unique(words[first:end], return_inverse=True)
                used, shift = (used[1:], 0) if used[0] < 0 else (used, 1)  # 0 stands for no word
                numbers = numbers.reshape(-1, plan.most_words) + shift
                names = b"\n".join([suffixes.names[n] for n in used])
                parts = [names, _planes(numbers), counts[first:end].astype("<u4").tobytes()]
                rows.append((group[first], suffixes.lang, *map(pack.compress, parts)))
                size += sum(map(len, rows[-1][2:]))
                if size > 4 << 20 or end == len(group):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)
                    rows, size = [], 0

    return run


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    return starts, [*starts[1:], len(values)]


def packed(loads: np.ndarray, budget: int, first: int) -> np.ndarray:
    """The group of every slot, from ``first`` on, no group over the budget; -1 where a slot is over it itself."""
    groups = np.full(len(loads), -1, dtype=np.int32)
    group, room = first, budget
    for slot in np.argsort(-loads, kind="stable"):
        if loads[slot] > budget:
            continue
        if loads[slot] > room:
            group, room = group + 1, budget
        room -= loads[slot]
        groups[slot] = group
    return groups


def _plan(
    texts: DataFrame, words: DataFrame, least: int, most_words: int, group_words: int, least_slots: int = LEAST_SLOTS
) -> Plan:
    """Slots are divided depth by depth, until none is over the budget or prefixes are as long as suffixes."""
    spark = texts.sparkSession
    frequent = words.filter(F.col("f") >= least).agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    slots = min(MOST_SLOTS, max(least_slots, SLOTS_PER_GROUP * (frequent // group_words + 1)))
    plan = Plan(_frequent_bits(words, least), most_words, [])
    first = 0
    for depth in range(2, most_words + 1):
        plan.groups.append(np.full(slots, -1, dtype=np.int32))
        shared = spark.sparkContext.broadcast(plan)
        counted = texts.mapInArrow(lambda b, s=shared: _loads(s.value)(b), "slot int, n long")
        loads = np.zeros(slots, dtype=np.int64)
        for r in counted.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row per slot
            loads[r.slot] = r.n
        shared.unpersist()
        # Suffixes that agree in all their words are one row per task: nothing is left to divide.
        groups = packed(loads, group_words if depth < most_words else max(group_words, int(loads.max(initial=0))), first)
        plan.groups[-1] = groups
        first = max(first, int(groups.max(initial=-1)) + 1)
        if (groups >= 0).all():
            break
    return plan


def subtree(words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, nodes, counts) of the suffixes' tree, for each depth from two words on.

    The suffixes are sorted by their words; a node is a run of equal beginnings
    and counts as often as its leaves do together.
    """
    order = _order(words)
    words, counts = words[order], counts[order]
    fresh = np.append(True, words[1:, 0] != words[:-1, 0])
    for depth in range(2, words.shape[1] + 1):
        fresh[1:] |= words[1:, depth - 1] != words[:-1, depth - 1]
        starts = np.flatnonzero(fresh)
        deep = words[starts, depth - 1] >= 0  # others end before this depth
        yield depth, words[starts[deep], :depth], np.add.reduceat(counts, starts)[deep]


def _count_phrases(texts: DataFrame, plan: Plan, least: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of two words and more that occur ``least`` times."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(plan)
    schema = "group int, lang string, names binary, words binary, counts binary"
    blobs = texts.mapInArrow(lambda b: _blobs(shared.value)(b), schema)
    depth_of = np.zeros(int(max((g.max(initial=-1) for g in plan.groups), default=-1)) + 1, dtype=np.int32)
    for depth, groups in enumerate(plan.groups, 2):
        depth_of[np.unique(groups[groups >= 0])] = depth
    most_words = plan.most_words

    def build(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        known = depth_of[table["group"][0].as_py()]
        columns: list[list] = [[], [], [], []]
        for lang in pc.unique(table["lang"]).to_pylist():
            some = table.filter(pc.equal(table["lang"], lang))
            numbers: dict[bytes, int] = {}
            words, counts = [], []
            for names, ids, n in zip(*(some[c].to_pylist() for c in ("names", "words", "counts"))):
                listed = [numbers.setdefault(name, len(numbers)) for name in unpack.decompress(names).split(b"\n")]
                words.append(np.array([-1, *listed], dtype=np.int32)[_from_planes(unpack.decompress(ids), most_words)])
                counts.append(np.frombuffer(unpack.decompress(n), dtype="<u4"))
            spelled = [name.decode() for name in numbers]
            for depth, nodes, totals in subtree(np.concatenate(words), np.concatenate(counts).astype(np.int64)):
                # Shorter prefixes than the group's own lie in other groups as well.
                kept = np.flatnonzero((totals >= least) | (depth < known))
                columns[0] += [lang] * len(kept)
                columns[1] += [" ".join([spelled[w] for w in node]) for node in nodes[kept].tolist()]
                columns[2] += [depth] * len(kept)
                columns[3] += totals[kept].tolist()
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "phrase", "words", "f"])

    tasks = max(1, len(depth_of) // GROUPS_PER_TASK)
    found = blobs.repartition(tasks, "group").groupBy("group").applyInArrow(build, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def mine_collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST_COUNT,
    first: int = FIRST,
    most_words: int = MOST_WORDS,
    group_words: int = GROUP_WORDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by how closely their words belong together.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs. A phrase of 2 to ``most_words`` words
    with a >= ``least`` occurrences within pieces is a candidate. Cut after some
    of its words into parts with l and r occurrences it scores
    floor(1000 a n / (l r)), n being the language's words; the cut with the
    lowest score counts, of equal ones the first. Candidates that occur as often
    within a longer candidate are left out. Order: score, then a, both falling,
    then the phrase by its UTF-8 bytes.

    A null text is empty, a null language is ``und``. Empty texts have no words;
    very long ones are taken whole, and repeated rows count as often as they
    occur. An empty table gives an empty result. Other columns are not read.

    Counts are exact. Memory is bounded by ``group_words`` occurrences a group
    and by what a task holds before it passes counts on.
    """
    text_batches(docs.sparkSession)
    texts = _texts(docs, text_col, lang_col)
    words = _count_words(texts)
    plan = _plan(texts, words, least, most_words, group_words)
    phrases = _count_phrases(texts, plan, least)
    single = words.filter(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    counts = write_shared(phrases.unionByName(single), "phrases")
    totals = write_shared(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    drop_written(words)

    candidates = counts.filter("words > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("tail", F.expr("substring_index(phrase, ' ', k - words)"))
    for part, name in (("head", "l"), ("tail", "r")):
        hot = hot_keys(cuts.groupBy("lang", part).agg(F.count("*").alias("n")), ["lang", part], hot_rows)
        known = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = salted_join(cuts, known, ["lang", part], hot, F.col("phrase"))
    hot = hot_keys(candidates.groupBy("lang").agg((F.count("*") * most_words).alias("n")), ["lang"], hot_rows)
    cuts = salted_join(cuts, totals, ["lang"], hot, F.col("phrase"))
    exact = "({0} * {1} * 1000BD) div ({2} * {3})".format(*(f"cast({c} as decimal(15, 0))" for c in "anlr"))
    cuts = cuts.withColumn("score", F.expr(exact))
    best = F.min(F.struct("score", "k", "l", "r", "n")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best)

    # A longer candidate that holds a phrase as often as it occurs does so through one with a single word more.
    sides = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    within = candidates.filter("words > 2").select("lang", F.explode(sides).alias("phrase"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter("longer is null or longer < a")
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")
    ranked = best_rows(kept, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
