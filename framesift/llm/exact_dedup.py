"""Exact duplicates by radix partitioning on successive bytes, most significant first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, SPACE, keyed, with_row_key, write_shared
from framesift.operators.keys import filter_by_keys

#: Bytes of a text that the first round looks at. Later rounds look at more and
#: more, since what is still together by then is most likely equal.
FIRST_BYTES, GROWTH, MOST_BYTES = 32, 32, 1 << 20


def _widths(first: int, growth: int, most: int) -> Iterator[int]:
    while True:
        yield first
        first = min(first * growth, most)


def _split(state: DataFrame, width: int, consumed: int) -> DataFrame:
    """One round: rows that agree on their group and its next ``width`` bytes form a new group.

    A group is counted with a combine on the map side, so copies meet as one
    row per task. Rows are then joined with the groups of two and more; a group
    with many rows is an uneven partition of a sort-merge join, which adaptive
    execution cuts into pieces; the groups are written first, since it can only
    cut where both sides are shuffled for the join itself.
    """
    digit = F.substring("_rest", 1, width)
    groups = (
        state.groupBy("_group", "_bytes", digit.alias("_digit"))
        .agg(F.count("*").alias("_n"), F.min(ROW).alias("_next"))
        .filter("_n > 1")
    )
    groups = write_shared(groups, "radix-groups")
    joined = state.withColumn("_digit", digit).join(groups.hint("merge"), ["_group", "_bytes", "_digit"], "left")
    open_group = F.col("_next").isNotNull() & (F.col("_bytes") > consumed + width)
    return joined.select(
        ROW,
        "_id",
        "_points",
        "_sha256",
        "_bytes",
        F.coalesce("_next", ROW).alias("_group"),
        F.when(F.col("_next").isNull(), "single").when(open_group, "open").otherwise("ended").alias("_status"),
        F.when(open_group, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_bytes: int = FIRST_BYTES,
    growth: int = GROWTH,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256, n_points).

    Texts are equal when they are the same after deleting white space
    (space and 0x09 to 0x0D). They are split as a radix sort splits them, by
    their length and then by successive bytes, until a group is a single row or
    its bytes have ended: equality rests on the bytes, the digest is output
    only. Of equal texts the row with the most code points stays, then the
    smallest id.

    Null text counts as empty, and all empty texts are equal. Rows whose id is
    null come after those with one and are dropped with keep_id of the row that
    stays; repeated ids are rows of their own, of which at most one is kept in
    a group. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    squeezed = F.regexp_replace(text, f"[{SPACE}]+", "")
    had_row = ROW in docs.columns
    state = keyed(docs, id_col, _text=text_col).select(
        ROW,
        "_id",
        F.char_length(text).cast("long").alias("_points"),
        F.sha2(squeezed.cast("binary"), 256).alias("_sha256"),
        F.octet_length(squeezed).alias("_bytes"),
        F.lit(0).cast("long").alias("_group"),
        squeezed.cast("binary").alias("_rest"),
    )
    settled, consumed = [], 0
    for width in _widths(first_bytes, growth, most_bytes):
        written = write_shared(_split(state, width, consumed), "radix")
        settled.append(written.filter("_status != 'open'").drop("_rest"))
        state = written.filter("_status = 'open'").drop("_status")
        consumed += width
        if state.isEmpty():
            break
    rows = reduce(DataFrame.unionAll, settled)

    ended = rows.filter("_status = 'ended'")
    first = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("null"), "_id", ROW))
    best = (
        ended.groupBy("_group")
        .agg(first.alias("best"), F.count("*").alias("group_size"))
        .select("_group", F.col("best._id").alias("keep_id"), F.col(f"best.{ROW}").alias("_keep"), "group_size")
    )
    best = write_shared(best, "radix-best")
    columns = [
        ROW,
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_keep") == F.col(ROW)).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
        F.col("_points").alias("n_points"),
    ]
    alone = rows.filter("_status = 'single'")
    alone = alone.withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long"), "_keep": F.col(ROW)})
    result = alone.select(*columns).unionAll(ended.join(best, "_group").select(*columns))
    return result if had_row else result.drop(ROW)


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = with_row_key(docs, id_col)
    dropped = exact_duplicates(rows, id_col, text_col).filter("NOT kept")
    return filter_by_keys(rows, dropped, ROW, keep=False).select(*docs.columns)
