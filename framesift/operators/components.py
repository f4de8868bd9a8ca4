"""Groups of rows connected by links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from framesift.operators.skew import HOT_ROWS, salted_join
from framesift.session import cut_lineage


def _hook(links: DataFrame, hot: list[Row]) -> DataFrame:
    """One round: every node's lower and higher neighbours move to its lowest one.

    The two halves are the large-star and small-star steps of Kiveris et al.,
    "Connected Components in MapReduce and Beyond" (2014). The links of a hub
    are spread over tasks by salting; only its minimum meets them. ``hot`` holds
    the hubs by degree, which bounds their rows in both joins.
    """
    ways = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    ways = ways.select(F.col("high").alias("node"), F.col("low").alias("near"))
    lowest = ways.groupBy("node").agg(F.min("near").alias("low"))
    lowest = lowest.select("node", F.least("node", "low").alias("low"))
    large = (
        salted_join(ways.filter("near > node"), lowest, ["node"], hot, F.col("near"))
        .select(F.col("near").alias("high"), "low")
        .distinct()
    )
    lowest = large.groupBy("high").agg(F.min("low").alias("least"))
    small = salted_join(large, lowest, ["high"], hot, F.col("low"))
    return (
        small.select("high", F.col("least").alias("low"))
        .unionByName(small.filter("low != least").select(F.col("low").alias("high"), F.col("least").alias("low")))
        .distinct()
    )


def _inspect(links: DataFrame, hot_rows: int) -> tuple[bool, list[Row]]:
    """Whether the links are stars already, and the hubs among their nodes.

    Stars: one link per higher node, and no centre that is itself linked.
    """
    ends = links.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(
        links.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre"))
    )
    seen = ends.groupBy("node").agg(
        F.sum("up").alias("up"), F.max("centre").alias("centre"), F.count("*").alias("n")
    )
    hub = F.when(F.col("n") > hot_rows, F.struct("node", F.ceil(F.col("n") / hot_rows).cast("int").alias("pieces")))
    found = seen.agg(
        F.max(F.expr("up > 1 or (up = 1 and centre = 1)")).alias("unsettled"),
        F.collect_list(hub).alias("hubs"),  # no more than links / hot_rows
    ).first()
    return not found.unsettled, found.hubs


def connected_groups(
    links: DataFrame, a: str = "key", b: str = "root", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(key, group_id) for every linked key; the group id is its lowest member.

    Rounds go on until the links form stars, about the logarithm of the number
    of nodes. Each round is checkpointed to the shared folder, so the plan does
    not grow and a lost executor costs one round.
    """
    current = cut_lineage(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    settled, hubs = _inspect(current, hot_rows)
    while not settled:
        current = cut_lineage(_hook(current, hubs))
        settled, hubs = _inspect(current, hot_rows)
    members = current.select(F.col("high").alias("key"), F.col("low").alias("group_id"))
    return members.unionByName(members.select(F.col("group_id").alias("key"), "group_id").distinct())
