"""Stacks of pictures that look alike: of one day and nearly the same, or taken in one burst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import vectors
from lodestrata.operators import details, neighbours
from lodestrata.storage import materialise

#: Bits between pictures of a day, bits and seconds between those of a burst.
NEAR, BURST, BURST_SECONDS = 6, 14, 90


def propose(items: DataFrame, near: int = NEAR, burst: int = BURST, seconds: int = BURST_SECONDS) -> DataFrame:
    """(stack, contents, top, day) of items (content_hash, day, at, hi, lo, pixels) that links make groups of two or more.

    Links: the same day (or both undated) and at most ``near`` differing bits; the same day, within ``seconds`` by the
    clock and at most ``burst`` bits. A stack's top has the most pixels, is the earliest, has the smallest hash; its
    name is a digest of its members.
    """
    rows = items.where("hi is not null and lo is not null").select("content_hash", "day", F.when(F.col("day").isNotNull(), F.col("at")).alias("at"), "hi", "lo", "pixels")
    rows = materialise(rows, "pictures")
    alike = neighbours.banded_links(rows, near, "content_hash", by="day")
    bursts = details.burst_alike(rows.where("at is not null"), seconds, burst, "content_hash")
    groups = neighbours.groups_of(alike.unionByName(bursts))
    members = rows.join(groups, F.col("content_hash") == F.col("member"))
    order = F.struct(-F.col("pixels"), F.col("at").isNull(), F.col("at"), F.col("content_hash"))
    made = members.groupBy("group").agg(F.sort_array(F.collect_set("content_hash")).alias("contents"), F.min_by("content_hash", order).alias("top"), F.min("day").alias("day"))
    return made.where(F.size("contents") > 1).select(vectors.group_id(F.col("contents")).alias("stack"), "contents", "top", "day")


def effective(owner: DataFrame, proposals: DataFrame, separated: DataFrame, present: DataFrame) -> DataFrame:
    """(stack, contents, top, day, confirmed): the owner's stacks of which two members are present, then proposals.

    Proposals whose name is in ``separated`` (stack) or that have a member in a shown stack of the owner are left out.
    All sides: (stack, contents, top, day); present: (content_hash).
    """
    held = owner.select("stack", "top", "day", F.explode("contents").alias("c")).join(present.select(F.col("content_hash").alias("p")).distinct(), F.col("c") == F.col("p"), "left_semi")
    shown = held.groupBy("stack").agg(F.sort_array(F.collect_set("c")).alias("contents"), F.first("top").alias("top"), F.first("day").alias("day")).where(F.size("contents") > 1)
    shown = shown.withColumn("top", F.when(F.array_contains("contents", F.col("top")), F.col("top")).otherwise(F.col("contents")[0]))
    free = proposals.join(separated.select(F.col("stack").alias("s")), F.col("stack") == F.col("s"), "left_anti")
    taken = shown.select(F.explode("contents").alias("t")).distinct()
    claimed = free.select("stack", F.explode("contents").alias("c")).join(taken, F.col("c") == F.col("t"), "left_semi").select(F.col("stack").alias("s")).distinct()
    rest = free.join(claimed, F.col("stack") == F.col("s"), "left_anti").withColumn("confirmed", F.lit(False))
    return shown.withColumn("confirmed", F.lit(True)).select("stack", "contents", "top", "day", "confirmed").unionByName(rest.select("stack", "contents", "top", "day", "confirmed"))


def listed(stacks: DataFrame) -> DataFrame:
    """Stacks in the order in which they are shown: confirmed ones, then by day, undated last, then by name."""
    return stacks.orderBy(F.desc("confirmed"), F.col("day").isNull(), "day", "stack")


def membership(stacks: DataFrame) -> DataFrame:
    """(content_hash, stack, is_top, members): what a search needs to collapse stacks to their tops."""
    return stacks.select("stack", F.size("contents").alias("members"), "top", F.explode("contents").alias("content_hash")).select("content_hash", "stack", (F.col("content_hash") == F.col("top")).alias("is_top"), "members")
