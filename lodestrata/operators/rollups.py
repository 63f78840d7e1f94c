"""Summaries: timelines with offsets, place grids, duplicates, coverage, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import geo, times
from lodestrata.storage import materialise


def ordered_offsets(days: DataFrame) -> DataFrame:
    """(day, n) with the offset of each day's first row in display order.

    Only the counted days are put in order, one row for each, so the window's single task holds no more than
    there are days; rows themselves are never sorted in one place.
    """
    w = Window.orderBy(F.col("day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def timeline(items: DataFrame) -> DataFrame:
    """year, month, n, offset: rows of each month and where the first of them is in display order; nulls for undated rows."""
    days = ordered_offsets(items.groupBy("day").agg(F.count("*").alias("n")))
    return days.groupBy(F.substring("day", 1, 4).alias("year"), F.substring("day", 6, 2).alias("month")).agg(F.sum("n").alias("n"), F.min("offset").alias("offset"))


def timeline_rollup(days: DataFrame) -> DataFrame:
    """Counts by month, year and in all, of a column ``day``."""
    return days.rollup(F.substring("day", 1, 4).alias("year"), F.substring("day", 6, 2).alias("month")).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def places(items: DataFrame) -> DataFrame:
    """Cells with their number of rows, mean place, first and last day and cover (first in display order)."""
    cell = geo.cell_key(F.col("lat"), F.col("lon"))
    # the largest of (day, name) is first in display order; ids break ties downwards
    cover = F.max_by("id", F.struct(F.coalesce("day", F.lit("")), "name", -F.col("id")))
    return items.where("lat is not null and lon is not null").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("day").alias("first"), F.max("day").alias("last"), cover.alias("cover"))


def merged_places(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells merged by label: means weighed by their rows."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), mean("lat"), mean("lon"), F.count("*").alias("cells"))


def library_summary(items: DataFrame) -> DataFrame:
    """Counts of an item table in one row."""
    return items.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("day").isNull()).alias("undated"),
        F.count_if(F.col("lat").isNotNull()).alias("located"),
        F.count_if(F.col("kind") == "click").alias("clicks"),
        F.count_distinct("kind").alias("kinds"),
        F.min("day").alias("first"),
        F.max("day").alias("last"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )


def size_candidates(files: DataFrame, size: str = "size") -> DataFrame:
    """Rows whose size some other row has: only these need hashing."""
    repeated = files.groupBy(F.col(size).alias("__size")).agg(F.count("*").alias("__n")).where("__n > 1").select("__size")
    return files.join(repeated, F.col(size) == F.col("__size"), "left_semi")


def duplicate_groups(files: DataFrame, digest: str = "content_hash", size: str = "size") -> DataFrame:
    """digest, copies, extra bytes of each repeated content."""
    groups = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("copies"), F.sum(size).alias("total")).where("copies > 1")
    return groups.select(digest, "copies", F.expr("total * (copies - 1) div copies").alias("extra_bytes"))


def stratified_sample(rows: DataFrame, strata: list[str], key: Column, each: int) -> DataFrame:
    """The first rows of each stratum by the SHA-256 of a key: the same ones whatever the order or the partitions.

    Each stratum is first cut down within every partition, so that a stratum with most rows doesn't meet in one task whole.
    """
    marked = rows.withColumn("__key", F.sha2(key.cast("string"), 256))
    part = Window.partitionBy(*strata, "__part").orderBy("__key")
    near = marked.withColumn("__part", F.substring("__key", 1, 2)).withColumn("__at", F.row_number().over(part)).where(F.col("__at") <= each)
    w = Window.partitionBy(*strata).orderBy("__key")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).drop("__key", "__part", "__at")


def highlights(items: DataFrame, k: int) -> DataFrame:
    """k rows spread evenly over the days, oldest first: offsets by day narrow the sort to days that hold a chosen place."""
    days = items.where("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    up = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("offset", F.coalesce(F.sum("n").over(up), F.lit(0)))
    total = days.agg(F.sum("n").alias("total")).where("total > 0")
    chosen = total.select(F.explode(times.even_places(F.col("total"), k)).alias("place"))
    wanted = chosen.join(F.broadcast(days), (F.col("place") >= F.col("offset")) & (F.col("place") < F.col("offset") + F.col("n"))).select(F.col("day").alias("__day"), "offset", "place")
    held = items.join(F.broadcast(wanted.select("__day", "offset").distinct()), F.col("day") == F.col("__day"))
    ranked = held.withColumn("at", F.col("offset") + F.row_number().over(Window.partitionBy("day").orderBy("id")) - 1)
    return ranked.join(F.broadcast(wanted.select("place")), F.col("at") == F.col("place"), "left_semi").drop("__day", "offset")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``place`` (from 1) in an order that leaves no ties.

    Rows are stored in ranges of the order, sorted, and numbered where they are; counts of the ranges before give the rest.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(ranged.withColumn("__n", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()), "placed")
    counts = stored.groupBy(F.col("__range").alias("__r")).agg(F.min("__n").alias("__first"), F.count("*").alias("n"))  # one row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = stored.join(F.broadcast(counts.withColumn("__before", before)), F.col("__range") == F.col("__r"))
    return met.withColumn("place", F.col("__n") - F.col("__first") + F.col("__before") + 1).drop("__n", "__range", "__r", "__first", "n", "__before")


def chunked(rows: DataFrame, by: str, order: str, size: int = 200) -> DataFrame:
    """Rows of one value in numbered chunks of at most ``size``.

    Rows are stored in ranges of value and order; each is ranked within its range, and counts of the ranges before give the
    rest, so a value that most rows have is ranked by many tasks.
    """
    ranged = materialise(rows.repartitionByRange(by, order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__r")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__by").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__by", "__r", before.alias("__before"))
    at = F.row_number().over(Window.partitionBy(by, "__range").orderBy(order)) - 1
    met = ranged.withColumn("__at", at).join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__r")))
    return met.withColumn("chunk", F.floor((F.col("__at") + F.col("__before")) / size).cast("long")).drop("__range", "__at", "__by", "__r", "__before")
