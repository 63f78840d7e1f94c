"""Proposals for items that lack a date or a place, each with its rule and evidence; nothing here writes.

An item gets the first rule that fits. Dates: not a capture; between two dated files of its numbered sequence, at most
a month apart (strong); next to a dated one (weak); an asset; the day it was last written, unless many undated files
share that day (weak). Places: not a capture; the one area of the day (strong); the nearest located item in time
(medium); the centre of a saved trip (weak).

Neighbours by number or time are found in two steps, within ranges of ``width`` numbers and between ranges, so a
folder or day with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text, times
from lodestrata.operators import details, journeys

#: The limits of the rules and the order of strengths.
MASS_COPY, SEQUENCE_DAYS, NEARBY_SECONDS = 100, 31, 3 * 3600
STRENGTHS = ("strong", "medium", "weak", "none")
DISMISSING = ("not-a-capture", "asset")


def nearest_known(points: DataFrame, by: list[str], at: str, value: str, width: int = 4096) -> DataFrame:
    """``points`` (one row for each ``by`` and ``at``) with ``below`` and ``above``: (at, value) of the nearest one at or before, and at or after, that has a value."""
    ranged = points.withColumn("__r", F.floor(F.col(at) / width))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    inside = Window.partitionBy(*by, "__r").orderBy(at)
    near = ranged.withColumns({"__below": F.last(known, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__above": F.first(known, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))})
    ends = ranged.groupBy(*by, "__r").agg(F.max_by(known, F.when(known.isNotNull(), F.col(at))).alias("last"), F.min_by(known, F.when(known.isNotNull(), F.col(at))).alias("first"))
    between = Window.partitionBy(*by).orderBy("__r")
    ends = ends.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__r").alias("__kr"), F.last("last", ignorenulls=True).over(between.rowsBetween(Window.unboundedPreceding, -1)).alias("__was"), F.first("first", ignorenulls=True).over(between.rowsBetween(1, Window.unboundedFollowing)).alias("__next"))
    same = F.col("__r") == F.col("__kr")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = near.join(ends, same)
    return out.select(*[F.col(c) for c in points.columns], F.coalesce("__below", "__was").alias("below"), F.coalesce("__above", "__next").alias("above"))


def sequence_days(items: DataFrame) -> DataFrame:
    """(id, rule, proposed, evidence) of undated items (id, name, folder, day) by the numbers in their folder's names.

    Of items with one number the last in display order stands for it.
    """
    prefix, number = text.sequence_key(F.col("name"))
    named = items.select("id", "name", "folder", "day", prefix.alias("prefix"), number.alias("number")).where("number is not null")
    kept = named.groupBy("folder", "prefix", "number").agg(F.min_by(F.struct("id", "name", "day"), F.struct(F.coalesce("day", F.lit("")), "name", "id")).alias("x"))
    points = kept.select("folder", "prefix", "number", "x.*").withColumn("told", F.when(F.col("day").isNotNull(), F.struct("name", "day")))
    near = nearest_known(points, ["folder", "prefix"], "number", "told").where("day is null and (below is not null or above is not null)")
    one = lambda side, f: F.col(f"{side}.value.{f}")
    close = F.coalesce(F.abs(F.datediff(one("above", "day"), one("below", "day"))) <= SEQUENCE_DAYS, F.lit(False))
    lower = F.coalesce((F.col("number") - F.col("below.at")) <= (F.col("above.at") - F.col("number")), F.col("below").isNotNull())
    pick = lambda f: F.when(lower, one("below", f)).otherwise(one("above", f))
    other = lambda f: F.when(lower, one("above", f)).otherwise(one("below", f))
    dated = lambda name, day: F.concat(name, F.lit(" ("), day, F.lit(")"))
    between = F.concat(F.lit("Between "), dated(one("below", "name"), one("below", "day")), F.lit(" and "), dated(one("above", "name"), one("above", "day")))
    beside = F.concat(F.lit("Nearest dated neighbour "), dated(pick("name"), pick("day")), F.coalesce(F.concat(F.lit("; the other side is "), dated(other("name"), other("day"))), F.lit("")))
    return near.select("id", F.when(close, "sequence").otherwise("sequence-loose").alias("rule"), F.when(close, one("below", "day")).otherwise(pick("day")).alias("proposed"), F.when(close, between).otherwise(beside).alias("evidence"))


def date_proposals(items: DataFrame) -> DataFrame:
    """(id, content_hash, rule, strength, proposed, evidence) of items without a day that aren't dismissed; rule null: nothing explains them.

    items: id, content_hash, name, extension, folder, day, modified (day), dismissed.
    """
    found = sequence_days(items).select(F.col("id").alias("s_id"), F.col("rule").alias("s_rule"), F.col("proposed").alias("s_day"), F.col("evidence").alias("s_evidence"))
    undated = items.where(F.col("day").isNull() & ~F.coalesce("dismissed", F.lit(False)))
    shared = undated.where("modified is not null").groupBy(F.col("modified").alias("m_day")).agg(F.count("*").alias("sharing"))
    met = undated.join(found, F.col("id") == F.col("s_id"), "left").join(shared, F.col("modified") == F.col("m_day"), "left")
    rule = (
        F.when(details.not_a_capture(F.col("name"), F.col("folder")), "not-a-capture")
        .when(F.col("s_rule").isNotNull(), F.col("s_rule"))
        .when(details.asset_like(F.col("name"), F.col("extension")), "asset")
        .when(F.col("sharing") < MASS_COPY, "modified")
    )
    out = met.withColumn("rule", rule)
    strength = F.when(F.col("rule") == "sequence", "strong").when(F.col("rule").isin("sequence-loose", "modified"), "weak").otherwise("none")
    proposed = F.when(F.col("rule").isin("sequence", "sequence-loose"), F.col("s_day")).when(F.col("rule") == "modified", F.col("modified"))
    written = F.concat(F.lit("Last modified "), F.col("modified"), F.lit("; "), (F.col("sharing") - 1).cast("string"), F.lit(" other undated files share that day"))
    evidence = F.when(F.col("rule").isin(*DISMISSING), F.concat(F.lit("Named "), F.col("name"))).when(F.col("rule") == "modified", written).when(F.col("rule").isNotNull(), F.col("s_evidence"))
    return out.select("id", "content_hash", "rule", strength.alias("strength"), proposed.alias("proposed"), evidence.alias("evidence"))


def location_proposals(items: DataFrame, trips: DataFrame, places: DataFrame) -> DataFrame:
    """(id, content_hash, rule, strength, lat, lon, cell) of items without a place that aren't dismissed; rule 'undated' or 'ambiguous' where nothing fits.

    items: id, content_hash, name, folder, day, second (of the day, null for a bare day), lat, lon, cell, dismissed;
    trips: trip, seq, after, before, place (cells joined by commas, '' for any), the unarchived ones; places: cell, lat, lon.
    """
    located = items.where("cell is not null and day is not null")
    peer = F.struct("name", "id", "lat", "lon", "cell")
    days = located.groupBy(F.col("day").alias("p_day")).agg(F.count("*").alias("peers"), F.count_distinct("cell").alias("cells"), F.max_by(peer, F.struct("name", "id")).alias("any"))
    missing = items.where(F.col("cell").isNull() & ~F.coalesce("dismissed", F.lit(False)))
    timed = located.where("second is not null").groupBy("day", "second").agg(F.max_by(peer, F.struct("name", "id")).alias("peer"))
    asked = missing.where("day is not null and second is not null").select("day", "second").distinct().withColumn("peer", F.lit(None).cast(timed.schema["peer"].dataType))
    points = timed.unionByName(asked).groupBy("day", "second").agg(F.first("peer", ignorenulls=True).alias("peer"))
    near = nearest_known(points, ["day"], "second", "peer", 600)
    gaps = [F.when(F.col("below").isNotNull(), F.struct((F.col("second") - F.col("below.at")).alias("gap"), F.col("below.value").alias("p"))), F.when(F.col("above").isNotNull(), F.struct((F.col("above.at") - F.col("second")).alias("gap"), F.col("above.value").alias("p")))]
    # Of two peers equally near, the first in display order: the one with the greater name.
    lower = (gaps[0]["gap"] < gaps[1]["gap"]) | ((gaps[0]["gap"] == gaps[1]["gap"]) & (gaps[0]["p"]["name"] >= gaps[1]["p"]["name"]))
    nearest = F.when(gaps[0].isNull(), gaps[1]).when(gaps[1].isNull() | lower, gaps[0]).otherwise(gaps[1])
    near = near.select(F.col("day").alias("n_day"), F.col("second").alias("n_second"), nearest.alias("near"))
    area = trips.select("trip", F.explode(F.split("place", ",")).alias("c")).join(places.select(F.col("cell").alias("pc"), F.col("lat").alias("plat"), F.col("lon").alias("plon")), F.col("c") == F.col("pc"))
    centres = area.groupBy(F.col("trip").alias("c_trip")).agg(F.avg("plat").alias("t_lat"), F.avg("plon").alias("t_lon"))
    days_of_trips = journeys.in_ranges(missing.where("day is not null").select(F.col("day").alias("t_day")).distinct(), trips, "t_day", "after", "before").groupBy("t_day").agg(F.min_by(F.struct("trip", "place"), F.col("seq")).alias("t"))
    met = missing.join(days, F.col("day") == F.col("p_day"), "left").join(near, (F.col("day") == F.col("n_day")) & (F.col("second") == F.col("n_second")), "left")
    met = met.join(days_of_trips, F.col("day") == F.col("t_day"), "left").join(centres, F.col("t.trip") == F.col("c_trip"), "left")
    rule = (
        F.when(details.not_a_capture(F.col("name"), F.col("folder")), "not-a-capture")
        .when(F.col("day").isNull(), "undated")
        .when(F.col("cells") == 1, "same-day")
        .when(F.col("peers").isNotNull() & (F.col("near.gap") <= NEARBY_SECONDS), "nearby-time")
        .when(F.col("peers").isNull() & F.col("t_lat").isNotNull(), "trip")
        .otherwise("ambiguous")
    )
    out = met.withColumn("rule", rule)
    strength = F.when(F.col("rule") == "same-day", "strong").when(F.col("rule") == "nearby-time", "medium").when(F.col("rule") == "trip", "weak").otherwise("none")
    anchor = lambda f: F.when(F.col("rule") == "same-day", F.coalesce(F.col(f"near.p.{f}"), F.col(f"any.{f}"))).when(F.col("rule") == "nearby-time", F.col(f"near.p.{f}"))
    at = lambda f: F.round(F.coalesce(anchor(f), F.when(F.col("rule") == "trip", F.col(f"t_{f}"))), 6)
    return out.select("id", "content_hash", "rule", strength.alias("strength"), at("lat").alias("p_lat"), at("lon").alias("p_lon"), F.coalesce(anchor("cell"), F.when(F.col("rule") == "trip", F.split("t.place", ",")[0])).alias("p_cell")).withColumnsRenamed({"p_lat": "lat", "p_lon": "lon", "p_cell": "cell"})


def action_of(rule: Column) -> Column:
    return F.when(rule.isin(*DISMISSING), "dismiss").when(rule == "not-expected", "restore").otherwise("accept")


def groups(proposals: DataFrame, group: str = "rule") -> DataFrame:
    """(group, strength, action, count, place): the review groups; the strongest, those to accept, the largest first."""
    listed = proposals.where(F.col(group).isNotNull() & ~F.col(group).isin("undated", "ambiguous")).groupBy(F.col(group).alias("group"), "strength").agg(F.count("*").alias("count")).withColumn("action", action_of(F.col("group")))
    rank = F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), F.col("strength"))
    order = F.row_number().over(Window.orderBy(rank, F.col("action") != "accept", F.desc("count"), "group"))  # over groups, of which there are few
    return listed.withColumn("place", order)


def page(proposals: DataFrame, group: str | None = None, offset: int = 0, limit: int = 80, by: str = "rule") -> DataFrame:
    """Proposals of one group (the first, if none or an unknown one is named), in order of ids, with ``total`` and ``next_offset``."""
    offset, limit = max(0, offset), max(1, min(limit, 200))
    listed = groups(proposals, by)
    chosen = listed.orderBy(F.col("group") != F.lit(group or ""), "place").limit(1).select(F.col("group").alias("__g"), F.col("count").alias("total"))
    rows = proposals.join(F.broadcast(chosen), F.col(by) == F.col("__g")).drop("__g")  # one row
    more = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit).cast("long"))
    return rows.orderBy("id").offset(offset).limit(limit).withColumn("next_offset", more)


def acceptance_events(rows: DataFrame, value: list[str], size: int = 200) -> DataFrame:
    """(value columns, batch, contents): the different hashes of each value, sorted, in batches of ``size``; rows without a proposal are an error.

    Hashes are ranked within their first two digits, whose counts give the offsets, so a value that most rows share is many tasks.
    """
    # In the value itself, so that no pushed condition on it can drop the row unseen.
    required = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("rows without a proposal can't be accepted")).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    sound = rows.select("content_hash", *[required(c) for c in value])
    each = sound.select(*value, "content_hash").distinct().withColumn("__d", F.substring("content_hash", 1, 2))
    inside = Window.partitionBy(*value, "__d").orderBy("content_hash")
    before = each.groupBy(*value, "__d").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy(*value).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = each.withColumn("__i", F.row_number().over(inside)).join(before, [*value, "__d"])
    batch = F.floor((F.col("__i") + F.col("__before") - 1) / size).cast("long")
    return ranked.groupBy(*value, batch.alias("batch")).agg(F.sort_array(F.collect_list("content_hash")).alias("contents"))


def coverage(items: DataFrame, proposals: DataFrame, value: str, owner: str) -> DataFrame:
    """One row: total, filled, missing, not_expected, proposed, no_evidence, undated, owner.

    ``value``: the column that is filled or not; ``owner``: whether the owner confirmed it.
    """
    filled, dismissed = F.col(value).isNotNull(), F.coalesce("dismissed", F.lit(False))
    a = items.agg(F.count("*").alias("total"), F.count_if(filled).alias("filled"), F.count_if(~filled & ~dismissed).alias("missing"), F.count_if(~filled & dismissed).alias("not_expected"), F.count_if(owner).alias("owner"))
    rule = F.col("rule")
    b = proposals.agg(F.count_if(rule.isNotNull() & ~rule.isin("undated", "ambiguous", *DISMISSING)).alias("proposed"), F.count_if(rule.isNull() | (rule == "ambiguous")).alias("no_evidence"), F.count_if(rule == "undated").alias("undated"))
    return a.join(F.broadcast(b))  # one row each


def file_items(files: DataFrame) -> DataFrame:
    """Items from files (id, content_hash, path, modified_ns, value of the date or null) as the rules want them."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    return files.select("*", name.alias("name"), folder.alias("folder"), F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)).alias("extension"), times.day_of(F.col("value")).alias("day"), F.date_format(times.modified_day(F.col("modified_ns")), "yyyy-MM-dd").alias("modified"))
