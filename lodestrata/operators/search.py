"""Multi-predicate search: conditions, display order, pages, suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import geo, text

KINDS = ("photo", "video", "unknown", "undated", "located", "duplicates", "errors", "date_review", "stacks", "favorites", "hidden")


@dataclass(frozen=True)
class Search:
    """What to look for; all that is given must hold. ``near``: latitude, longitude, kilometres.

    ``stack``: empty shows the top of each stack only, ``all`` every member, a name that stack alone; where items carry
    the columns of ``with_stacks``. A trip is looked up by ``in_trip``.
    """

    q: str = ""
    kind: str = ""
    year: str = ""
    after: str = ""
    before: str = ""
    near: tuple[float, float, float] | None = None
    place: str = ""
    person: str = ""
    bucket: str = ""
    trip: str = ""
    stack: str = ""
    offset: int = 0
    limit: int = 80

    def __post_init__(self) -> None:
        if self.year and not re.fullmatch(r"\d{4}", self.year):
            raise ValueError("a year has four digits")
        for day in (self.after, self.before):
            if day:
                date.fromisoformat(day)
        if self.after and self.before and self.after > self.before:
            raise ValueError("the range of days is reversed")
        if self.near and not (abs(self.near[0]) <= 90 and abs(self.near[1]) <= 180 and 0 < self.near[2] <= 20000):
            raise ValueError("near takes a latitude, a longitude and a radius up to 20,000 km")
        if self.offset < 0 or not 1 <= self.limit <= 200:
            raise ValueError("offset from 0, limit from 1 to 200")

    def conditions(self, columns: list[str], searched: tuple[str, ...] = ("name",)) -> list[Column]:
        """Cheap conditions first, text last."""
        out: list[Column] = []
        if self.kind == "unknown":
            out.append(F.col("lat").isNull())
        elif self.kind == "undated":
            out.append(F.col("day").isNull())
        elif self.kind == "located":
            out.append(F.col("lat").isNotNull())
        elif self.kind in ("duplicates", "errors", "favorites", "hidden"):
            out.append(F.col({"duplicates": "duplicate", "errors": "metadata_error", "favorites": "favorite", "hidden": "hidden"}[self.kind]))
        elif self.kind == "date_review":
            out.append(F.col("date_status").isin("conflict", "timezone_unknown", "invalid") & ~F.col("date_confirmed"))
        elif self.kind == "stacks":
            out.append(F.col("stack_top"))
        elif self.kind:
            out.append(F.col("kind") == self.kind)
        if self.kind and self.kind not in KINDS and "kind" not in columns:
            raise ValueError(f"unknown kind {self.kind!r}")
        if "stack" in columns and self.kind != "stacks" and self.stack != "all":
            out.append(F.col("stack") == self.stack if self.stack else F.col("stack").isNull() | F.col("stack_top"))
        if "hidden" in columns and self.kind != "hidden":
            out.append(~F.col("hidden"))
        if self.year:
            out.append(F.col("day").startswith(self.year))
        if self.after:
            out.append(F.col("day") >= self.after)
        if self.before:
            out.append(F.col("day") <= self.before)
        if self.place:
            out.append(geo.cell_key(F.col("lat"), F.col("lon")).isin(*self.place.split(",")))
        if self.person:
            out.append(F.size("people") == 0 if self.person == "untagged" else F.array_contains("people", self.person))
        if self.bucket:
            out.append(F.array_contains("buckets", self.bucket))
        if self.near:
            out.extend(within(*self.near))
        if self.q:
            out.append(text.all_terms(text.searchable(*searched), self.q))
        return out


def within(lat: float, lon: float, km: float) -> list[Column]:
    """Conditions for rows within a radius: a band of latitudes, which scans can use, then the distance."""
    band = km / 111.0 + 0.1
    return [F.col("lat").between(lat - band, lat + band), geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= km]


def display_order() -> list[Column]:
    """Newest day first, then names downwards; undated rows last, ids break ties."""
    return [F.col("day").desc_nulls_last(), F.col("name").desc(), F.col("id")]


def search(items: DataFrame, spec: Search, searched: tuple[str, ...] = ("name",)) -> DataFrame:
    return reduce(DataFrame.where, spec.conditions(items.columns, searched), items)


def page(items: DataFrame, spec: Search, searched: tuple[str, ...] = ("name",), totals: bool = False) -> DataFrame:
    """One page of a search, in display order; with ``totals`` each row also has ``total`` and ``next_offset`` (null on the last page)."""
    found = search(items, spec, searched)
    rows = found.orderBy(*display_order()).offset(spec.offset).limit(spec.limit)
    if not totals:
        return rows
    end = spec.offset + spec.limit
    total = found.agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > end, F.lit(end).cast("long"))
    return rows.join(F.broadcast(total)).withColumn("next_offset", more)  # one row


def in_trip(items: DataFrame, trips: DataFrame, excluded: DataFrame, trip: object) -> DataFrame:
    """Items (day, content_hash, lat, lon) of a saved trip (trip, after, before, place: cells joined by commas): in its days and places and not excluded from it."""
    found = trips.where(F.col("trip") == trip).limit(2).collect()  # one row: the trip that is asked for
    if len(found) != 1:
        raise ValueError(f"unknown trip {trip!r}")
    t = found[0]
    own = items.where(F.col("day").between(t["after"], t["before"]))
    if t["place"]:
        own = own.where(geo.cell_key(F.col("lat"), F.col("lon")).isin(*t["place"].split(",")))
    out = excluded.where(F.col("trip") == trip).select(F.col("content_hash").alias("__out"))
    return own.join(out, F.col("content_hash") == F.col("__out"), "left_anti")


def in_bucket(items: DataFrame, buckets: DataFrame, members: DataFrame, bucket: object) -> DataFrame:
    """Items of a bucket: buckets (bucket), members (bucket, content_hash). An unknown bucket is an error, an empty one isn't."""
    if buckets.where(F.col("bucket") == bucket).isEmpty():
        raise ValueError(f"unknown bucket {bucket!r}")
    held = members.where(F.col("bucket") == bucket).select(F.col("content_hash").alias("__in"))
    return items.join(held, F.col("content_hash") == F.col("__in"), "left_semi")


def with_stacks(items: DataFrame, membership: DataFrame) -> DataFrame:
    """Items with ``stack`` and ``stack_top``, null outside stacks. membership: (content_hash, stack, is_top)."""
    m = membership.select(F.col("content_hash").alias("__m"), "stack", F.col("is_top").alias("stack_top"))
    return items.join(m, F.col("content_hash") == F.col("__m"), "left").drop("__m")


def with_recognised(items: DataFrame, texts: DataFrame, searched: str = "recognised") -> DataFrame:
    """Items with the text that was recognised in them (content_hash, text), to be named among the searched columns."""
    told = texts.groupBy(F.col("content_hash").alias("__t")).agg(F.array_join(F.sort_array(F.collect_set("text")), " ").alias(searched))
    return items.join(told, F.col("content_hash") == F.col("__t"), "left").drop("__t")


#: The months that date phrases name, by three letters or more.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def date_phrase(query: str) -> tuple[str, str] | None:
    """('year', '2024'), ('month', '2024-03') or ('day', '2024-03-05') where a query reads as one, else None."""
    q = " ".join(query.lower().split()) if query.strip() else ""
    for kind, pattern in (("year", r"(19|20)\d{2}"), ("month", r"(19|20)\d{2}-\d{2}"), ("day", r"(19|20)\d{2}-\d{2}-\d{2}")):
        if re.fullmatch(pattern, q):
            return kind, q
    m = re.fullmatch(r"(?P<word>[a-z]+)\.? (?P<year>(?:19|20)\d{2})", q) or re.fullmatch(r"(?P<year>(?:19|20)\d{2}) (?P<word>[a-z]+)\.?", q)
    number = next((i for i, name in enumerate(MONTHS, 1) if m and len(m["word"]) >= 3 and name.startswith(m["word"])), None)
    return ("month", f"{m['year']}-{number:02d}") if number else None


def date_hits(days: DataFrame, query: str) -> DataFrame:
    """(kind, value, count, offset) of the days with rows (day, n, offset in display order) that a date phrase names; no row where there are none."""
    phrase = date_phrase(query)
    if phrase is None:
        return days.limit(0).select(F.lit("").alias("kind"), F.lit("").alias("value"), F.col("n").alias("count"), "offset")
    own = days.where(F.col("day").startswith(phrase[1]))
    hit = own.agg(F.sum("n").alias("count"), F.min("offset").alias("offset")).where("count > 0")
    return hit.select(F.lit(phrase[0]).alias("kind"), F.lit(phrase[1]).alias("value"), "count", "offset")


def slideshow(items: DataFrame, spec: Search, limit: int = 500) -> DataFrame:
    """Oldest day first, undated rows last."""
    return search(items, spec).orderBy(F.col("day").asc_nulls_last(), "id").limit(limit)


def suggest(entries: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entries (kind, id, name) that hold all terms: those that start with the query first, then by name."""
    q = " ".join(query.lower().split())
    name = text.folded(F.col("name"))
    return entries.where(text.all_terms(F.col("name"), q)).orderBy((~name.startswith(q)).cast("int"), name, "kind", "id").limit(limit)


def everything(entries: dict[str, DataFrame], query: str, each: int = 10) -> DataFrame:
    """The first hits of each kind and their number: kind, id, name, total. entries: kind to (id, name)."""
    hits = []
    for kind, frame in entries.items():
        found = frame.where(text.all_terms(F.col("name"), query)).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name")
        total = found.agg(F.count("*").alias("total"))
        hits.append(found.orderBy(text.folded(F.col("name")), "id").limit(each).join(F.broadcast(total)))  # one row
    return reduce(DataFrame.unionByName, hits)


def arguments() -> list[str]:
    """Names of what a search takes."""
    return [f.name for f in fields(Search)]
