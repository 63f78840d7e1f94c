"""Pairing, stacks, gap proposals, suggestions, validation and other rules over catalogue rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import geo, text, times, vectors
from lodestrata.operators import journeys, rollups
from lodestrata.shipping import ship
from lodestrata.storage import materialise

#: How sure a fact of each kind is.
CONFIDENCE = {"capture_date": 0.95, "other_date": 0.7, "location": 0.9, "camera": 0.95, "hash": 1.0, "phash": 0.2}


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of several catalogues, each with its source; columns that one lacks are null."""
    frames = [f.withColumn("source", F.lit(name)) for name, f in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def confidence_of(kind: Column) -> Column:
    return reduce(lambda out, item: F.when(kind == item[0], F.lit(item[1])).otherwise(out), CONFIDENCE.items(), F.lit(None).cast("double"))


#: Names and folders of what no camera took, extensions cameras don't write, names that are only a hash.
NOT_CAPTURED = r"(?i)screen ?shot|screen ?cap|screen ?record|screenshot|^snip|clipboard"
GENERATED_FOLDER = r"(?i)Gemini Apps|AI Studio|My Activity"
ASSET_EXTENSIONS = (".png", ".bmp", ".gif", ".webp", ".svg", ".ico")
HASH_NAME = r"(?i)^[a-f0-9]{16,}(-\(\d+\))?$"


def not_a_capture(name: Column, folder: Column) -> Column:
    """Whether a file is named like a picture of a screen, or lies in a folder of generated images."""
    return F.regexp_like(name, F.lit(NOT_CAPTURED)) | F.regexp_like(F.coalesce(folder, F.lit("")), F.lit(GENERATED_FOLDER))


def asset_like(name: Column, extension: Column) -> Column:
    """Whether a file is of a format that cameras don't write, or its stem is only a hash."""
    return F.lower(extension).isin(*ASSET_EXTENSIONS) | F.regexp_like(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(HASH_NAME))


#: The brands of video in the ISO container.
VIDEO_BRANDS = ("isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "M4V ", "qt  ", "3gp4", "3gp5", "3gp6")


def is_media_container(content: Column) -> Column:
    """Whether bytes begin as a video in the ISO container."""
    return (F.substring(content, 5, 4).cast("string") == "ftyp") & F.substring(content, 9, 4).cast("string").isin(*VIDEO_BRANDS)


#: Fixed value: the suffix of sidecar names, which long names cut short.
SUPPLEMENT = ".supplemental-metadata"


def sidecar_names(name: Column, title: Column | None = None) -> Column:
    """Names of media that a sidecar may belong to: its own without ``.json`` and the suffix, however short that was cut, and its
    title. A closing ``(n)`` moves before the extension of each."""
    bare = F.regexp_replace(name, r"(?i)\.json$", "")
    tag = F.regexp_extract(bare, r"(\(\d+\))$", 1)
    base = F.regexp_replace(bare, r"\(\d+\)$", "")
    tail = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    base = F.when((tail != "") & F.lit(SUPPLEMENT).startswith(tail), F.substring(base, F.lit(1), F.length(base) - F.length(tail))).otherwise(base)
    said = F.lit(None).cast("string") if title is None else F.when(~title.contains("/") & ~title.contains("\\") & ~title.isin(".", ".."), title)
    placed = lambda c: F.when(tag == "", c).when(c.contains("."), F.concat(F.regexp_extract(c, r"^(.*)\.[^.]*$", 1), tag, F.regexp_extract(c, r"(\.[^.]*)$", 1))).otherwise(F.concat(c, tag))
    return F.array_distinct(F.transform(F.filter(F.array(base, said), lambda c: c.isNotNull() & (c != "")), placed))


#: The last second that dates of four-digit years can have.
LAST_SECOND = 253402300799


def sidecar_claims(told: DataFrame, latest: int = LAST_SECOND) -> DataFrame:
    """path, attribute, value, meaning, field: what each sidecar (path, raw JSON) states, none of it inferred.

    The raw document without its people; dates of taking and of creation, of which a whole number of seconds is written
    as text, ``latest`` at most; two places with both coordinates as numbers in range and not both zero; a description that isn't empty.
    Years beyond 9999 are written with a plus sign.
    """
    v = F.try_parse_json("raw")
    of = lambda path, kind: F.try_variant_get(v, path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    claim = lambda a, value, meaning=None, at=None: F.when(value.isNotNull(), F.struct(F.lit(a).alias("attribute"), value.alias("value"), F.lit(meaning).cast("string").alias("meaning"), F.lit(at).cast("string").alias("field")))

    def date(key: str) -> Column:
        path = f"$.{key}.timestamp"
        seconds = F.when((kind(path) == "STRING") & F.regexp_like(of(path, "string"), F.lit(r"^-?\d{1,18}$")), of(path, "string").try_cast("long"))
        return F.when(seconds.between(-62135596800, latest), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))

    def place(key: str) -> Column:
        number = lambda axis: F.when(F.regexp_like(kind(f"$.{key}.{axis}"), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), of(f"$.{key}.{axis}", "double"))
        lat, lon = number("latitude"), number("longitude")
        return F.when(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ((lat != 0) | (lon != 0)), F.concat_ws(",", lat.cast("string"), lon.cast("string")))

    document = F.to_json(F.to_variant_object(F.map_filter(v.cast("map<string,variant>"), lambda k, x: k != "people")))
    described = F.when((kind("$.description") == "STRING") & (of("$.description", "string") != ""), of("$.description", "string"))
    claims = [claim("raw_sidecar", document), claim("date", date("photoTakenTime"), "capture", "photoTakenTime"), claim("date", date("creationTime"), "Google Photos creation", "creationTime")]
    claims += [claim("location", place(key), None, key) for key in ("geoData", "geoDataExif")] + [claim("description", described)]
    return told.select("path", F.explode(F.array_compact(F.array(*claims))).alias("c")).select("path", "c.*")


def raw_pairs(files: DataFrame) -> DataFrame:
    """folder, stem, raws, others: raw files and what was developed from them, by folder and stem in any case."""
    stem = text.folded(F.regexp_replace("name", r"\.[^.]*$", ""))
    kind = text.media_kind(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    listed = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("name"))))
    pairs = files.withColumns({"stem": stem, "__kind": kind}).where(F.col("__kind").isin("raw", "photo")).groupBy("folder", "stem").agg(listed(F.col("__kind") == "raw").alias("raws"), listed(F.col("__kind") == "photo").alias("others"))
    return pairs.where((F.size("raws") > 0) & (F.size("others") > 0))


def burst_alike(rows: DataFrame, seconds: int, distance: int, key: str) -> DataFrame:
    """(a, b) of rows (key, day, at, hi, lo) of one day within some seconds whose hashes differ in few bits.

    Both sides are dealt to time buckets as wide as the window, one of them to its neighbours too, so the join is on equal keys.
    """
    bucket = F.floor(F.col("at") / seconds)
    left = rows.withColumn("__b", bucket)
    right = rows.select(*[F.col(c).alias(f"o_{c}") for c in (key, "day", "at", "hi", "lo")], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__ob"))
    met = left.join(right, (F.col("day") == F.col("o_day")) & (F.col("__b") == F.col("__ob")) & (F.struct("at", key) < F.struct("o_at", f"o_{key}")))
    close = (F.col("o_at") - F.col("at") <= seconds) & (vectors.hamming(F.col("hi"), F.col("lo"), F.col("o_hi"), F.col("o_lo")) <= distance)
    return met.where(close).select(F.col(key).alias("a"), F.col(f"o_{key}").alias("b"))


def stack_tops(members: DataFrame, group: str, key: str) -> DataFrame:
    """group, top, members: of each group the row with the most pixels, the earliest, then the smallest key."""
    order = F.struct(-F.col("pixels"), F.col("at").isNull(), F.col("at"), F.col(key))
    return members.groupBy(group).agg(F.min_by(key, order).alias("top"), F.count("*").alias("members")).where("members > 1")


def claimed(owner: DataFrame, proposals: DataFrame, group: str, member: str) -> DataFrame:
    """Owner's groups, and those proposals of which no member is in an owner's group."""
    taken = proposals.join(owner.select(F.col(member).alias("__m")).distinct(), F.col(member) == F.col("__m"), "left_semi").select(F.col(group).alias("__g")).distinct()
    return owner.select(group, member).withColumn("confirmed", F.lit(True)).unionByName(proposals.join(taken, F.col(group) == F.col("__g"), "left_anti").select(group, member).withColumn("confirmed", F.lit(False)))


def location_proposals(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """id, cell, strength for unlocated rows (id, day): the one cell of the day, or ambiguous, or none. cells: (day, cell) of located rows."""
    by_day = cells.groupBy(F.col("day").alias("__day")).agg(F.count_distinct("cell").alias("n"), F.min("cell").alias("cell"))
    met = rows.join(by_day, F.col("day") == F.col("__day"), "left")
    n = F.coalesce("n", F.lit(0))
    return met.select("id", F.when(n == 1, F.col("cell")).alias("cell"), F.when(n == 1, "strong").when(n > 1, "ambiguous").otherwise("none").alias("strength"))


def gap_coverage(rows: DataFrame, value: str, expected: Column, proposed: Column) -> DataFrame:
    """Counts of rows that have a value, lack one, aren't expected to have one, and have a proposal."""
    missing = F.col(value).isNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(~missing).alias("filled"), F.count_if(missing & expected).alias("missing"), F.count_if(missing & ~expected).alias("not_expected"), F.count_if(missing & expected & proposed).alias("proposed"), F.count_if(missing & expected & ~proposed).alias("no_evidence"))


def uncovered(proposals: DataFrame, saved: DataFrame) -> DataFrame:
    """Proposals (id, cell, first, last) that no saved trip of their cell covers."""
    s = saved.select(F.col("cell").alias("__c"), F.col("first").alias("__f"), F.col("last").alias("__l"))
    return proposals.join(s, (F.col("cell") == F.col("__c")) & (F.col("first") >= F.col("__f")) & (F.col("last") <= F.col("__l")), "left_anti")


def resolve(names: DataFrame, wanted: str) -> object:
    """The id of the one row of (id, name) whose id is ``wanted`` or whose name is it in any case; none or several is an error."""
    found = names.where((F.col("id").cast("string") == wanted) | (text.folded(F.col("name")) == wanted.lower().replace("ß", "ss"))).select("id").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} row is called {wanted!r}")
    return found[0]["id"]


def boxes_near(features: DataFrame, centres: DataFrame, reach: float, cell: float = 2.0) -> DataFrame:
    """Features (id, west, south, east, north) whose box, widened by ``reach``, holds a centre (x, y): grid cells first, then the box."""
    span = lambda low, high: F.sequence(F.floor((F.col(low) - reach) / cell), F.floor((F.col(high) + reach) / cell))
    dealt = features.withColumn("__x", F.explode(span("west", "east"))).withColumn("__y", F.explode(span("south", "north")))
    at = centres.select("x", "y", F.floor(F.col("x") / cell).alias("__cx"), F.floor(F.col("y") / cell).alias("__cy")).distinct()
    inside = F.col("x").between(F.col("west") - reach, F.col("east") + reach) & F.col("y").between(F.col("south") - reach, F.col("north") + reach)
    return dealt.join(at, (F.col("__x") == F.col("__cx")) & (F.col("__y") == F.col("__cy")) & inside, "left_semi").drop("__x", "__y").distinct()


#: The colours that a query may name; grey is gray.
COLOURS = ("red", "blue", "green", "yellow", "orange", "purple", "pink", "brown", "black", "white", "gray", "grey", "silver", "gold")


def described(rows: DataFrame, query: str) -> DataFrame:
    """Rows (caption, category, objects array<struct<name,color>>) that a description fits: a colour and a noun of one object, or all terms somewhere."""
    words = text.folded_words(query)
    if len(words) == 2 and words[0] in COLOURS:
        gray = lambda c: F.when(c == "grey", "gray").otherwise(c)
        colour = "gray" if words[0] == "grey" else words[0]
        fits = F.exists("objects", lambda o: (gray(F.lower(o["color"])) == colour) & F.array_contains(F.split(F.lower(o["name"]), r"\s+"), words[1]))
        return rows.where(F.coalesce(fits, F.lit(False)))
    told = text.folded(F.concat_ws(" ", "caption", "category", F.transform("objects", lambda o: F.concat_ws(" ", o["color"], o["name"]))))
    return rows.where(reduce(lambda a, w: a & told.contains(w), words, F.lit(True)))


def capture_coverage(claims: DataFrame) -> DataFrame:
    """(key, n): how many sidecars state what, by claims as ``sidecar_claims`` gives them; the year of taking has a key each."""
    a = F.col("attribute")
    taken = (a == "date") & (F.col("meaning") == "capture")
    keys = F.when(taken, F.array(F.lit("capture_timestamp"), F.concat(F.lit("capture_year_"), F.regexp_extract("value", r"^\+?0*(\d+)", 1))))
    keys = keys.when(a == "location", F.array(F.concat(F.col("field"), F.lit("_nonzero_location")))).when(a == "description", F.array(F.lit("nonempty_description")))
    return claims.select("path", F.explode(keys).alias("key")).distinct().groupBy("key").agg(F.count("*").alias("n"))


#: Where an image's embedded title, caption and date are looked for, in this order.
TITLES, CAPTIONS, DATES = ("dc:title", "iptc:ObjectName"), ("dc:description", "iptc:Caption"), ("photoshop:DateCreated", "exif:DateTimeOriginal", "xmp:CreateDate")


def embedded_summary(xmp: Column, iptc: Column) -> Column:
    """struct(keywords, title, caption, rating, created) of embedded fields (maps from a field to its values); what isn't there is null."""
    of = lambda field: F.try_element_at(iptc if field.startswith("iptc") else xmp, F.lit(field))
    first = lambda fields: F.coalesce(*[F.when(F.size(of(f)) > 0, F.struct(F.substring(F.get(of(f), F.lit(0)), 1, 2000).alias("value"), F.lit(f).alias("source"))) for f in fields])
    raw = F.get(of("xmp:Rating"), F.lit(0))
    rating = F.when(F.regexp_like(raw, F.lit(r"^-?\d+(\.0+)?$")) & raw.try_cast("double").between(-1.0, 5.0), raw.try_cast("double").cast("int"))
    told = lambda f: F.get(F.filter(F.transform(of(f), lambda x: times.tag_time(x)), lambda x: x.isNotNull()), F.lit(0))
    filed = times.tag_time(F.concat(F.get(of("iptc:DateCreated"), F.lit(0)), F.coalesce(F.get(of("iptc:TimeCreated"), F.lit(0)), F.lit(""))))
    created = F.coalesce(*[F.when(told(f).isNotNull(), F.struct(told(f).alias("value"), F.lit("xmp:" + f).alias("source"))) for f in DATES], F.when(filed.isNotNull(), F.struct(filed.alias("value"), F.lit("iptc:DateCreated").alias("source"))))
    return F.struct(keywords(of("dc:subject"), of("lr:hierarchicalSubject"), of("iptc:Keywords")).alias("keywords"), first(TITLES).alias("title"), first(CAPTIONS).alias("caption"), rating.alias("rating"), created.alias("created"))


def sound_segments(segments: DataFrame, by: str | None = None) -> DataFrame:
    """Transcript segments (start, end, duration, text, and avg_logprob and no_speech_prob where there are such) that can be.

    All numbers finite, the start before the end, within the recording and a second, of two hours at most; a text that
    isn't blank, of at most 10,000 characters. With ``by``, a recording of which any segment can't be is left out whole.
    """
    numbers = [c for c in ("start", "end", "duration", "avg_logprob", "no_speech_prob") if c in segments.columns]
    finite = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), numbers, F.lit(True))
    timed = F.col("duration").between(0.0, 7200.0) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("duration") + 1)
    sound = F.coalesce(finite & timed & F.regexp_like("text", F.lit(r"\S")) & (F.length("text") <= 10_000), F.lit(False))
    if by is None:
        return segments.where(sound)
    bad = segments.where(~sound).select(F.col(by).alias("__bad")).distinct()
    return segments.join(bad, F.col(by).eqNullSafe(F.col("__bad")), "left_anti")


def shown_words(words: Column, least: float = 0.5) -> Column:
    """Of recognised words (array<struct<word,score>>) those to show: sure enough, with two letters or digits in a row."""
    return F.filter(words, lambda w: (w["score"] >= least) & F.regexp_like(w["word"], F.lit(r"[\p{L}\p{N}]{2}")))


def recognised(words: DataFrame, least: float = 0.45) -> DataFrame:
    """id, text, confidence of words (id, words array<struct<word,score>>): those at the threshold or above, and their mean score."""
    kept = F.filter("words", lambda w: w["score"] >= least)
    mean = F.aggregate(kept, F.lit(0.0), lambda s, w: s + w["score"]) / F.nullif(F.size(kept), F.lit(0))
    return words.select("id", F.array_join(F.transform(kept, lambda w: w["word"]), " ").alias("text"), mean.alias("confidence"))


def thumb_size(width: Column, height: Column, box: int = 512) -> tuple[Column, Column]:
    """Fitted into a square, never enlarged, rounded half to even, one pixel at least; null for sizes that can't be."""
    sound = (width > 0) & (height > 0)
    scale = F.least(F.lit(1.0), F.lit(float(box)) / F.greatest(width, height))
    fit = lambda x: F.when(sound, F.greatest(F.lit(1), F.bround(x * scale, 0).cast("int")))
    return fit(width), fit(height)


def video_summary(raw: Column) -> Column:
    """width, height, duration, codec of a probe's JSON: the first video stream, the container's duration where the stream has none."""
    j = F.from_json(raw, "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string>>,format:struct<duration:string>>")
    v = F.get(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    seconds = F.coalesce(v["duration"].try_cast("double"), j["format"]["duration"].try_cast("double"))
    return F.when(v.isNotNull(), F.struct(v["width"].alias("width"), v["height"].alias("height"), seconds.alias("duration"), v["codec_name"].alias("codec")))


def keywords(subjects: Column, hierarchical: Column, iptc: Column) -> Column:
    """All keywords in order of their first place: subjects, last parts of hierarchical ones, IPTC; at most 200."""
    last = F.transform(hierarchical, lambda x: F.element_at(F.split(x, r"\|"), -1))
    empty = F.array().cast("array<string>")
    joined = F.concat(F.coalesce(subjects, empty), F.coalesce(last, empty), F.coalesce(iptc, empty))
    return F.slice(F.array_distinct(F.filter(F.transform(joined, lambda x: F.trim(x)), lambda x: x != "")), 1, 200)


def suggestions(pending: DataFrame, exemplars: DataFrame, single: float = 0.70, best: float = 0.65, second: float = 0.55, margin: float = 0.08, most: int | None = 32) -> DataFrame:
    """face_id, person, score: for pending faces the person whose exemplars (person, face_id, vector; named by hand) they are like.

    Of each person at most ``most`` exemplars count, evenly spaced in order of ids (None: all of them). Faces meet them in blocks of bounded size.
    """
    from lodestrata.operators.neighbours import best_groups

    spaced = exemplars
    if most is not None:
        places = exemplars.withColumns({"__i": F.row_number().over(Window.partitionBy("person").orderBy("face_id")) - 1, "__n": F.count("*").over(Window.partitionBy("person"))})
        spaced = places.where(F.array_contains(times.even_places(F.col("__n"), most), F.col("__i").cast("long")))
    two = best_groups(pending, materialise(spaced.select("person", "vector"), "exemplars"), "person")
    nearest = two.withColumn("next", F.lead("first").over(Window.partitionBy("face_id").orderBy("rank"))).where("rank = 1")
    fits = F.when(F.col("second").isNull(), F.col("first") >= single).otherwise((F.col("first") >= best) & (F.col("second") >= second))
    return nearest.where(fits & (F.col("next").isNull() | (F.col("first") - F.col("next") >= margin))).select("face_id", "person", F.col("first").alias("score"))


def representatives(faces: DataFrame, by: str, most_alike: float = 0.5) -> DataFrame:
    """by, face_id of faces (by, face_id, score, vector) kept greedily, best first, if no kept one of their content is as like."""
    ship(faces.sparkSession)

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "face_id"], ascending=[False, True])
        kept: list[int] = []
        x = np.array(frame["vector"].tolist())
        for i in range(len(frame)):
            if all(float(x[i] @ x[k]) < most_alike for k in kept):
                kept.append(i)
        return frame.iloc[kept][[by, "face_id"]]

    return faces.select(by, "face_id", "score", "vector").groupBy(by).applyInPandas(keep, f"{by} {faces.schema[by].dataType.simpleString()}, face_id long")


#: Undecided cells of which one task decides the rest.
FEW_CELLS = 20_000


def screen_clusters(cells: DataFrame, zoom: int, radius: float = 44.0, few: int = FEW_CELLS) -> DataFrame:
    """cell, cluster for map cells (cell, lat, lon, n) at a zoom level: the largest first (of equal ones the first by name), each cell
    goes to the first centre within a radius on screen, or becomes one. Cells beyond the map's latitudes are left out.

    The order is not followed one by one. In a grid of tiles whose diagonal is the radius, a tile's first undecided cell becomes a
    centre where it comes before those of all tiles in reach, since nothing that is undecided can come before it there. What lies
    within reach of a new centre is decided too. Rounds go on while more than ``few`` cells are undecided, which one task then
    takes in order. When all centres are known, each cell meets those in reach, of which a tile holds one at most. No pairs of
    cells are made, and tiles have no edges that show.
    """
    ship(cells.sparkSession)
    size, side = 256.0 * 2**zoom, radius / 2**0.5
    y = F.lit(0.5) - F.log((1 + F.sin(F.radians("lat"))) / (1 - F.sin(F.radians("lat")))) / (4 * np.pi)
    placed = cells.where(F.abs("lat") < 85.06).select("cell", F.struct((-F.col("n")).alias("n"), "cell").alias("order"), ((F.col("lon") / 360.0 + 0.5) * size).alias("x"), (y * size).alias("y"))
    tile = lambda c: F.floor(F.col(c) / side)
    placed = materialise(placed.withColumns({"i": tile("x"), "j": tile("y")}), "cells")
    near = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]  # tiles that hold points within the radius
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near]))

    def around(rows: DataFrame, *columns: str) -> DataFrame:
        """The rows at every tile in reach."""
        spread = rows.select(*columns, "i", "j", offsets.alias("o"))
        return spread.select(*[F.col(c).alias(f"z_{c}") for c in columns], (F.col("i") + F.col("o.i")).alias("z_i"), (F.col("j") + F.col("o.j")).alias("z_j"))

    def met(rows: DataFrame, centres: DataFrame) -> DataFrame:
        z = around(centres, "cell", "order", "x", "y")
        both = rows.join(z, (F.col("i") == F.col("z_i")) & (F.col("j") == F.col("z_j")))
        return both.where((F.col("x") - F.col("z_x")) ** 2 + (F.col("y") - F.col("z_y")) ** 2 <= radius**2)

    centres, open_ = [], placed
    while open_.count() > few:
        firsts = open_.groupBy("i", "j").agg(F.min_by(F.struct("cell", "order", "x", "y"), "order").alias("f")).select("i", "j", "f.*")
        least = around(firsts, "order").groupBy("z_i", "z_j").agg(F.min("z_order").alias("least"))
        new = materialise(firsts.join(least, (F.col("i") == F.col("z_i")) & (F.col("j") == F.col("z_j"))).where("order = least").select(*placed.columns), "centres")
        gone = met(open_, new).select(F.col("cell").alias("gone")).distinct()
        open_ = materialise(open_.join(gone, F.col("cell") == F.col("gone"), "left_anti"), "open")
        centres.append(new)

    def rest(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple[int, int], tuple[float, float]] = {}
        out = []
        for r in frame.sort_values(["n", "cell"]).itertuples():
            found = (held.get((r.i + i, r.j + j)) for i, j in near)
            if not any(z and (z[0] - r.x) ** 2 + (z[1] - r.y) ** 2 <= radius**2 for z in found):
                held[r.i, r.j] = (r.x, r.y)
                out.append(r.cell)
        return pd.DataFrame({"chosen": out})

    last = open_.select(F.lit(0).alias("all"), "cell", "order.n", "x", "y", "i", "j").groupBy("all").applyInPandas(rest, "chosen string")
    every = reduce(DataFrame.unionByName, centres, placed.join(last, F.col("cell") == F.col("chosen"), "left_semi"))
    return met(placed, every).groupBy("cell").agg(F.min_by("z_cell", "z_order").alias("cluster"))


def trip_legs(points: DataFrame, trips: DataFrame, far: float = 0.2, days: int = 30) -> DataFrame:
    """trip, before_id, after_id: the last located item before a trip and the first after it, where it is within some days
    and farther away than ``far`` degrees from the trip's first (or last) point.

    points: (id, n, at, name, lat, lon), n a day's number, at the time as text; trips: (trip, first, last, and the latitude and
    longitude of both ends). Points are first cut down to two for each day, and days are looked up by nearest_known.
    """
    from lodestrata.operators.gaps import nearest_known

    point = F.struct("id", "lat", "lon")
    order = F.struct("at", "name", "id")
    by_day = points.groupBy("n").agg(F.struct(F.min_by(point, order).alias("opens"), F.max_by(point, order).alias("closes")).alias("day"))
    asked = trips.select((F.col("first") - 1).alias("n")).unionByName(trips.select((F.col("last") + 1).alias("n"))).distinct()
    every = by_day.unionByName(asked.withColumn("day", F.lit(None).cast(by_day.schema["day"].dataType))).groupBy("n").agg(F.first("day", ignorenulls=True).alias("day"))
    near = nearest_known(every, [], "n", "day", 1024)
    before = near.select(F.col("n").alias("b_n"), F.col("below.at").alias("b_at"), F.col("below.value.closes").alias("b"))
    after = near.select(F.col("n").alias("a_n"), F.col("above.at").alias("a_at"), F.col("above.value.opens").alias("a"))
    met = trips.join(before, F.col("first") - 1 == F.col("b_n"), "left").join(after, F.col("last") + 1 == F.col("a_n"), "left")
    away = lambda p, end: (F.abs(F.col(f"{p}.lat") - F.col(f"{end}_lat")) > far) | (F.abs(F.col(f"{p}.lon") - F.col(f"{end}_lon")) > far)
    return met.select("trip", F.when((F.col("first") - F.col("b_at") <= days) & away("b", "first"), F.col("b.id")).alias("before_id"), F.when((F.col("a_at") - F.col("last") <= days) & away("a", "last"), F.col("a.id")).alias("after_id"))


def trip_paths(items: DataFrame, trips: DataFrame, excluded: DataFrame, most: int = 40) -> DataFrame:
    """(trip, number, lat, lon, points, located, days): each trip's path, in time, without repeats in a row and thinned evenly to ``most`` points.

    items: (id, content_hash, day, at, name, lat, lon, cell), located and dated; trips: (trip, after, before, place: cells
    joined by commas, '' for any); excluded: (trip, content_hash). Steps run within days and then between days.
    """
    met = journeys.in_ranges(items, trips, "day", "after", "before").where((F.col("place") == "") | F.array_contains(F.split("place", ","), F.col("cell")))
    out = excluded.select(F.col("trip").alias("x_trip"), F.col("content_hash").alias("x_hash"))
    met = met.join(out, (F.col("trip") == F.col("x_trip")) & (F.col("content_hash") == F.col("x_hash")), "left_anti")
    rows = met.select("trip", "day", "at", "name", "id", F.struct(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).alias("p"))
    within = Window.partitionBy("trip", "day").orderBy("at", "name", "id")
    by_day = rows.groupBy("trip", "day").agg(F.count("*").alias("n"), F.max_by("p", F.struct("at", "name", "id")).alias("last"))
    over = Window.partitionBy("trip").orderBy("day")
    by_day = by_day.select(F.col("trip").alias("d_trip"), F.col("day").alias("d_day"), F.lag("last").over(over).alias("was"))
    totals = rows.groupBy(F.col("trip").alias("t_trip")).agg(F.count("*").alias("located"), F.count_distinct("day").alias("days"))
    ways = rows.withColumn("before", F.lag("p").over(within)).join(by_day, (F.col("trip") == F.col("d_trip")) & (F.col("day") == F.col("d_day")))
    turns = ways.where(~F.col("p").eqNullSafe(F.coalesce("before", "was"))).select("trip", "day", "at", "name", "id", "p")
    counts = turns.groupBy("trip", "day").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("trip").alias("c_trip"), F.col("day").alias("c_day"), (F.sum("n").over(over) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("trip")).alias("points"))
    placed = turns.withColumn("i", F.row_number().over(within)).join(counts, (F.col("trip") == F.col("c_trip")) & (F.col("day") == F.col("c_day"))).withColumn("i", F.col("i") + F.col("offset") - 1)
    kept = placed.where(F.array_contains(times.even_places(F.col("points"), most), F.col("i"))).join(totals, F.col("trip") == F.col("t_trip"))
    return kept.select("trip", F.col("i").alias("number"), "p.lat", "p.lon", "points", "located", "days")


def missing_artifacts(items: DataFrame, have: DataFrame, key: str = "id") -> DataFrame:
    """Every item without an artifact, with its place in the order of work: plain ones newest first, then members of archives by archive and offset.

    items: (id, day, place_in: struct of archive and offset, null for plain files); have: the items that have one. Places are
    found within stored ranges and then between them, so no task sees all rows.
    """
    missing = items.join(have.select(F.col(key).alias("__have")), F.col(key) == F.col("__have"), "left_anti")
    later = F.when(F.col("place_in").isNull(), F.coalesce("day", F.lit("")))
    return rollups.placed(missing, F.col("place_in").isNotNull(), later.desc(), F.col("place_in"), F.col(key))


def evidence_bundle(items: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Items with all their facts (attribute, value) as one sorted list."""
    listed = facts.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct("attribute", "value"))).alias("facts"))
    return items.join(listed, F.col(key) == F.col("__k"), "left").drop("__k")


def evidence_of(items: DataFrame, key: str, **told: DataFrame) -> DataFrame:
    """Items with everything that is known of them: for each table (key and what it tells) an array of its rows, sorted; empty without any.

    Copies of a row count once. Tables are grouped before they meet the items, each by itself, so none multiplies another.
    """
    out = items
    for name, rows in told.items():
        own = [c for c in rows.columns if c != key]
        listed = rows.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_set(F.struct(*own))).alias(name))
        none = F.array().cast(listed.schema[name].dataType)
        out = out.join(listed, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, none))
    return out


def with_search_text(items: DataFrame, key: str, *names: DataFrame) -> DataFrame:
    """Items with ``search_text``: their name and the names (key, name) that people, places, trips and buckets give them."""
    told = reduce(DataFrame.unionByName, [n.select(key, "name") for n in names]).groupBy(F.col(key).alias("__k")).agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("__told"))
    return items.join(told, F.col(key) == F.col("__k"), "left").withColumn("search_text", text.searchable("name", "__told")).drop("__k", "__told")


def stated_date(*candidates: tuple[Column, str]) -> Column:
    """The first candidate (raw text, meaning) that is a possible time."""
    made = [F.when(times.stated_time(raw).isNotNull(), F.struct(times.stated_time(raw).alias("value"), F.lit(meaning).alias("meaning"))) for raw, meaning in candidates]
    return F.coalesce(*made)


def cell_of(items: DataFrame) -> DataFrame:
    return items.withColumn("cell", geo.cell_key(F.col("lat"), F.col("lon")))
