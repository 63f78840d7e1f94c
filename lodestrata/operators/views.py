"""Detail views: what is known about one item, one content, one album or trip; reviews of dates and faces.

Each takes and gives tables. A view of one item is the same view with a condition: ``keys`` cuts down the inputs
before anything is joined, so the condition reaches the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import times, vectors
from lodestrata.operators.evidence import date_status


def date_review(claims: DataFrame, names: DataFrame, chosen: DataFrame, latest_year: int) -> DataFrame:
    """(content_hash, status, choice, value, source, confidence, selected): claimed dates, then those that file names tell, and the owner's choice.

    claims: (content_hash, value, source) of capture dates; names: (content_hash, name) of all files; chosen: (content_hash, choice).
    Names are guesses: they are never among the claims, so they don't count for the status.
    """
    claimed = claims.select("content_hash", "value", "source").distinct().withColumn("confidence", F.lit(None).cast("double"))
    claimed = claimed.withColumn("choice", F.sha2(F.concat_ws("\n", F.coalesce("value", F.lit("")), "source"), 256))
    told = names.groupBy("content_hash").agg(F.collect_set("name").alias("names")).select("content_hash", F.explode(times.name_times(F.col("names"), latest_year)).alias("t"))
    told = told.select("content_hash", "t.value", F.lit("inferred").alias("source"), "t.confidence", F.concat(F.lit("inferred:"), "t.field", F.lit(":"), "t.value").alias("choice"))
    every = claimed.unionByName(told)
    subjects = every.select("content_hash").distinct()
    status = date_status(claims, identity=("source",), subjects=subjects).withColumnRenamed("content_hash", "s_hash")
    owner = chosen.select(F.col("content_hash").alias("o_hash"), F.col("choice").alias("o_choice"))
    met = every.join(status, F.col("content_hash") == F.col("s_hash")).join(owner, F.col("content_hash") == F.col("o_hash"), "left")
    return met.select("content_hash", "status", "choice", "value", "source", "confidence", F.coalesce(F.col("choice") == F.col("o_choice"), F.lit(False)).alias("selected"))


def with_inferred_dates(items: DataFrame, names: DataFrame, latest_year: int) -> DataFrame:
    """Items (content_hash, value) with ``value`` filled from file names where it is null, and ``date_inferred``."""
    best = names.groupBy(F.col("content_hash").alias("__h")).agg(F.collect_set("name").alias("names")).select("__h", F.get(times.name_times(F.col("names"), latest_year), F.lit(0))["value"].alias("__told"))
    met = items.join(best, F.col("content_hash") == F.col("__h"), "left")
    inferred = F.col("value").isNull() & F.col("__told").isNotNull()
    return met.withColumn("date_inferred", inferred).withColumn("value", F.coalesce("value", "__told")).drop("__h", "__told")


def transcripts(work: DataFrame, segments: DataFrame, model: str) -> DataFrame:
    """(content, status, segments): of contents worked on by the current model, their segments in order of time; an empty list if there are none."""
    own = segments.where(F.col("model") == model).groupBy(F.col("content").alias("__c")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("segments"))
    met = work.where(F.col("model") == model).join(own, F.col("content") == F.col("__c"), "left")
    return met.select("content", "status", F.coalesce("segments", F.array().cast(own.schema["segments"].dataType)).alias("segments"))


def current_facts(facts: DataFrame, models: list[str], by: str = "content_hash", order: tuple[str, ...] = ("derived_at", "model")) -> DataFrame:
    """Of each content the last fact of the current model or of those that are as good."""
    kept = facts.where(F.col("model").isin(*models))
    return kept.groupBy(by).agg(F.max_by(F.struct(*[c for c in facts.columns if c != by]), F.struct(*order)).alias("f")).select(by, "f.*")


def faces_of(faces: DataFrame, named: DataFrame, ignored: DataFrame, people: DataFrame, covers: DataFrame) -> DataFrame:
    """(content, face_id, person, ignored, cover): every face with the person it is named for, if that person is still there.

    named: (face_id, person); ignored: (face_id); people: (person); covers: (person, face_id).
    """
    n = named.select(F.col("face_id").alias("n_face"), F.col("person").alias("n_person")).join(people.select(F.col("person").alias("p")), F.col("n_person") == F.col("p"), "left_semi")
    i = ignored.select(F.col("face_id").alias("i_face")).distinct()
    c = covers.select(F.col("person").alias("c_person"), F.col("face_id").alias("c_face"))
    met = faces.select("content", "face_id").join(n, F.col("face_id") == F.col("n_face"), "left").join(i, F.col("face_id") == F.col("i_face"), "left")
    met = met.join(c, (F.col("n_person") == F.col("c_person")) & (F.col("face_id") == F.col("c_face")), "left")
    return met.select("content", "face_id", F.col("n_person").alias("person"), F.col("i_face").isNotNull().alias("ignored"), F.col("c_face").isNotNull().alias("cover"))


def person_means(exemplars: DataFrame) -> DataFrame:
    """(person, mean): the mean of each person's vectors (person, vector), at length 1."""
    parts = exemplars.select("person", F.posexplode("vector").alias("i", "x")).groupBy("person", "i").agg(F.avg("x").alias("x"))
    listed = parts.groupBy("person").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return listed.select("person", vectors.unit(F.col("mean")).alias("mean")).where("mean is not null")


def group_hints(groups: DataFrame, means: DataFrame, threshold: float) -> DataFrame:
    """(group_id, person, similarity) of groups (group_id, centroid) that are like a person's mean at the threshold or above: the most alike, ties to the smaller."""
    from lodestrata.operators.neighbours import best_groups

    met = best_groups(groups.withColumnRenamed("centroid", "vector"), means.withColumnRenamed("mean", "vector"), "person", key="group_id").where("rank = 1")
    return met.where(F.col("first") >= threshold).select("group_id", "person", F.col("first").alias("similarity"))


def face_review(members: DataFrame, faces: DataFrame, named: DataFrame, ignored: DataFrame, hints: DataFrame, show_ignored: bool = False) -> DataFrame:
    """(place, group_id, faces, size, person, similarity): groups of faces still to be named, the largest first, then by id.

    members: (face_id, group_id). Named and ignored faces are left out afterwards, so naming one never reshuffles the others.
    """
    gone = ignored.select(F.col("face_id").alias("g")).distinct()
    if show_ignored:
        open_ = members.join(gone, F.col("face_id") == F.col("g"), "left_semi")
    else:
        open_ = members.join(gone.unionByName(named.select(F.col("face_id").alias("g"))).distinct(), F.col("face_id") == F.col("g"), "left_anti")
    known = open_.join(faces.select(F.col("face_id").alias("f")), F.col("face_id") == F.col("f"), "left_semi")
    sized = known.groupBy("group_id").agg(F.sort_array(F.collect_list("face_id")).alias("faces"), F.count("*").alias("size"))
    met = sized.join(hints.withColumnRenamed("group_id", "h"), F.col("group_id") == F.col("h"), "left").drop("h")
    return met.orderBy(F.desc("size"), "group_id")


def album_items(albums: DataFrame, items: DataFrame) -> DataFrame:
    """(album, position, content_hash, id, total, missing): an album's contents in stored order, with those that are gone.

    albums: (album, contents); items: (content_hash, id).
    """
    each = albums.select("album", F.posexplode("contents").alias("position", "content_hash"))
    first = items.groupBy(F.col("content_hash").alias("__h")).agg(F.min("id").alias("id"))
    met = each.join(first, F.col("content_hash") == F.col("__h"), "left").drop("__h")
    totals = met.groupBy(F.col("album").alias("__a")).agg(F.count("*").alias("total"), F.count_if(F.col("id").isNull()).alias("missing"))
    return met.join(totals, F.col("album") == F.col("__a")).drop("__a")


def trip_exclusions(excluded: DataFrame, items: DataFrame, trip: object, limit: int = 200) -> DataFrame:
    """(content_hash, id, total, missing): the first excluded items of a trip in order of hashes; those that are gone are counted only."""
    own = excluded.where(F.col("trip") == trip).select("content_hash").distinct()
    first = items.groupBy(F.col("content_hash").alias("__h")).agg(F.min("id").alias("id"))
    met = own.join(first, F.col("content_hash") == F.col("__h"), "left").drop("__h")
    totals = met.agg(F.count("*").alias("total"), F.count_if(F.col("id").isNull()).alias("missing"))
    return met.where("id is not null").orderBy("content_hash").limit(limit).join(F.broadcast(totals))  # one row


def frame_observations(frames: DataFrame, samplers: list[str]) -> DataFrame:
    """Frames of any of the samplers that are as good as the current one; of a frame that several gave, that of the first named."""
    rank = F.array_position(F.array(*[F.lit(s) for s in samplers]), F.col("sampler"))
    kept = frames.where(F.col("sampler").isin(*samplers))
    return kept.groupBy("frame_id").agg(F.min_by(F.struct(*[c for c in frames.columns if c != "frame_id"]), rank).alias("f")).select("frame_id", "f.*")


def unchanged_paths(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(path, sound): whether each recorded file (path, size, mtime_ns) is there as it was; only such may be read."""
    n = now.select(F.col("path").alias("n_path"), F.col("size").alias("n_size"), F.col("mtime_ns").alias("n_time"))
    met = recorded.join(n, F.col("path") == F.col("n_path"), "left")
    return met.select("path", (F.col("n_size").eqNullSafe(F.col("size")) & F.col("n_time").eqNullSafe(F.col("mtime_ns"))).alias("sound"))


def unknown_members(events: DataFrame, items: DataFrame, photos_only: Column) -> DataFrame:
    """(event, content_hash) that an event names though there is no such item, or no photo where ``photos_only`` (a condition on events) holds.

    A write whose events give any row here must be refused. events: (event, op, contents); items: (content_hash, kind).
    """
    each = events.select("event", photos_only.alias("photos"), F.explode("contents").alias("content_hash"))
    kinds = items.groupBy(F.col("content_hash").alias("__h")).agg(F.max(F.col("kind") == "photo").alias("photo"))
    met = each.join(kinds, F.col("content_hash") == F.col("__h"), "left")
    return met.where(F.col("photo").isNull() | (F.col("photos") & ~F.col("photo"))).select("event", "content_hash")


def reviewed(ranked: DataFrame, reviews: DataFrame, query: str, mode: str, key: str = "content_hash") -> DataFrame:
    """Ranked rows (key, rank) with their verdict and new place: matches, then open ones, then mismatches, each in prior order; none is hidden.

    reviews: (mode, query, item, verdict), of which the query is normalised.
    """
    asked = " ".join(query.lower().replace("ß", "ss").split())
    own = reviews.where((F.col("mode") == mode) & (F.col("query") == asked)).select(F.col("item").alias("__item"), "verdict")
    met = ranked.join(own, F.col(key) == F.col("__item"), "left").drop("__item")
    group = F.when(F.col("verdict") == "match", 0).when(F.col("verdict") == "mismatch", 2).otherwise(1)
    return met.withColumn("place", F.row_number().over(Window.orderBy(group, "rank")))  # over one page of at most 200 rows


def visual_hits(scored: DataFrame, described: DataFrame, most: int = 200) -> DataFrame:
    """(content_hash, score, tagged, rank): what a colour and a noun describe comes first, by hash, then the best scores; at most ``most``.

    scored: (content_hash, score); described: (content_hash) that the query's words fit, whether they have a score or not.
    """
    best = scored.groupBy("content_hash").agg(F.max("score").alias("score"))
    tags = described.select(F.col("content_hash").alias("__t")).where("__t is not null").distinct()
    met = best.join(tags, F.col("content_hash") == F.col("__t"), "full_outer")
    met = met.select(F.coalesce("content_hash", "__t").alias("content_hash"), "score", F.col("__t").isNotNull().alias("tagged"))
    order = [F.desc("tagged"), F.when(~F.col("tagged"), -F.col("score")), "content_hash"]
    top = met.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over the cut rows


#: The categories of a description, and the colours of objects.
CATEGORIES = ("photograph", "screenshot", "illustration", "document", "other")


def parsed_description(raw: Column) -> Column:
    """struct(caption, category, objects) of a model's JSON, with or without a code fence; null where its form is wrong.

    A caption of 1 to 1,500 characters, a known category, at most ten objects with a name and a colour of 1 to 80 each; these
    come in lower case, each pair once.
    """
    bare = F.regexp_replace(F.trim(raw), r"(?s)^```[^\n]*\n(.*?)\s*```.*$", "$1")
    j = F.from_json(bare, "struct<caption:string,category:string,objects:array<struct<name:string,color:string>>>")
    fits = lambda c, n: F.coalesce(F.length(c).between(1, n), F.lit(False))
    keys = F.coalesce(F.array_sort(F.json_object_keys(bare)) == F.array(F.lit("caption"), F.lit("category"), F.lit("objects")), F.lit(False))
    sound = keys & fits(j["caption"], 1500) & j["category"].isin(*CATEGORIES) & j["objects"].isNotNull() & (F.size(j["objects"]) <= 10) & F.forall(j["objects"], lambda o: fits(o["name"], 80) & fits(o["color"], 80))
    clean = lambda c: F.trim(F.lower(c))
    objects = F.array_distinct(F.transform(j["objects"], lambda o: F.struct(clean(o["name"]).alias("name"), clean(o["color"]).alias("color"))))
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(j["caption"].alias("caption"), j["category"].alias("category"), objects.alias("objects")))
