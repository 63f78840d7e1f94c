"""Audits of exports: what archives hold beside a catalogue, from their directories and small JSON files alone.

Everything is counted by entries; equal sizes, names or checksums make candidates, not proven copies. No task holds an
archive or a family of archives: entries meet by exact path within their family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.details import LAST_SECOND, capture_coverage, sidecar_claims

MAX_JSON = 2 << 20
#: What a sidecar's name ends in after its medium's.
SUFFIXES = (".supplemental-metadata.json", ".json")


def family(archive: Column) -> tuple[Column, Column]:
    """(family, part) of an archive's name; an archive that isn't numbered is its own family."""
    pattern = r"^(takeout-.+)-(\d{3})\.zip$"
    own = F.regexp_extract(archive, pattern, 1)
    return F.when(own != "", own).otherwise(archive), F.when(own != "", F.regexp_extract(archive, pattern, 2).cast("int"))


def key_shapes(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """(keys, n): how many JSON objects have exactly these keys, sorted and joined by commas; what is no object has none."""
    keys = F.array_join(F.array_sort(F.array_distinct(F.json_object_keys(raw))), ",")
    return rows.where(F.try_parse_json(raw).isNotNull()).select(keys.alias("keys")).where("keys is not null").groupBy("keys").agg(F.count("*").alias("n"))


def part_gaps(archives: DataFrame) -> DataFrame:
    """(family, part) of parts that are missing between a family's first and last (archive)."""
    own, part = family(F.col("archive"))
    parts = archives.select(own.alias("family"), part.alias("part")).where("part is not null").distinct()
    ends = parts.groupBy("family").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    every = ends.select("family", F.explode(F.sequence("low", "high")).alias("part"))  # at most a thousand
    return every.join(parts, ["family", "part"], "left_anti")


def _targets(path: Column, title: Column) -> Column:
    """Paths that a sidecar may belong to: its title beside it, and its own without the suffix."""
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    said = F.when((title != "") & ~title.contains("/") & ~title.contains("\\") & ~title.isin(".", ".."), F.concat(folder, title))
    cut = reduce(lambda out, s: F.when(path.endswith(s), F.expr(f"substring(path, 1, length(path) - {len(s)})")).otherwise(out), reversed(SUFFIXES), F.lit(None).cast("string"))
    return F.array_distinct(F.array_compact(F.array(said, cut)))


def export_audit(media: DataFrame, sidecars: DataFrame, catalogue: DataFrame, latest: int = LAST_SECOND) -> DataFrame:
    """(measure, item, n) of an export.

    media: (id, family, path, size, crc); sidecars: (id, family, path, raw); catalogue: (name, size). A JSON file is oversized,
    unreadable, no object, without a taking time, or a photo's sidecar, which fits one entry, several (ambiguous) or none.
    ``latest``: the last second that counts as a time of taking.
    """
    count = lambda rows, measure, item=None: rows.groupBy((F.lit("") if item is None else item).alias("item")).agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "item", "n")
    v = F.try_parse_json("raw")
    kind = F.schema_of_variant(v)
    state = F.when(F.octet_length("raw") > MAX_JSON, "oversized").when(v.isNull(), "unreadable").when(~kind.startswith("OBJECT"), "not_object")
    state = state.when(F.try_variant_get(v, "$.photoTakenTime", "variant").isNull() & ~F.coalesce(F.array_contains(F.json_object_keys("raw"), "photoTakenTime"), F.lit(False)), "without_photo_taken_time").otherwise("photo")
    told = sidecars.withColumn("state", state)
    out = [count(told, "json", F.col("state"))]
    objects = told.where(F.col("state").isin("without_photo_taken_time", "photo"))
    out.append(key_shapes(objects).select(F.lit("key_shape").alias("measure"), F.col("keys").alias("item"), "n"))

    photos = told.where("state = 'photo'")
    title = F.when(F.schema_of_variant(F.try_variant_get(v, "$.title", "variant")) == "STRING", F.try_variant_get(v, "$.title", "string"))
    wanted = photos.select("id", F.col("family").alias("w_family"), F.explode(_targets(F.col("path"), title)).alias("target"))
    met = wanted.join(media.select(F.col("id").alias("m_id"), "family", "path"), (F.col("w_family") == F.col("family")) & (F.col("target") == F.col("path"))).select("id", "m_id").distinct()
    fits = met.groupBy("id").agg(F.count("*").alias("fits"), F.min("m_id").alias("m_id"))
    joined = photos.select("id", F.col("id").cast("string").alias("path"), "raw").join(fits.withColumnRenamed("id", "f_id"), F.col("id") == F.col("f_id"), "left")
    how = F.when(F.col("fits") == 1, "unique").when(F.col("fits") > 1, "ambiguous").otherwise("unmatched")
    out.append(count(joined, "sidecar", how))
    unique = joined.where("fits = 1")
    owned = unique.groupBy("m_id").agg(F.count("*").alias("sidecars"))
    out += [count(owned, "media_with_unique_sidecar"), count(owned.where("sidecars > 1"), "media_with_multiple_sidecars")]
    for measure, rows in (("coverage", joined), ("coverage_unique", unique)):
        out.append(capture_coverage(sidecar_claims(rows.select("path", "raw"), latest)).select(F.lit(measure).alias("measure"), F.col("key").alias("item"), "n"))

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    pairs = catalogue.select(F.col("name").alias("c_name"), F.col("size").alias("c_size")).distinct()
    sizes = catalogue.select(F.col("size").alias("s_size")).distinct()
    known = media.withColumn("name", name).join(pairs, (F.col("name") == F.col("c_name")) & (F.col("size") == F.col("c_size")), "left").join(sizes, F.col("size") == F.col("s_size"), "left")
    overlap = known.withColumn("overlap", F.when(F.col("c_name").isNotNull(), "name_size_candidate").when(F.col("s_size").isNotNull(), "size_only_candidate").otherwise("no_equal_size_in_catalog"))
    out += [count(overlap, "overlap", F.col("overlap")), overlap.groupBy("overlap").agg(F.sum("size").alias("n")).select(F.lit("overlap_bytes").alias("measure"), F.col("overlap").alias("item"), "n")]
    year = F.regexp_extract("path", r"(?:^|/)Photos from (\d{4})(?:/|$)", 1)
    out += [count(media.withColumn("y", year).where("y <> ''"), "year_folder", F.col("y")), count(media, "extension", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))]
    twins = media.groupBy("size", "crc").agg((F.count("*") - 1).alias("extra"))
    out.append(twins.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n")).select(F.lit("repeated_size_crc_extra").alias("measure"), F.lit("").alias("item"), "n"))
    return reduce(DataFrame.unionByName, out)


def survey_coverage(population: DataFrame, sample: DataFrame, fields: list[str], strata: tuple[str, ...] = ("source", "shape")) -> DataFrame:
    """The strata's columns, measure, n: how many of the population, of the sample, of those that were probed (``probed``) and of
    those that have each field."""
    measures = [F.count_if(F.col("probed")).alias("probed"), *[F.count_if(F.col(f).isNotNull()).alias(f) for f in fields]]
    chosen = sample.groupBy(*strata).agg(F.count("*").alias("selected"), *measures)
    every = population.groupBy(*strata).agg(F.count("*").alias("population"))
    names = ["population", "selected", "probed", *fields]
    met = reduce(lambda a, b: a & b, [every[c].eqNullSafe(chosen[c]) for c in strata])
    joined = every.join(chosen, met, "left").select(*[every[c] for c in strata], *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    return joined.unpivot(list(strata), names, "measure", "n")
