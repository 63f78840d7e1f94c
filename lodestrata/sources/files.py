"""Files as rows: folders, archives, JSON and tab-separated tables."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import media_kind
from lodestrata.operators.details import sidecar_names
from lodestrata.shipping import ship


def walk(spark: SparkSession, folder: str, skip_root: tuple[str, ...] = ("README.md",)) -> DataFrame:
    """relpath, kind, extension, size, mtime of all files under a folder. Contents aren't read; dot names are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    base = folder.removeprefix("file:").rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(base), "")
    extension = F.lower(F.regexp_extract(relative, r"(\.[^./]+)$", 1))
    rows = found.select(relative.alias("relpath"), media_kind(extension).alias("kind"), extension.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.where(~F.regexp_like("relpath", F.lit(r"(^|/)\."))).where(~F.col("relpath").isin(*skip_root))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in text)


MAX_JSON = 2 << 20


def _in_archives(spark: SparkSession, glob: str, each: Callable, schema: str) -> DataFrame:
    """Rows that ``each(path, archive, info, size)`` yields for the members of ZIP archives.

    Archives are listed without their contents and opened by seeking, so only their directories are read, and members that
    ``each`` asks for. Their number, not their size, is what tasks share; an archive that changes meanwhile is an error.
    """
    ship(spark)
    archives = spark.read.format("binaryFile").load(glob).select("path", "length", F.unix_micros("modificationTime").alias("mtime"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
                    rows = [r for m in archive.infolist() if not m.is_dir() for r in each(path, archive, m, length)]
                if system.get_file_info(inner).size != length:
                    raise RuntimeError(f"{path} changed while it was read")
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return archives.repartition("path").mapInPandas(run, schema)


def archive_members(spark: SparkSession, glob: str) -> DataFrame:
    """archive, member, offset, size, crc, source_size of all files inside ZIP archives; names that leave the archive are left out."""

    def row(path, archive, m, length):
        return [] if ".." in m.filename.split("/") else [(path, m.filename, m.header_offset, m.file_size, m.CRC, length)]

    return _in_archives(spark, glob, row, "archive string, member string, offset long, size long, crc long, source_size long")


def archive_sidecars(spark: SparkSession, glob: str, under: str = "Google Photos") -> DataFrame:
    """path, folder, name, raw of the JSON files inside ZIP archives that lie under a folder of that name; ``path`` is archive and member."""

    def row(path, archive, m, length):
        parts = m.filename.split("/")
        if not m.filename.lower().endswith(".json") or under not in parts[:-1] or ".." in parts or m.file_size > MAX_JSON:
            return []
        return [(f"{path}!{m.filename}", f"{path}!{'/'.join(parts[:-1])}", parts[-1], archive.read(m).decode("utf-8", "replace"))]

    return _in_archives(spark, glob, row, "path string, folder string, name string, raw string").where(_tells_time())


def _tells_time() -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), "$.photoTakenTime", "variant")).isNotNull()


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A log of JSON lines: malformed lines are left out, or with ``strict`` an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """path, folder, name, raw of the JSON files under a folder that tell when a photo was taken, of up to 2 MB."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(folder)
    raw = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), F.col("_metadata.file_size").alias("bytes")).where(F.col("bytes") <= MAX_JSON)
    cut = lambda i: F.regexp_extract("path", r"^(.*)/([^/]*)$", i)
    return raw.select("path", cut(1).alias("folder"), cut(2).alias("name"), "raw").where(_tells_time())


def attached(sidecars_: DataFrame, media: DataFrame) -> DataFrame:
    """(path, id, status): each sidecar (path, folder, name, raw) with the one file of its folder (folder, name, id) that it can
    belong to: attached, or ambiguous, or unmatched."""
    title = F.try_variant_get(F.try_parse_json("raw"), "$.title", "string")
    wanted = sidecars_.select("path", "folder", F.explode(sidecar_names(F.col("name"), title)).alias("wanted"))
    m = media.select(F.col("folder").alias("m_folder"), F.col("name").alias("m_name"), "id")
    met = wanted.join(m, (F.col("folder") == F.col("m_folder")) & (F.col("wanted") == F.col("m_name")))
    found = met.groupBy(F.col("path").alias("f_path")).agg(F.count_distinct("m_name").alias("n"), F.min("id").alias("id"))
    n = F.coalesce("n", F.lit(0))
    out = sidecars_.select("path").join(found, F.col("path") == F.col("f_path"), "left")
    return out.select("path", F.when(n == 1, F.col("id")).alias("id"), F.when(n == 1, "attached").when(n > 1, "ambiguous").otherwise("unmatched").alias("status"))


def settlements(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated gazetteer of 19 columns without quoting; a row with coordinates out of range is an error."""
    names = ["id", "name", "ascii", "alternate", "lat", "lon", "class", "code", "country", "cc2", "admin1", "admin2", "admin3", "admin4", "population", "elevation", "dem", "timezone", "modified"]
    raw = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"`{n}` string" for n in names))
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    sound = lat.between(-90, 90) & lon.between(-180, 180)
    return raw.select("id", "name", F.when(sound, lat).otherwise(F.raise_error(F.concat(F.lit("bad row: "), F.coalesce("id", F.lit("null")))).cast("double")).alias("lat"), lon.alias("lon"), "country", "admin1")


def features(spark: SparkSession, path: str) -> DataFrame:
    """properties and geometry, as JSON, of each feature of a GeoJSON collection."""
    whole = spark.read.option("wholetext", "true").text(path)
    parsed = whole.select(F.from_json("value", "struct<type:string,features:array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>>").alias("c"))
    return parsed.where("c.type = 'FeatureCollection'").select(F.explode("c.features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("coordinates"))


def markup_values(xml: Column, path: str) -> Column:
    """Texts at an XPath of an XML document (attributes, elements or list entries)."""
    return F.xpath(xml, F.lit(path))
