"""Names, search terms and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(text: Column) -> Column:
    """Lower case with the sharp s written out, so that spellings of one word meet."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalised(query: Column) -> Column:
    return F.trim(F.regexp_replace(folded(query), r"\s+", " "))


def folded_words(query: str) -> list[str]:
    """The words of a query, spelt as ``folded`` spells texts."""
    return query.lower().replace("ß", "ss").split()


def all_terms(text: Column, query: str) -> Column:
    """Whether every term of the query is a substring of the text, whatever the case."""
    if len(query) > 300:
        raise ValueError("a query has at most 300 characters")
    found = F.lit(True)
    for term in folded_words(query):
        found = found & folded(text).contains(term)
    return found


def searchable(*columns: str) -> Column:
    """The columns' texts as one, lower case; arrays are joined, nulls left out."""
    return folded(F.concat_ws(" ", *columns))


def occurrence_id(source: Column, member: Column, offset: Column) -> Column:
    """SHA-256 of the JSON list of the three, with a space after each comma."""
    quoted = lambda c: F.to_json(F.array(c))
    piece = lambda c: F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2)
    return F.sha2(F.concat(F.lit("["), piece(source), F.lit(", "), piece(member), F.lit(", "), offset.cast("string"), F.lit("]")), 256)


def row_id(*columns: Column) -> Column:
    """SHA-256 over the fields, parted by NUL."""
    return F.sha2(F.concat_ws("\0", *[c.cast("string") for c in columns]), 256)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_name(text: Column, fallback: str = "untitled", longest: int = 80) -> Column:
    """A name for a folder: no characters that paths forbid, single spaces, no dots or spaces at its ends, at most ``longest`` characters."""
    ends = lambda c: F.regexp_replace(c, r"^[ .]+|[ .]+$", "")
    clean = F.trim(F.regexp_replace(ends(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]+', " ")), r"\s+", " "))
    cut = ends(F.substring(clean, 1, longest))
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(fallback)).otherwise(cut)


def family(name: Column) -> tuple[Column, Column]:
    """(prefix, part number) of ``takeout-<x>-NNN.zip``, three digits and lower case; null for other names."""
    pattern = r"^(takeout-.+)-(\d{3})\.zip$"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.regexp_extract(name, pattern, 2).try_cast("int")


def sequence_key(name: Column) -> tuple[Column, Column]:
    """(prefix, number) by the last run of three digits or more in the name's stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    pattern = r"^(.*?)(\d{3,})(?!.*\d{3,}).*$"
    return F.when(F.regexp_like(stem, F.lit(r"\d{3,}")), F.lower(F.regexp_extract(stem, pattern, 1))), F.regexp_extract(stem, pattern, 2).try_cast("decimal(38,0)")


#: The extensions of each kind of media file.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif", "avif", "jpg_large", "png_dip_staged")
RAW_EXTENSIONS = ("dng", "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "orf", "rw2", "raf", "pef", "srw", "3fr", "x3f")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "mpg", "mpeg", "wmv", "3gp", "m2ts", "mts")


def media_kind(extension: Column) -> Column:
    """photo, raw, video or other, by the extension in any case, with or without its dot."""
    own = F.lower(F.ltrim(extension, F.lit(".")))
    return F.when(own.isin(*PHOTO_EXTENSIONS), "photo").when(own.isin(*RAW_EXTENSIONS), "raw").when(own.isin(*VIDEO_EXTENSIONS), "video").otherwise("other")


def byte_range(header: Column, size: Column) -> Column:
    """struct(first, last, partial) of an HTTP ``bytes=`` range over a file's size, the whole file without a header; null where it
    can't be served: several ranges, an empty suffix, none of it inside."""
    pattern = r"^bytes=(\d*)-(\d*)$"
    first, last = (F.regexp_extract(header, pattern, i).try_cast("long") for i in (1, 2))
    begin = F.when(first.isNotNull(), first).otherwise(F.greatest(size - last, F.lit(0).cast("long")))
    end = F.when(first.isNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    sound = F.regexp_like(header, F.lit(pattern)) & (first.isNotNull() | (last > 0)) & (begin < size) & (begin <= end)
    whole = F.struct(F.lit(0).cast("long").alias("first"), (size - 1).alias("last"), F.lit(False).alias("partial"))
    return F.when(F.coalesce(header, F.lit("")) == "", whole).when(sound, F.struct(begin.alias("first"), end.alias("last"), F.lit(True).alias("partial")))
