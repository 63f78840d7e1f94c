"""Embedded metadata packets (XMP) as rows: a table function that reads RDF/XML by its namespaces.

A field may be written as an attribute of a description, as an element with text, or as a container of list entries; all
three give the same values. ``fields`` registers nothing: it joins the function laterally to a column.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The namespaces of XMP and of the vocabularies that are read.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "lr": "http://ns.adobe.com/lightroom/1.0/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "exif": "http://ns.adobe.com/exif/1.0/",
}
#: The fields that are read.
FIELDS = ("dc:subject", "lr:hierarchicalSubject", "dc:title", "dc:description", "xmp:Rating", "photoshop:DateCreated", "exif:DateTimeOriginal", "xmp:CreateDate")


def _named(field: str) -> str:
    prefix, name = field.split(":")
    return f"{{{NAMESPACES[prefix]}}}{name}"


def packet_values(packet: str) -> dict[str, list[str]]:
    """Values of the known fields in one packet, in order of the document; a packet that is no XML raises."""
    from xml.etree import ElementTree

    found: dict[str, list[str]] = {}
    if "<!DOCTYPE" in packet or "<!ENTITY" in packet:
        raise ValueError("packets declare no entities")
    for described in ElementTree.fromstring(packet[packet.index("<") :]).iter(_named("rdf:Description")):
        for field in FIELDS:
            own = described.get(_named(field))
            if own is not None:
                values = [own]
            else:
                values = [t for e in described.findall(_named(field)) for t in ([x.text or "" for x in e.iter(_named("rdf:li"))] or [e.text or ""])]
            values = [v.strip() for v in values if v.strip()]
            if values:
                found.setdefault(field, []).extend(values)
    return found


@F.udtf(returnType="field string, found array<string>, error string")
class PacketFields:
    """A row for each field of a packet; one with the error's kind for a packet that can't be read; none for null or blank ones."""

    def eval(self, packet: str | None) -> Iterator[tuple[str | None, list[str] | None, str | None]]:
        if packet is None or not packet.strip():
            return
        try:
            values = packet_values(packet)
        except Exception as broken:  # one file's packet, of many
            yield None, None, type(broken).__name__
            return
        for field, found in values.items():
            yield field, found, None


def with_fields(rows: DataFrame, packet: str, key: str) -> DataFrame:
    """Rows with ``xmp``, a map from each field of their packet to its values (empty without any), and ``xmp_error``; ``key`` is unique."""
    from lodestrata.shipping import ship

    ship(rows.sparkSession)
    told = rows.select(F.col(key).alias("__k"), F.col(packet).alias("__p")).lateralJoin(PacketFields(F.col("__p").outer()))
    made = told.groupBy("__k").agg(F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "found"))))).alias("xmp"), F.first("error", ignorenulls=True).alias("xmp_error"))
    none = F.create_map().cast("map<string,array<string>>")
    return rows.join(made, F.col(key) == F.col("__k"), "left").withColumn("xmp", F.coalesce("xmp", none)).drop("__k")
