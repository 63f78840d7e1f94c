"""Vectors as arrays of doubles, 64-bit hashes as two halves of 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; null if it is empty, zero or not finite."""
    length = F.sqrt(dot(a, a))
    return F.when((F.size(a) > 0) & (length > 0) & (length < float("inf")), F.transform(a, lambda x: x.cast("double") / length))


def hamming(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def halves(hex16: Column) -> tuple[Column, Column]:
    """The two halves of a hash of 16 hex digits, as longs."""
    return F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hex16, 9, 8), 16, 10).cast("long")


def group_id(members: Column) -> Column:
    """Name of a set: first 32 hex digits of the SHA-256 of its sorted members, one a line."""
    return F.substring(F.sha2(F.array_join(F.sort_array(members), "\n"), 256), 1, 32)


def average_hash(samples: Column) -> Column:
    """Bits as a string: 1 where a sample exceeds the mean of all."""
    mean = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(samples)
    return F.array_join(F.transform(samples, lambda x: F.when(x.cast("double") > mean, "1").otherwise("0")), "")


def difference_hash(samples: Column, width: int = 9) -> Column:
    """Bits as a string over rows of ``width`` samples: 1 where a sample is under its right neighbour."""
    places = F.filter(F.sequence(F.lit(0), F.size(samples) - 2), lambda i: (i % width) != width - 1)
    return F.array_join(F.transform(places, lambda i: F.when(F.get(samples, i) < F.get(samples, i + 1), "1").otherwise("0")), "")
