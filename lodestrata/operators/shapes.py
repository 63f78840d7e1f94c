"""Shapes for a map: rings and lines of GeoJSON geometries, simplified and cleaned, with their boxes.

Each part is simplified by itself (Douglas-Peucker; the ends stay, so a ring stays closed), rounded, and freed of points that
repeat the one before. Rings of fewer than four points and lines of fewer than two are gone. Features are small beside a
batch and worked on in Arrow batches; a feature may have any number of parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.shipping import ship

#: Which geometries have rings and which lines, and how deep a part's points lie in their coordinates.
SHAPES = {"Polygon": ("ring", 1), "MultiPolygon": ("ring", 2), "LineString": ("line", 0), "MultiLineString": ("line", 1)}
LEAST = {"ring": 4, "line": 2}


def kept_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points that lie farther than a tolerance from what is left without them; the ends stay."""
    if len(points) < 3 or tolerance <= 0:
        return points
    wanted, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        run, base = points[a + 1 : b], points[b] - points[a]
        length = float(np.hypot(*base))
        off = np.abs(base[0] * (points[a, 1] - run[:, 1]) - base[1] * (points[a, 0] - run[:, 0])) / length if length else np.hypot(*(run - points[a]).T)
        i = int(off.argmax())
        if off[i] > tolerance:
            wanted.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[sorted(wanted)]


def cleaned(points: list, tolerance: float, digits: int) -> list[list[float]]:
    """A part simplified, rounded and without repeats in a row."""
    if not points:
        return []
    flat = np.round(kept_points(np.array([p[:2] for p in points], float), tolerance), digits)
    new = np.append(True, (flat[1:] != flat[:-1]).any(axis=1))
    return flat[new].tolist()


def parts_of(shape: str, coordinates: str) -> tuple[str, list]:
    """(kind, parts) of a geometry; none of those that are neither rings nor lines."""
    kind, depth = SHAPES.get(shape, ("", 0))
    parts = json.loads(coordinates) if kind else []
    if depth == 0:
        return kind, [parts] if kind else []
    for _ in range(depth - 1):
        parts = [p for group in parts for p in group]
    return kind, parts


def simplified_shapes(features: DataFrame, tolerance: float, digits: int = 3, key: str = "id") -> DataFrame:
    """(id, kind, part, points) of features (id, shape, coordinates: JSON): kind is ``ring`` or ``line``, part counts what is left."""
    ship(features.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, shape, coordinates in zip(batch["id"], batch["shape"], batch["coordinates"], strict=True):
                kind, parts = parts_of(shape, coordinates)
                made = [c for c in (cleaned(p, tolerance, digits) for p in parts) if len(c) >= LEAST[kind]] if kind else []
                out += [(name, kind, i, c) for i, c in enumerate(made)]
            yield pd.DataFrame(out, columns=["id", "kind", "part", "points"])

    kind = features.schema[key].dataType.simpleString()
    return features.select(F.col(key).alias("id"), "shape", "coordinates").mapInPandas(run, f"id {kind}, kind string, part int, points array<array<double>>")


def boxes(shapes: DataFrame) -> DataFrame:
    """(id, parts, points, west, south, east, north) of each feature's parts together."""
    axis = lambda i: F.transform("points", lambda p: p[i])
    return shapes.groupBy("id").agg(
        F.count("*").alias("parts"), F.sum(F.size("points")).alias("points"), F.min(F.array_min(axis(0))).alias("west"), F.min(F.array_min(axis(1))).alias("south"), F.max(F.array_max(axis(0))).alias("east"), F.max(F.array_max(axis(1))).alias("north")
    )
