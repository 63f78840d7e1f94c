"""Sequential rules against plain versions: groups of faces, representatives, lines, clusters on a map, merges of people."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import details, neighbours, overlay


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def unit(v):
    n = math.sqrt(dot(v, v))
    return [x / n for x in v]


def faces(seed, n=70):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    made = []
    for i in range(n):
        base, length = rng.choice(centres), rng.choice((0.5, 1.0, 3.0))  # vectors are not of unit length
        made.append((i, rng.randrange(25), [length * (x + rng.gauss(0, 0.35)) for x in base], 0))
    rng.shuffle(made)
    return made


SCHEMA = "face_id long, content int, vector array<double>, block int"


@pytest.mark.parametrize("chunk", [4096, 12])
def test_complete_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK_FACES", chunk)
    rows = faces(3)
    groups = []
    for i, content, v, _ in sorted(rows):
        v = unit(v)
        fits = []
        for g in groups:
            like = [dot(x, v) for _, _, x in g]
            if like[0] >= 0.65 and min(like) >= 0.55 and all(c != content for _, c, _ in g):
                fits.append((like[0], g))
        fits.sort(key=lambda f: -f[0])
        if fits and (len(fits) == 1 or fits[0][0] - fits[1][0] >= 0.08):
            fits[0][1].append((i, content, v))
        else:
            groups.append([(i, content, v)])
    want = {i: g[0][0] for g in groups for i, _, _ in g}
    got = {r["face_id"]: r["group_id"] for r in neighbours.anchored_groups(spark.createDataFrame(rows, SCHEMA), "block").collect()}
    assert got == want and 3 < len(groups) < 60


def test_live_clusters(spark):
    rows = [(i, c, unit(v)) for i, c, v, _ in sorted(faces(4))]
    best = {i: max(dot(v, w) for j, _, w in rows if j != i) for i, _, v in rows}
    clusters = []  # (sum, members)
    for i, content, v in sorted(rows, key=lambda r: (-best[r[0]], r[0])):
        near = max(((dot(unit(s), v), -k) for k, (s, m) in enumerate(clusters) if all(c != content for _, c in m)), default=(-2, 0))
        if near[0] >= 0.52:
            s, m = clusters[-near[1]]
            s[:] = [a + b for a, b in zip(s, v, strict=True)]
            m.append((i, content))
        else:
            clusters.append((list(v), [(i, content)]))
    want = {i: min(j for j, _ in m) for _, m in clusters for i, _ in m}
    got = {r["face_id"]: r["group_id"] for r in neighbours.centroid_groups(spark.createDataFrame(faces(4), SCHEMA), "block").collect()}
    assert got == want and 3 < len(clusters) < 60


def test_representatives(spark):
    rng = random.Random(1)
    rows = [(i % 3, i, rng.choice((0.5, 0.7, 0.9)), unit(v)) for i, _, v, _ in faces(5, 40)]
    want = []
    for c in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1])):
            if all(dot(r[3], k[3]) < 0.5 for k in kept):
                kept.append(r)
        want += [(c, r[1]) for r in kept]
    got = details.representatives(spark.createDataFrame(rows, "content long, face_id long, score double, vector array<double>"), "content").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < 40


def plain_line(points, tolerance):
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    length = math.hypot(bx - ax, by - ay)
    off = [abs((bx - ax) * (ay - y) - (by - ay) * (ax - x)) / length if length else math.hypot(x - ax, y - ay) for x, y in points[1:-1]]
    i = max(range(len(off)), key=lambda k: off[k])
    if off[i] <= tolerance:
        return [points[0], points[-1]]
    return plain_line(points[: i + 2], tolerance)[:-1] + plain_line(points[i + 1 :], tolerance)


def test_lines(spark):
    rng = random.Random(6)
    rows = [(i, [[float(x), rng.gauss(0, 0.3)] for x in range(rng.randint(2, 40))]) for i in range(20)] + [(99, [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]])]
    got = {r["id"]: r["points"] for r in neighbours.simplified(spark.createDataFrame(rows, "id long, points array<array<double>>"), 0.25).collect()}
    assert got == {i: [[round(v, 3) for v in p] for p in plain_line(points, 0.25)] for i, points in rows}


def test_clusters_on_a_map(spark):
    """The largest first, others within 44 pixels of it; equal ones by name, over many tiles."""
    rng = random.Random(7)
    cells = [(f"c{i}", 60 - rng.random() * 120, rng.random() * 360 - 180, rng.randrange(9)) for i in range(700)]
    size = 256.0 * 2**3

    def at(lat, lon):
        s = math.sin(math.radians(lat))
        return (lon / 360 + 0.5) * size, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * size

    centres, want = [], {}
    for name, lat, lon, _ in sorted(cells, key=lambda c: (-c[3], c[0])):
        x, y = at(lat, lon)
        home = next((c for u, v, c in centres if (u - x) ** 2 + (v - y) ** 2 <= 44.0**2), None)
        if home is None:
            centres.append((x, y, name))
        want[name] = home or name
    made = spark.createDataFrame(cells, "cell string, lat double, lon double, n long")
    for few in (0, 200, 10_000):  # rounds to the end, some of them, none
        assert dict(map(tuple, details.screen_clusters(made, 3, few=few).collect())) == want
    assert 40 < len(centres) < 700


@pytest.mark.parametrize(("blocks", "people", "seed"), [(3, 4, 8), (2, 12, 1), (1, 2, 5), (2, 40, 3)])
def test_merges_of_people(spark, blocks, people, seed):
    rng = random.Random(seed)
    ops = [(b, s, rng.choice(("add", "add", "remove", "merge_person")), rng.randrange(people), rng.randrange(6), rng.randrange(people)) for b in range(blocks) for s in range(120)]
    want = set()
    for b in range(blocks):
        tags: dict = {}
        for _, _, op, person, member, source in sorted(o for o in ops if o[0] == b):
            if op == "add":
                tags.setdefault(person, set()).add(member)
            elif op == "remove":
                tags.get(person, set()).discard(member)
            elif source != person:
                tags.setdefault(person, set()).update(tags.pop(source, set()))
        want |= {(b, p, m) for p, ms in tags.items() for m in ms}
    df = spark.createDataFrame(ops, "block long, seq long, op string, person long, member long, source long").orderBy(F.rand(1))
    assert {tuple(r) for r in overlay.merged_people(df, "block").collect()} == want


def test_complete_links_look_only_into_groups_with_a_like_first_member():
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    content = rng.integers(0, 97, 400)
    groups = []
    for i in range(len(x)):
        fits = []
        for g, members in enumerate(groups):
            like = x[members] @ x[i]
            if like[0] >= 0.6 and like.min() >= 0.5 and content[i] not in content[members]:
                fits.append((-like[0], g))
        fits.sort()
        if fits and (len(fits) == 1 or -fits[0][0] + fits[1][0] >= 0.02):
            groups[fits[0][1]].append(i)
        else:
            groups.append([i])
    assert neighbours.complete_links(x, content, 0.6, 0.5, 0.02) == groups and 1 < len(groups) < 400
