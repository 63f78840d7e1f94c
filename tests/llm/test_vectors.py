import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import exact_topk, grid, one_bit_codes

SCHEMA = "vec_id long, embedding array<float>, id int, vector string, query double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], SCHEMA)


def sample(n=600, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[: n // 3] = x[0]  # a vector that a third of all rows have
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


AWKWARD = [(5, None), (15, []), (25, [float("nan")] * 16), (35, [None] + [0.5] * 15), (45, [float("inf")] + [0.5] * 15), (55, [0.0] * 16), (65, [1.0, 2.0]), (85, [3.0, -1.0]), (None, [1.0] * 16)]


def brute(rows, k, score, zero):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, x in {(i, tuple(v)): (i, v) for i, v in sound if i % 5 == 0}.values():
        best = sorted((-score(x, y), i) for i, y in sound if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def small_blocks(monkeypatch):
    monkeypatch.setattr(grid, "MIN_ROWS", 90)
    monkeypatch.setattr(grid, "QUERY_ROWS", 40)
    monkeypatch.setattr(exact_topk, "CHUNK", 7)
    monkeypatch.setattr(one_bit_codes, "CHUNK", 7)


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_exact_search(spark, monkeypatch, slices):
    small_blocks(monkeypatch)
    rows = sample() + AWKWARD + [(7, sample()[7][1])]
    rows = [r for r in rows if r[0] is None or r not in sample()[5:100:10]]
    dot = lambda x, y: int((np.floor(64 * x) * np.floor(64 * y)).sum())
    got = sorted(tuple(r) for r in exact_topk.search(table(spark, rows), F.col("vec_id") % 5 == 0, k=20, slices=slices).collect())
    assert got == brute(rows, 20, dot, True)


def test_exact_search_of_large_components(spark):
    rows = [(i, [float(i % 7) * 1e6, -float(i % 5) * 1e6]) for i in range(60)]
    dot = lambda x, y: int(sum(int(a) * int(b) for a, b in zip(np.floor(64 * x), np.floor(64 * y), strict=True)))
    got = sorted(tuple(r) for r in exact_topk.search(table(spark, rows), F.col("vec_id") % 5 == 0, k=3).collect())
    assert got == brute(rows, 3, dot, True)


def test_codes_find_nearly_all(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = sample(dim=32) + [(i, v) for i, v in AWKWARD if v is None or len(v) < 3]
    index = one_bit_codes.build_index(table(spark, rows))
    assert index.count() == 602
    got = one_bit_codes.search(index, index.where("id % 5 = 0"), k=20).collect()
    want = brute(rows, 20, lambda x, y: float((x * y).sum()), False)
    assert len(got) == len(want)
    scores = {(q, i): s for q, _, i, s in want}
    by_query = {}
    for q, r, i, s in want:
        by_query.setdefault(q, []).append(s)
    hits = sum(r["score"] >= min(by_query[r["query_id"]]) - 1e-9 for r in got)
    assert hits >= 0.9 * len(want)
    assert all(abs(scores[r["query_id"], r["vec_id"]] - r["score"]) < 1e-9 for r in got if (r["query_id"], r["vec_id"]) in scores)


def test_estimates_and_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    bits, length, product = one_bit_codes.encode(x, 7)
    signs = np.unpackbits(bits, axis=1).astype(float) * 2 - 1
    turned = q @ one_bit_codes.rotation(64, 7)
    estimate = signs @ turned * length / (product * 8)
    bound = length * np.sqrt(1 - product**2) / product * 1.9 / np.sqrt(63) * np.linalg.norm(q)
    assert (np.abs(estimate - x @ q) <= bound).mean() > 0.93 and abs((estimate - x @ q).mean()) < 0.1
    # By popcounts: the same, but for the rounding of the query to levels, and exactly that of the rounded query.
    packed = one_bit_codes.Estimator(bits, length, product, 64, 1.9)
    top = np.abs(turned).max()
    rounded = (np.clip(np.floor((turned / top + 1) / 2 * 16), 0, 15) + 0.5) / 16 * 2 * top - top
    got = packed.estimate(turned[None, :])[0]
    assert np.allclose(got, signs @ rounded * length / (product * 8), atol=1e-3) and np.abs(got - estimate).std() < 0.3 * np.abs(estimate - x @ q).std()
    assert np.allclose(packed.spread * np.linalg.norm(q), bound, rtol=1e-5)


def test_codes_of_odd_widths():
    rng = np.random.default_rng(3)
    for dim in (1, 7, 65, 130):
        x, q = rng.standard_normal((50, dim)), rng.standard_normal((2, dim))
        bits, length, product = one_bit_codes.encode(x, 7)
        signs = np.unpackbits(bits, axis=1, count=dim).astype(float) * 2 - 1
        turned = q @ one_bit_codes.rotation(dim, 7)
        top = np.abs(turned).max(axis=1, keepdims=True)
        rounded = (np.clip(np.floor((turned / top + 1) / 2 * 16), 0, 15) + 0.5) / 16 * 2 * top - top
        assert np.allclose(one_bit_codes.Estimator(bits, length, product, dim, 1.0).estimate(turned), (rounded @ signs.T) * length / (product * np.sqrt(dim)), atol=1e-3)


def test_recall_on_a_whole_table(spark):
    """The query over sf0.1 against brute force."""
    from lodestrata.llm.queries import op8_one_bit_codes

    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got: dict = {}
    for r in op8_one_bit_codes(spark, folder).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & set(got[int(ids[i])])) / 20)
    assert len(hits) == len(got) and np.mean(hits) >= 0.95


def test_empty_tables(spark):
    random.seed(1)
    assert exact_topk.search(table(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    index = one_bit_codes.build_index(table(spark, []))
    assert one_bit_codes.search(index, index).count() == 0
