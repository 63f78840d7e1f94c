"""Approximate nearest neighbours by inner product, with randomly rotated one-bit codes.

A vector, divided by its length, is turned by a random rotation; the index keeps the signs of its components
(one packed bit each) and two scalars: its length, and the inner product of the turned vector with its code
(the corner of a cube that the signs name, scaled to length 1). For a query q the product of code and turned q,
divided by the second scalar, estimates the inner product without bias, and its error stays under
``width * |q| * sqrt((1 - s*s) / (s*s)) / sqrt(d - 1)`` but for a small share of cases.

The query side: its turned components are rounded to ``LEVELS`` evenly spaced levels, whose binary digits are packed
into as many words as a code has. The product of a code with them is a sum of popcounts of ANDed words, one for each
digit, so codes are never unpacked.

A query scans the codes of a block. Its ``FIRST`` * k best estimates are scored exactly, and the k-th best of these is a
cutoff; every vector whose estimate plus error bound reaches it is scored exactly as well, in double precision on
the original vectors. The blocks' k best are merged. The rotation depends on dimension and seed alone: nothing is
learned from the data, and every vector is indexed. Original vectors travel with their codes, in the type they have: at
64 dimensions a query's rescored vectors are some 4% of a block, and to fetch so many for each query would send more.

Zero vectors take no part; see grid.py for the rest and for how the work is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.grid import Grid, best, lists, matrix, own_places, ranked, sound
from lodestrata.shipping import ship

WIDTH, FIRST, DIGITS = 1.5, 4, 4
LEVELS, BATCH = 1 << DIGITS, 1 << 15
CHUNK = 16  # queries whose estimates of a block are held at a time, so that they stay in cache


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length, product with the code) of each row."""
    dim = x.shape[1]
    top = np.abs(x).max(axis=1)
    length = top * np.linalg.norm(x / top[:, None], axis=1)
    turned = (x / length[:, None]) @ rotation(dim, seed)
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def build_index(vectors: DataFrame, seed: int = 7, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector, code, length, product for every sound vector that isn't zero."""
    import pyarrow as pa

    ship(vectors.sparkSession)
    taking = vectors.where(sound(vector) & F.exists(vector, lambda x: x != 0)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            code, length, product = [None] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = batch.column("vector").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                bits, length[own], product[own] = encode(x, seed)
                for i, b in zip(own, bits, strict=True):
                    code[i] = b.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(code, pa.binary()), pa.array(length), pa.array(product)], ["id", "vector", "code", "length", "product"])

    kind = taking.schema["vector"].dataType.simpleString()
    return taking.mapInArrow(run, f"id long, vector {kind}, code binary, length double, product double")


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bits as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return padded.view(np.uint64)


class Estimator:
    """Estimates and error bounds of inner products with the vectors of a block."""

    def __init__(self, codes: np.ndarray, length: np.ndarray, product: np.ndarray, dim: int, width: float) -> None:
        self.words, self.dim = np.ascontiguousarray(_words(codes).T), dim
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.float32)
        product = np.minimum(product, 1)
        self.scale = (length / (product * np.sqrt(dim))).astype(np.float32)
        self.spread = (length * np.sqrt(1 - product**2) / product * width / np.sqrt(max(1, dim - 1))).astype(np.float32)

    def estimate(self, turned: np.ndarray) -> np.ndarray:
        """Of each query's turned components with each vector."""
        top = np.abs(turned).max(axis=1, keepdims=True)
        top[top == 0] = 1.0
        level = np.clip(np.floor((turned / top + 1) / 2 * LEVELS), 0, LEVELS - 1).astype(np.int64)
        step = 2 * top / LEVELS  # a level stands for step * (level + 1/2) - top
        sums = np.zeros((len(turned), self.words.shape[1]), np.uint32)
        for digit in range(DIGITS):
            planes = _words(np.packbits(level >> digit & 1, axis=1).astype(np.uint8))
            for w, codes in enumerate(self.words):
                sums += np.bitwise_count(codes & planes[:, w, None]).astype(np.uint32) << np.uint32(digit)
        low, whole = (step / 2 - top).astype(np.float32), (step * (level + 0.5) - top).sum(axis=1, keepdims=True).astype(np.float32)
        return (2 * (step.astype(np.float32) * sums + low * self.ones) - whole) * self.scale


def search(index: DataFrame, queries: DataFrame, k: int = 20, width: float = WIDTH, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (id, vector) in an index made with ``seed``."""
    ship(index.sparkSession)
    asked = queries.select("id", F.col("vector").cast(index.schema["vector"].dataType).alias("vector")).distinct().withColumn("query", F.xxhash64("id", "vector"))
    grid = Grid(index, asked)

    def meet(left, right):
        q, x = matrix(left), matrix(right)
        dim = x.shape[1]
        ids, names = right.column("id").to_numpy(), left.column("id").to_numpy()
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        block = Estimator(codes, right.column("length").to_numpy(), right.column("product").to_numpy(), dim, width)
        turned, reach = q @ rotation(dim, seed), np.linalg.norm(q, axis=1).astype(np.float32)
        mine, places = own_places(names, ids)
        n, found = min(FIRST * k, len(ids)), []
        for at in range(0, len(q), CHUNK):
            estimate = block.estimate(turned[at : at + CHUNK])
            own = (mine >= at) & (mine < at + CHUNK)
            estimate[mine[own] - at, places[own]] = -np.inf
            first = np.argpartition(estimate, len(ids) - n, axis=1)[:, len(ids) - n :]
            sure = np.einsum("qnd,qd->qn", x[first], q[at : at + CHUNK])
            sure[np.isneginf(np.take_along_axis(estimate, first, axis=1))] = -np.inf
            cutoff = np.sort(sure, axis=1)[:, -min(k, n)] if n >= k else np.full(len(sure), -np.inf)
            reaches = (estimate + block.spread * reach[at : at + CHUNK, None] >= cutoff[:, None]) & np.isfinite(estimate)
            np.put_along_axis(reaches, first, np.isfinite(sure), axis=1)
            row, place = np.nonzero(reaches)
            exact = np.concatenate([(x[place[a : a + BATCH]] * q[at + row[a : a + BATCH]]).sum(axis=1) for a in range(0, len(row), BATCH)] or [np.empty(0)])
            row, i, exact = best(row, ids[place], exact, k)
            found.append((row + at, i, exact))
        rows, i, s = (np.concatenate(parts) for parts in zip(*found, strict=True))
        return [left.column("query").combine_chunks(), left.column("id").combine_chunks(), *lists(rows, left.num_rows, i.astype(np.int64), s.astype(np.float64))]

    return ranked(grid.run(meet, "query long, query_id long, ids array<long>, scores array<double>"), k, "double")
