"""A stated set of query vectors against all vectors, in blocks.

Vectors are dealt by hash into blocks of bounded size, queries likewise, and each pair of a query block and a
candidate block is one group: no task holds more than one of each, no side is broadcast, and a vector that
occurs often is spread like any other, as rows are dealt by their row number too. The number of blocks follows
the counted rows; blocks grow with the table up to ``MAX_ROWS``, so that fewer copies of each vector travel.

Vectors that are null or hold null, NaN or infinite components take no part; vectors of another length than a
query's are no candidates of it. A row with the query's id is never its candidate. Repeated candidate rows are
candidates each; a query row that repeats as a whole is asked once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS, MAX_ROWS, QUERY_ROWS = 2048, 32_768, 4096


def sound(vector: str) -> Column:
    """Whether all components are finite numbers."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


class Grid:
    """``candidates`` (id, vector, more) and ``queries`` (id, vector, more) by block; ``run`` meets them."""

    def __init__(self, candidates: DataFrame, queries: DataFrame) -> None:
        n = candidates.count()
        q = queries.count()
        self.blocks, self.query_blocks = max(1, -(-n // min(MAX_ROWS, max(MIN_ROWS, n // 64)))), max(1, -(-q // QUERY_ROWS))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(self.blocks)).cast("int")
        self.candidates = candidates.withColumns({"dim": F.size("vector"), "block": dealt}).withColumn("query_block", every(self.query_blocks))
        self.queries = queries.withColumns({"dim": F.size("vector"), "query_block": F.pmod(F.xxhash64("id"), F.lit(self.query_blocks)).cast("int")})

    def run(self, meet: Callable, schema: str, queries: DataFrame | None = None) -> DataFrame:
        """meet(queries, candidates), two Arrow tables, for each pair of blocks. ``queries``: self.queries with further columns."""
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(",")]

        def apply(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_arrays(meet(left, right), names) if left.num_rows and right.num_rows else empty(schema)

        every = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))
        keys = ["dim", "block", "query_block"]
        asked = (self.queries if queries is None else queries).withColumn("block", every)
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # the sides may stem from one table
        return asked.groupBy(*keys).cogroup(self.candidates.groupBy(*keys)).applyInArrow(apply, schema)


def empty(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


def matrix(table, name: str = "vector") -> np.ndarray:
    """Rows of an Arrow list column, as doubles."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def own_places(asked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places that have the same id."""
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[order], asked, "left"), np.searchsorted(ids[order], asked, "right")
    rows = np.repeat(np.arange(len(asked)), high - low)
    return rows, order[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)] or [[]]).astype(np.int64)]


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the k entries of the highest scores, ties to smaller ids; sorted."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[rank < k], ids[rank < k], scores[rank < k]


def lists(rows: np.ndarray, n: int, *values: np.ndarray) -> list:
    """Arrow list arrays with an entry for each of n rows; ``rows`` ascending."""
    import pyarrow as pa

    offsets = pa.array(np.searchsorted(rows, np.arange(n + 1), "left"), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def ranked(found: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score from the blocks' lists (query, query_id, ids, scores): a list of at most k for each block and query."""
    pairs = F.flatten(F.collect_list(F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("away"), i.alias("vec_id")))))
    top = found.groupBy("query", "query_id").agg(F.slice(F.sort_array(pairs), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "pair")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("pair.vec_id").alias("vec_id"), (-F.col("pair.away")).cast(kind).alias("score"))
