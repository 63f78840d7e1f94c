"""Exact top-k search by inner product, with a three-phase uniform threshold.

Components are integers (floor(scale * x)). The dimensions are split into ``lists`` slices; a candidate's score
is the sum of its local scores, one for each slice, as in a search over several sorted lists.

1. Every block gathers, for each query and slice, the k candidates of the best local scores, and sends the k
   best full scores among these. The k-th best that all blocks sent is a safe cutoff: k candidates reach it.
2. The cutoff goes back to the blocks, joined to the queries. A candidate whose local scores are all under
   cutoff / lists can't reach the cutoff, so entries that reach it in some slice are sufficient.
3. What such a candidate lacks in the other slices is resolved exactly, and the k best of the block go to the
   final merge. Ties go to smaller ids, so the result is unique.

Scores are exact: products are summed in a float type only while every possible sum is an integer it holds. Vectors so
long that a score might not fit a long are an error that says so.

A block computes its local scores in both phases; what the cutoff saves is what is resolved, sorted and sent.
See grid.py for what takes part, for repeated rows and for how the work is dealt.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.grid import Grid, best, lists, matrix, own_places, ranked, sound
from lodestrata.shipping import ship
from lodestrata.storage import materialise

CHUNK = 256  # queries whose scores a task holds at a time
LOW = -(2.0**62)


def _numbers(table, scale: int) -> np.ndarray:
    return np.floor(scale * matrix(table))


def _type(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which all sums of products of the two matrices' rows are exact."""
    bound = np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0)  # no score, nor any part of one, is larger
    if bound >= 2.0**62:
        raise OverflowError("scores do not fit a long")
    return np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64


def _local(q: np.ndarray, c: np.ndarray, own: tuple[np.ndarray, np.ndarray], parts: list[slice]) -> list[np.ndarray]:
    """Local scores of all candidates in each slice; a query's own rows are far below all."""
    scores = [q[:, p] @ c[:, p].T for p in parts]
    for s in scores:
        if s.dtype == np.float32:
            s[own] = -np.inf
        else:
            s[own] = LOW / len(parts)
    return scores


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, slices: int = 2, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row for which ``is_query`` (a condition) holds."""
    ship(vectors.sparkSession)
    taking = vectors.where(sound(vector)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    candidates = taking.where("id is not null").select("id", "vector")
    queries = taking.where("asks and id is not null").select("id", "vector").distinct().withColumn("query", F.xxhash64("id", "vector"))
    grid = Grid(candidates, queries)

    def chunks(asked, table):
        q, c, ids, names = _numbers(asked, scale), _numbers(table, scale), table.column("id").to_numpy(), asked.column("id").to_numpy()
        kind, cuts = _type(q, c), np.linspace(0, q.shape[1], min(slices, max(1, q.shape[1])) + 1).astype(int)
        q, c = q.astype(kind), c.astype(kind)
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows, places = own_places(names, ids)
        for at in range(0, len(q), CHUNK):
            mine = (rows >= at) & (rows < at + CHUNK)
            yield at, ids, _local(q[at : at + CHUNK], c, (rows[mine] - at, places[mine]), parts)

    def gather(asked, table):
        rows, scores = [], []
        for at, ids, local in chunks(asked, table):
            n = min(k, len(ids))
            near = np.hstack([np.argpartition(s, len(ids) - n, axis=1)[:, len(ids) - n :] for s in local])
            near.sort(axis=1)
            full = sum(np.take_along_axis(s, near, axis=1).astype(np.float64) for s in local)
            full[:, 1:][near[:, 1:] == near[:, :-1]] = -np.inf  # found in several slices: counts once
            row, place = np.nonzero(full > LOW / 2)
            r, _, s = best(row, near[row, place], full[row, place], k)
            rows.append(r + at)
            scores.append(s)
        return [asked.column("query").combine_chunks(), *lists(np.concatenate(rows), asked.num_rows, np.concatenate(scores).astype(np.int64))]

    gathered = grid.run(gather, "query long, scores array<long>")
    cutoff = F.get(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), F.lit(k - 1))
    cutoffs = materialise(gathered.groupBy("query").agg(cutoff.alias("cutoff")), "cutoffs")

    def resolve(asked, table):
        cut = asked.column("cutoff").to_numpy(zero_copy_only=False).astype(np.float64)
        cut = np.where(np.isnan(cut), LOW / 2, cut)  # fewer than k candidates: all are wanted
        rows, found, scores = [], [], []
        for at, ids, local in chunks(asked, table):
            least = cut[at : at + CHUNK, None]
            enough = np.zeros(local[0].shape, bool)
            for s in local:
                enough |= s >= least / len(local)
            row, place = np.nonzero(enough)
            full = sum(s[row, place].astype(np.int64 if s.dtype == np.int64 else np.float64) for s in local)
            keep = full >= least[row, 0]
            r, i, s = best(row[keep], ids[place[keep]], full[keep], k)
            rows.append(r + at)
            found.append(i)
            scores.append(s)
        return [asked.column("query").combine_chunks(), asked.column("id").combine_chunks(), *lists(np.concatenate(rows), asked.num_rows, np.concatenate(found), np.concatenate(scores).astype(np.int64))]

    asked = grid.queries.join(cutoffs, "query", "left")
    return ranked(grid.run(resolve, "query long, query_id long, ids array<long>, scores array<long>", asked), k, "long")
