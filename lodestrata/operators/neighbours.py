"""Neighbours: vector top-k, banded and timed pairs, components, groups, nearest places and times."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import geo, vectors
from lodestrata.operators import gaps
from lodestrata.operators.shapes import kept_points
from lodestrata.shipping import ship
from lodestrata.storage import materialise


def top_k(rows: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "vec_id") -> DataFrame:
    """The rows most like a query vector, ties to smaller keys: scored by expressions, kept by partition, merged."""
    if not 1 <= k <= 200:
        raise ValueError("k from 1 to 200")
    score = vectors.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def top_k_by_group(scored: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k best scores of each group. Partial lists of each partition's slice are cut before groups meet."""
    part = Window.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(32))).orderBy(F.desc("score"), key)
    cut = scored.withColumn("__at", F.row_number().over(part)).where(F.col("__at") <= k).drop("__at")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


#: Rows and asked rows of a block: their products are 16 million numbers at most.
BLOCK_ROWS, BLOCK_ASKED = 16_384, 1024
#: Rows of a group that stay together.
GROUP_ROWS = 4096


def best_matches(asked: DataFrame, rows: DataFrame, k: int = 2, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(key, o, score, rank): the k most like of all rows for each asked row, itself left out, ties to the smaller key.

    Both sides are dealt into blocks of bounded size; a task multiplies one block of each and gives k rows for each asked one.
    """
    ship(rows.sparkSession)
    parts, lots = -(-max(1, rows.count()) // BLOCK_ROWS), -(-max(1, asked.count()) // BLOCK_ASKED)
    deal = lambda n: F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(key, vector).withColumn("part", deal(parts)).withColumn("lot", every(lots))
    wanted = asked.select(key, vector).withColumn("lot", deal(lots)).withColumn("part", every(parts))
    wanted = wanted.select(*[F.col(c).alias(c) for c in wanted.columns])  # the sides may stem from one table

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"asked": [], "o": [], "score": []})
        ids = right[key].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], np.stack(left[vector]) @ np.stack(right[vector])[order].T
        scores[left[key].to_numpy()[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = pd.DataFrame({"asked": np.repeat(left[key].to_numpy(), best.shape[1]), "o": ids[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})
        return found[found["score"] > -np.inf]

    kind = rows.schema[key].dataType.simpleString()
    met = wanted.groupBy("part", "lot").cogroup(held.groupBy("part", "lot")).applyInPandas(meet, f"asked {kind}, o {kind}, score double")
    return top_k_by_group(met, "asked", "o", k).withColumnRenamed("asked", key)


def best_groups(asked: DataFrame, members: DataFrame, group: str, key: str = "face_id", vector: str = "vector") -> DataFrame:
    """(key, group, first, second, rank): for each asked row the two groups with the most like member, with the scores of their two
    most like ones (second is null for groups of one); ties to the smaller group.

    Groups are dealt into blocks whole, those of over ``GROUP_ROWS`` in chunks; asked rows too. A task gives two groups for each
    asked row, and every chunk's two scores, of which a group's two best are the best of all its chunks'.
    """
    ship(members.sparkSession)
    parts, lots = -(-max(1, members.count()) // BLOCK_ROWS), -(-max(1, asked.count()) // BLOCK_ASKED)
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = members.select(F.col(group).alias("g"), F.col(vector).alias("v"))
    large = materialise(named.groupBy(F.col("g").alias("l_g")).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("chunks")).where("chunks > 1"), "large")
    chunk = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("chunks")).cast("int"), F.lit(-1))
    held = named.join(F.broadcast(large), F.col("g").eqNullSafe(F.col("l_g")), "left").select("g", "v", chunk.alias("chunk"))  # a group for each GROUP_ROWS rows at most
    held = held.withColumn("part", deal(parts, "g", "chunk")).withColumn("lot", every(lots))
    wanted = asked.select(F.col(key).alias("a"), F.col(vector).alias("u")).withColumn("lot", deal(lots, "a", F.monotonically_increasing_id())).withColumn("part", every(parts))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "g": [], "first": [], "second": []})
        right = right.sort_values(["g", "chunk"], kind="stable")
        chunk = right["chunk"].to_numpy()
        starts = np.flatnonzero(np.append(True, (right["g"].to_numpy()[1:] != right["g"].to_numpy()[:-1]) | (chunk[1:] != chunk[:-1])))
        names, whole = right["g"].to_numpy()[starts], np.flatnonzero(chunk[starts] < 0)
        scores = np.stack(left["u"]) @ np.stack(right["v"]).T
        first = np.maximum.reduceat(scores, starts, axis=1)
        of = np.repeat(np.arange(len(names)), np.diff(np.append(starts, len(right))))
        top = scores == first[:, of]  # of several equal ones one is the first, another the second
        several = np.add.reduceat(top, starts, axis=1) > 1
        second = np.where(several, first, np.maximum.reduceat(np.where(top, -np.inf, scores), starts, axis=1))
        best = whole[np.argsort(-first[:, whole], axis=1, kind="stable")[:, :2]]
        best = np.concatenate([best, np.broadcast_to(np.flatnonzero(chunk[starts] >= 0), (len(left), len(names) - len(whole)))], axis=1)
        at = lambda x: np.take_along_axis(x, best, 1).ravel()
        seconds = [None if x == -np.inf else x for x in at(second).tolist()]
        return pd.DataFrame({"a": np.repeat(left["a"].to_numpy(), best.shape[1]), "g": names[best].ravel(), "first": at(first), "second": pd.Series(seconds, dtype=object)})

    kind, name = asked.schema[key].dataType.simpleString(), members.schema[group].dataType.simpleString()
    met = wanted.groupBy("part", "lot").cogroup(held.groupBy("part", "lot")).applyInPandas(meet, f"a {kind}, g {name}, first double, second double")
    scores = F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array("first", "second")))), asc=False)
    met = met.groupBy("a", "g").agg(scores.alias("best")).select("a", "g", F.get("best", F.lit(0)).alias("first"), F.get("best", F.lit(1)).alias("second"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("first"), "g"))
    return met.withColumn("rank", rank).where("rank <= 2").select(F.col("a").alias(key), F.col("g").alias(group), "first", "second", "rank")


#: Rows of one key that a task compares at once; what holds more is dealt into pairs of chunks. Rows of a task that has small keys only.
KEY_ROWS, TASK_ROWS = 32_768, 32_768
#: Rows that a task holds before it compares them, rows of a key up to which comparison goes by offsets, cells of a block beyond.
HELD_ROWS, FEW_ROWS, BLOCK_CELLS = 1 << 18, 32, 1 << 16


def _choices(distance: int, rows: int, crowd: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """(the mask of each band, the sets of bands that are keys) for hashes at most ``distance`` bits apart.

    Of distance + m bands such hashes agree on m at least. m is the least, up to 3, whose keys part the rows into nodes of
    about ``crowd``; one band of a hash makes a key of some 9 bits at six bits' distance, two one of 16, three one of 21.
    """
    for m in (1, 2, 3):
        if m == 3 or rows <= crowd << (64 * m // (distance + m)):
            cuts = np.linspace(0, 64, distance + m + 1).astype(int).tolist()
            return [sum(1 << b for b in range(a, z)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], list(combinations(range(distance + m), m))
    raise AssertionError


def _near_rows(h: np.ndarray, key: np.ndarray, side: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places (i, j), i before j, of hashes of one key (equal ones lie together) within some bits; ``side`` is 0, or two rows of one side don't count."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(h)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(h))  # rows from here to the key's end
    i = np.flatnonzero((left > 1) & np.repeat(sizes <= FEW_ROWS, sizes))
    for off in range(1, FEW_ROWS):
        i = i[left[i] > off]
        if not len(i):
            break
        near = i[np.bitwise_count(h[i] ^ h[i + off]) <= distance]
        near = near[(side[near] == 0) | (side[near] != side[near + off])]
        yield near, near + off
    for start, n in zip(starts[sizes > FEW_ROWS].tolist(), sizes[sizes > FEW_ROWS].tolist(), strict=True):
        step = max(1, BLOCK_CELLS // n)
        for at in range(start, start + n, step):
            to = min(at + step, start + n)
            hits = np.flatnonzero(np.bitwise_count(h[at:to, None] ^ h[None, at : start + n]) <= distance)
            i, j = np.divmod(hits, start + n - at)
            i, j = i + at, j + at
            sound = (i < j) & ((side[i] == 0) | (side[i] != side[j]))
            yield i[sound], j[sound]


def _linked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Adds links between places i and j to ``root``, in which each place has the smallest place that it can reach."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _met_near(rows: DataFrame, distance: int, key: str, hi: str, lo: str, by: str | None, crowd: int, forest: bool) -> DataFrame:
    """(a, b, distance), a smaller than b, of ``banded_pairs`` or, as a ``forest``, of links that connect the same rows."""
    if not 0 <= distance <= 16:
        raise ValueError("a distance from 0 to 16")
    ship(rows.sparkSession)
    own = F.lit(0) if by is None else F.col(by)
    hashed = materialise(rows.select(F.col(key).alias("h_key"), own.alias("h_by"), F.col(hi).alias("h_hi"), F.col(lo).alias("h_lo")), "hashed")  # whatever made the hashes runs once
    kinds = materialise(hashed.where("h_hi is not null and h_lo is not null").groupBy(F.col("h_by").alias("k_by"), F.col("h_hi").alias("k_hi"), F.col("h_lo").alias("k_lo")).agg(F.min("h_key").alias("rep")), "hashes")
    total = kinds.count()
    masks, chosen = _choices(distance, total, crowd)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    wanted = [sum(masks[i] for i in s) for s in chosen]

    # A node is the rows of one ``by`` that agree on a set's bands. Nodes of a set are dealt to lots by a hash, and a lot of too many rows into pairs of chunks.
    lots = total // (KEY_ROWS // 8) + 1
    h = F.shiftleft("k_hi", 32).bitwiseOR(F.col("k_lo"))
    spread = kinds.select("k_by", "rep", h.alias("h"), F.posexplode(F.array(*[F.lit(signed(w)).cast("long") for w in wanted])).alias("s", "mask"))
    spread = spread.select("k_by", "rep", "h", (F.pmod(F.xxhash64("k_by", "s", F.col("h").bitwiseAND(F.col("mask"))), F.lit(lots)) * len(chosen) + F.col("s")).alias("lot"))
    large = materialise(spread.groupBy(F.col("lot").alias("l_lot")).agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("chunks")).where("chunks > 1"), "lots")
    dealt = spread.join(F.broadcast(large), F.col("lot") == F.col("l_lot"), "left")  # a lot for each KEY_ROWS rows at most
    chunk = F.pmod(F.xxhash64("h", "k_by"), F.col("chunks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(chunk, o).alias("low"), F.greatest(chunk, o).alias("high"), F.when(chunk == o, 0).when(chunk < o, 1).otherwise(2).alias("side")))
    none = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side")))
    dealt = dealt.select("lot", F.explode(F.coalesce(parts, none)).alias("p"), "k_by", "h", "rep").select("lot", "p.low", "p.high", "p.side", "k_by", "h", "rep")
    unit = ["lot", "low", "high"]
    dealt = dealt.repartition(total * len(chosen) // TASK_ROWS + 1, *unit).sortWithinPartitions(*unit)

    def compared(held: pa.Table) -> Iterator[pa.RecordBatch]:
        values = {c: held[c].to_numpy() for c in (*unit, "side", "h")}
        s, h, n = values["lot"] % len(chosen), values["h"].astype(np.int64).view(np.uint64), len(held)
        told = h & np.array(wanted, np.uint64)[s]
        own = held["k_by"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        columns = [told, own, values["high"], values["low"], values["lot"]]
        order = np.lexsort(columns)
        differs = np.zeros(n, bool)
        for c in columns:
            differs[1:] |= c[order][1:] != c[order][:-1]
        s, h, side, reps = s[order], h[order], values["side"][order], held["rep"].combine_chunks()
        sets, root = np.array([sum(1 << i for i in x) for x in chosen]), np.arange(n)
        upto = np.array([(2 << max(x)) - 1 for x in chosen])
        batch = lambda i, j, far: pa.RecordBatch.from_arrays([reps.take(pa.array(order[i])), reps.take(pa.array(order[j])), pa.array(far.astype(np.int32))], ["a", "b", "distance"])
        links, waiting = [], 0
        for i, j in _near_rows(h, np.cumsum(differs), side, distance):
            if forest:  # what is connected already needs no link
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
            x = h[i] ^ h[j]
            agree = np.zeros(len(x), np.int64)
            for at, mask in enumerate(masks):
                agree |= ((x & np.uint64(mask)) == 0).astype(np.int64) << at
            first = (agree & upto[s[i]]) == sets[s[i]]  # a pair comes from one node only, that of the first bands on which it agrees
            i, j, x = i[first], j[first], x[first]
            if not forest and len(i):
                yield batch(i, j, np.bitwise_count(x))
            elif len(i):
                links.append((i, j))
                waiting += len(i)
                if waiting >= BLOCK_CELLS:
                    _linked(root, *map(np.concatenate, zip(*links, strict=True)))
                    links, waiting = [], 0
        if links:
            _linked(root, *map(np.concatenate, zip(*links, strict=True)))
        far = np.flatnonzero(root != np.arange(n))
        if len(far):
            yield batch(root[far], far, np.zeros(len(far)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < HELD_ROWS:
                continue
            every = pa.Table.from_batches(held)
            before = np.logical_or.reduce([every[c].to_numpy() != every[c][-1].as_py() for c in unit])  # rows of the last unit may go on
            whole = int(np.count_nonzero(before))
            if whole:
                yield from compared(every.slice(0, whole))
                held = every.slice(whole).to_batches()
                rows -= whole
        if rows:
            yield from compared(pa.Table.from_batches(held))

    kind = rows.schema[key].dataType.simpleString()
    near = dealt.mapInArrow(run, f"a {kind}, b {kind}, distance int").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    copies = hashed.join(kinds.hint("merge"), (F.col("h_hi") == F.col("k_hi")) & (F.col("h_lo") == F.col("k_lo")) & F.col("h_by").eqNullSafe(F.col("k_by"))).where(F.col("h_key") != F.col("rep"))
    return near.unionByName(copies.select(F.col("rep").alias("a"), F.col("h_key").alias("b"), F.lit(0).alias("distance")))


def banded_pairs(rows: DataFrame, distance: int, key: str, hi: str = "hi", lo: str = "lo", by: str | None = None, crowd: int = 1024) -> DataFrame:
    """(a, b, distance) of rows whose 64-bit hashes (halves of 32 bits) differ in at most ``distance`` bits, none left out.

    ``by``: a column that must be equal too, null like null. Pairs are formed between different hashes only, and copies of
    a hash are joined to the smallest key among them at distance 0, so a large group of copies gives a row a copy and not
    all its pairs. A pair comes from one node only, that of the first bands on which it agrees. Nodes are compared in
    blocks within tasks, so what isn't near is never a row, and nothing is broadcast but the numbers of very large lots.
    """
    return _met_near(rows, distance, key, hi, lo, by, crowd, forest=False)


def banded_links(rows: DataFrame, distance: int, key: str, hi: str = "hi", lo: str = "lo", by: str | None = None, crowd: int = 1024) -> DataFrame:
    """(a, b): links that connect what ``banded_pairs`` connects. A task gives a forest of what it compares at once, so it gives
    no more links than it has rows, however many of them are near."""
    return _met_near(rows, distance, key, hi, lo, by, crowd, forest=True).select("a", "b")


def burst_pairs(rows: DataFrame, seconds: int, key: str, at: str = "at", day: str = "day") -> DataFrame:
    """(a, b, gap) of all rows of one day within some seconds of each other, a being the earlier (of equals the smaller key).

    Both sides are dealt to time buckets as wide as the window, the later one to its own and the one before, so the join
    is on equal keys and no day is one task.
    """
    bucket = F.floor(F.col(at) / seconds)
    dated = rows.where(F.col(day).isNotNull() & F.col(at).isNotNull())
    left = dated.select(key, day, at, bucket.alias("b"))
    right = dated.select(F.col(key).alias("o_key"), F.col(day).alias("o_day"), F.col(at).alias("o_at"), F.explode(F.array(bucket - 1, bucket)).alias("o_b"))
    met = left.join(right, (F.col(day) == F.col("o_day")) & (F.col("b") == F.col("o_b")) & (F.struct(at, key) < F.struct("o_at", "o_key")))
    return met.select(F.col(key).alias("a"), F.col("o_key").alias("b"), (F.col("o_at") - F.col(at)).alias("gap")).where(F.col("gap") <= seconds)


def groups_of(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(member, group): for every key of some pair (a, b) the smallest key it can reach, by pointer jumping over stored rounds.

    Labels are stored compactly, so their size on disk says little of how many there are; they are never broadcast.
    """
    edges = materialise(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialise(edges.groupBy(F.col("a").alias("member")).agg(F.least(F.min("b"), F.col("member")).alias("group")), "labels")
    for _ in range(rounds):
        near = edges.join(label.select(F.col("member").alias("b"), F.col("group").alias("g")).hint("merge"), "b").groupBy(F.col("a").alias("n")).agg(F.min("g").alias("g"))
        step = label.join(near.hint("merge"), F.col("member") == F.col("n")).select("member", F.least("group", "g").alias("group"))
        up = step.select(F.col("member").alias("m2"), F.col("group").alias("g2"))
        jumped = materialise(step.join(up.hint("merge"), F.col("group") == F.col("m2"), "left").select("member", F.least("group", F.coalesce("g2", "group")).alias("group")), "labels")
        moved = jumped.join(label.withColumnRenamed("group", "was").hint("merge"), "member").where(F.col("group") != F.col("was")).isEmpty()
        label = jumped
        if moved:
            return label
    raise RuntimeError("groups have not settled")


#: Sides of the cubes that settlements are dealt to; the last holds the whole sphere.
CUBES = (0.01, 0.04, 0.16, 0.64, 2.56)


#: Settlements that are sent to every task as one array; more of them are found by cubes.
FEW_TOWNS = 500


def _nearest_of_few(places: DataFrame, towns: DataFrame) -> DataFrame:
    px, py, pz = geo.unit_sphere(F.col("lat"), F.col("lon"))
    packed = towns.agg(F.collect_list(F.struct("s_id", "sx", "sy", "sz")).alias("all"))
    asked = places.select("cell", px.alias("x"), py.alias("y"), pz.alias("z")).distinct().withColumn("towns", packed.scalar())
    away = F.transform("towns", lambda t: F.struct((-(F.col("x") * t["sx"] + F.col("y") * t["sy"] + F.col("z") * t["sz"])).alias("away"), t["s_id"].alias("s_id")))
    best = asked.select("cell", F.array_min(away).alias("best")).where("best is not null").groupBy("cell").agg(F.min("best").alias("best"))
    return best.select("cell", F.col("best.s_id").alias("s_id"), (F.lit(geo.EARTH_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("best.away"))))).alias("km"))


def nearest_place(places: DataFrame, settlements: DataFrame) -> DataFrame:
    """Each place (cell, lat, lon) with its nearest settlement (s_id, s_lat, s_lon) on the unit sphere, ties to the smaller id.

    Points of the sphere are dealt to cubes, so poles and the date line are nothing special. What lies within a cube's side
    of a place is in its own or one of the 26 cubes around; places that find nothing so near go on to larger cubes.
    """
    x, y, z = geo.unit_sphere(F.col("s_lat"), F.col("s_lon"))
    if settlements.count() <= FEW_TOWNS:
        return _nearest_of_few(places, settlements.select("s_id", x.alias("sx"), y.alias("sy"), z.alias("sz")))
    towns = materialise(settlements.select("s_id", x.alias("sx"), y.alias("sy"), z.alias("sz")), "settlements")
    px, py, pz = geo.unit_sphere(F.col("lat"), F.col("lon"))
    left = materialise(places.select("cell", px.alias("x"), py.alias("y"), pz.alias("z")).distinct(), "places")
    found = []
    for side in CUBES:
        at = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        around = left
        for c in "xyz":
            around = around.withColumn(f"c{c}", F.explode(F.array(at(c) - 1, at(c), at(c) + 1)))
        dealt = towns.select("*", at("sx").alias("tx"), at("sy").alias("ty"), at("sz").alias("tz"))
        met = around.join(dealt, (F.col("cx") == F.col("tx")) & (F.col("cy") == F.col("ty")) & (F.col("cz") == F.col("tz")))
        dot = F.col("x") * F.col("sx") + F.col("y") * F.col("sy") + F.col("z") * F.col("sz")
        best = met.groupBy("cell").agg(F.min(F.struct((-dot).alias("away"), F.col("s_id").alias("s_id"))).alias("best"))
        near = materialise(best.where((2 + 2 * F.col("best.away") <= side * side) | F.lit(side == CUBES[-1])), "near")
        found.append(near)
        left = left.join(near.select(F.col("cell").alias("__got")), F.col("cell") == F.col("__got"), "left_anti")
    every = reduce(DataFrame.unionByName, found)
    km = F.lit(geo.EARTH_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("best.away"))))
    return every.select("cell", F.col("best.s_id").alias("s_id"), km.alias("km"))


def nearest_in_day(rows: DataFrame, peers: DataFrame, seconds: int) -> DataFrame:
    """(id, p_id, gap): each row (id, day, at) with the peer (p_id, p_day, p_at) of its day nearest in time, ties to the smaller, at most some seconds off.

    Of a moment's peers one is kept, and neighbours in time are found within ranges and then between them, so no pairs are
    formed and no day is one task.
    """
    known = peers.groupBy(F.col("p_day").alias("day"), F.col("p_at").alias("at")).agg(F.min("p_id").alias("p_id"))
    asked = rows.select("day", "at").distinct().withColumn("p_id", F.lit(None).cast(peers.schema["p_id"].dataType))
    points = known.unionByName(asked).where("day is not null and at is not null").groupBy("day", "at").agg(F.min("p_id").alias("p_id"))
    near = gaps.nearest_known(points, ["day"], "at", "p_id", 600)
    side = lambda c, gap: F.when(F.col(c).isNotNull(), F.struct(gap.alias("gap"), F.col(f"{c}.value").alias("p_id")))
    best = F.least(side("below", F.col("at") - F.col("below.at")), side("above", F.col("above.at") - F.col("at")))
    found = near.select(F.col("day").alias("n_day"), F.col("at").alias("n_at"), best.alias("best"))
    met = rows.select("id", "day", "at").join(found, (F.col("day") == F.col("n_day")) & (F.col("at") == F.col("n_at")))
    return met.where(F.col("best.gap") <= seconds).select("id", "best.p_id", "best.gap")


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1."""
    x = np.array(vectors.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block_groups(rows: DataFrame, block: str, assign, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.groupBy(block).applyInPandas(assign, schema)


#: Faces of a chunk; two chunks are compared in a task.
CHUNK_FACES = 4096


def alike_components(faces: DataFrame, block: str, least: float) -> DataFrame:
    """(face_id, component): what chains of faces of one block, each like the next by ``least`` or more, connect; the smallest id names it.

    Every two chunks of a block are one task, which multiplies stripes of them and gives a forest of what is alike in them, so
    no pairs of faces leave it, however many are alike.
    """
    ship(faces.sparkSession)
    rows = materialise(faces.select("face_id", F.col(block).alias("block"), "vector"), "faces")
    chunks = rows.groupBy(F.col("block").alias("c_block")).agg(F.ceil(F.count("*") / CHUNK_FACES).cast("int").alias("chunks"))
    dealt = rows.join(chunks, F.col("block").eqNullSafe(F.col("c_block"))).withColumn("own", F.pmod(F.xxhash64("face_id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunks = 1 or own <> other")  # a chunk's own pairs are in every task with it
    dealt = dealt.select("face_id", "vector", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def connect(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("face_id")
        ids, x = frame["face_id"].to_numpy(), _unit(frame["vector"])
        root = np.arange(len(ids))
        for at in range(0, len(ids), 256):
            i, j = np.nonzero(x[at : at + 256] @ x.T >= least)
            i += at
            apart = root[i] != root[j]
            _linked(root, i[apart], j[apart])
        far = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[root[far]], "b": ids[far]})

    kind = rows.schema["face_id"].dataType.simpleString()
    links = dealt.groupBy("block", "low", "high").applyInPandas(connect, f"a {kind}, b {kind}")
    found = groups_of(links)
    return rows.select("face_id").join(found, F.col("face_id") == F.col("member"), "left").select("face_id", F.coalesce("group", "face_id").alias("component"))


def complete_links(x: np.ndarray, content: np.ndarray, anchor: float, every: float, margin: float) -> list[list[int]]:
    """Groups of places of ``x``, as ``anchored_groups`` states them. First members are compared with many faces at once, and a face
    looks into groups from the likest first member on, until two of them fit."""
    groups: list[list[int]] = []
    firsts = np.empty(len(x), int)
    for start in range(0, len(x), 128):
        block, known = x[start : start + 128], len(groups)
        older, own = block @ x[firsts[:known]].T, block @ block.T
        for i in range(start, start + len(block)):
            scores = np.concatenate([older[i - start], own[i - start, firsts[known : len(groups)] - start]])
            near = np.flatnonzero(scores >= anchor - 1e-9)  # a hair lower, as sums may differ in their last digits
            fits = []
            for g in near[np.argsort(-scores[near], kind="stable")].tolist():
                like = x[groups[g]] @ x[i]
                if like[0] >= anchor and like.min() >= every and content[i] not in content[groups[g]]:
                    fits.append((-like[0], g))
                    if len(fits) == 2:
                        break
            fits.sort()
            if fits and (len(fits) == 1 or -fits[0][0] + fits[1][0] >= margin):
                groups[fits[0][1]].append(i)
            else:
                firsts[len(groups)] = i
                groups.append([i])
    return groups


def anchored_groups(faces: DataFrame, block: str, anchor: float = 0.65, every: float = 0.55, margin: float = 0.08) -> DataFrame:
    """(face_id, group_id, model block) by complete links, in order of ids: a face joins a group if it is like its first
    member and like every member, none of it from the same content, and no other such group is nearly as like.

    A face meets groups only whose first member it is like, so what ``alike_components`` finds at the anchor's threshold is
    decided apart from all else, in the order of ids within it. The largest task is the largest such component.
    """

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("face_id")
        x, content, ids = _unit(frame["vector"]), frame["content"].to_numpy(), frame["face_id"].to_numpy()
        out = [(ids[i], ids[members[0]], frame["block"].iloc[0]) for members in complete_links(x, content, anchor, every, margin) for i in members]
        return pd.DataFrame(out, columns=["face_id", "group_id", "block"])

    parts = alike_components(faces, block, anchor - 1e-4)  # a hair lower, as sums may differ in their last digits
    met = faces.select("face_id", "vector", "content", F.col(block).alias("block")).join(parts.withColumnRenamed("face_id", "c_id"), F.col("face_id") == F.col("c_id")).drop("c_id")
    return met.groupBy("component").applyInPandas(assign, "face_id long, group_id long, block int")


def centroid_groups(faces: DataFrame, block: str, threshold: float = 0.52) -> DataFrame:
    """(face_id, group_id, block): faces in order of how like their best neighbour is join the nearest centroid at the
    threshold or above that holds no face of the same content; centroids are normalised running sums."""

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("face_id")
        x, content, ids = _unit(frame["vector"]), frame["content"].to_numpy(), frame["face_id"].to_numpy()
        best = np.full(len(ids), -1.0)
        for at in range(0, len(ids), 256):  # some rows of the similarities at a time
            like = x[at : at + 256] @ x.T
            like[np.arange(len(like)), np.arange(at, at + len(like))] = -1.0
            best[at : at + 256] = like.max(axis=1)
        sums: list[np.ndarray] = []
        members: list[list[int]] = []
        for i in np.lexsort((ids, -best)):
            options = [(-float(s @ x[i] / np.linalg.norm(s)), g) for g, s in enumerate(sums) if np.linalg.norm(s) > 0 and content[i] not in content[members[g]]]
            near = min(options, default=(2.0, -1))
            if -near[0] >= threshold:
                members[near[1]].append(i)
                sums[near[1]] = sums[near[1]] + x[i]
            else:
                members.append([i])
                sums.append(x[i].copy())
        out = [(ids[i], min(ids[m]), frame[block].iloc[0]) for m in members for i in m]
        return pd.DataFrame(out, columns=["face_id", "group_id", "block"])

    return _block_groups(faces, block, assign, "face_id long, group_id long, block int")


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, points): lines (id, points as arrays of x, y) without the points that lie within a tolerance of the rest (Douglas-Peucker)."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [kept_points(np.array([list(p) for p in points], float), tolerance) if len(points) > 2 else points for points in batch["points"]]
            yield pd.DataFrame({"id": batch["id"], "points": [[[round(float(v), 3) for v in p] for p in line] for line in kept]})

    return lines.mapInPandas(run, "id long, points array<array<double>>")
