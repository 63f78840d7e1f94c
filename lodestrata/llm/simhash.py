"""SimHash near-duplicates over a Gray-ordered hierarchical index of fingerprints.

Fingerprints: A-Z lower-cased text, words between white space, shingles of ``words`` words with repeats, XXH64
with seed 42; a bit is 1 where it is set in over half of the shingles' hashes.

Search over distinct fingerprints, exact for every pair at ``distance`` or fewer bits:

* Upper nodes. The 64 bits are cut into distance + 1 masks. Two linked fingerprints agree on at least one whole
  mask, so each fingerprint goes to one upper node for each mask: that of its masked bit pattern. A node with
  more than ``NODE_LIMIT`` fingerprints is factored once more by distance + 1 masks of its free bits. What is
  then still larger is dealt into chunks, and each pair of chunks is searched as a node, so no task holds more
  than two chunks whatever the size of a group of copies.
* Below, a node's fingerprints are sorted by Gray rank, where neighbours differ in few bits. Runs of them become
  leaves, runs of leaves inner nodes; each keeps the bits that all below share (mask and pattern). A query goes
  down from the top, adding up where it differs from the shared bits; a group whose sum exceeds the distance is
  pruned with all below.
* A node returns a forest with its components (a link to a root for each fingerprint), never all its pairs: no
  link is lost, and a thousand near copies give a thousand rows. Components over all nodes follow by star rounds.

Nodes and components are of fingerprints, not of ids: an id that occurs with several texts is judged row by row.

Defined cases: null and empty texts and texts of white space have fingerprint zero and are linked like others;
repeated rows share a component; a null id stands for no component: such rows get the smallest id that others
of their component have, or null; an empty table gives no rows; extra columns are not read (``deduplicate``
passes all columns on, whatever their names). A node of hot fingerprints costs the square of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import url_filter
from lodestrata.llm.components import smallest_reachable
from lodestrata.shipping import ship
from lodestrata.storage import materialise

NODE_LIMIT = 8192
LEAF, FAN = 16, 8
PRUNES = 12  # beyond this distance shared bits rule out too little to be worth their levels
BROADCAST_ROWS = 20_000
SALTS = 16
PAIRS_AT_ONCE = 1 << 21
_HASH = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    said = (text or "").encode().lower().split()  # both touch ASCII only
    if not said:
        return 0
    n = max(1, len(said) - words + 1)
    shingles = zip(*(said[i:] for i in range(words)), strict=False) if len(said) >= words else [said]
    return majority(np.fromiter(map(_HASH, map(b" ".join, shingles)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes (one at least)."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        some = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each unsigned number in the Gray code's order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchical index over fingerprints that are sorted by Gray rank."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps, self.levels, size = fps, [], LEAF
        while True:
            starts = np.arange(0, len(fps), size)
            differing = np.bitwise_or.reduceat(fps ^ np.repeat(fps[starts], np.diff(np.append(starts, len(fps)))), starts)
            self.levels.append((fps[starts] & ~differing, ~differing))  # shared pattern, shared bits
            if len(starts) <= FAN:
                break
            size *= FAN

    def near(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all fingerprints within the distance of each query."""
        pattern, shared = self.levels[-1]
        asked, node = np.repeat(np.arange(len(queries)), len(pattern)), np.tile(np.arange(len(pattern)), len(queries))
        for level in reversed(range(len(self.levels))):
            pattern, shared = self.levels[level]
            keep = np.bitwise_count((queries[asked] ^ pattern[node]) & shared[node]) <= distance
            asked, node = asked[keep], node[keep]
            fan, limit = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, len(self.fps))
            asked, node = np.repeat(asked, fan), (node[:, None] * fan + np.arange(fan)).ravel()
            inside = node < limit
            asked, node = asked[inside], node[inside]
        hit = np.bitwise_count(queries[asked] ^ self.fps[node]) <= distance
        return asked[hit], node[hit]


def _join(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of the nodes a and b; every root is the smallest place of its tree."""
    while len(a):
        low, high = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(roots, high, low)
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots[:] = up


def _all_against_all(fps: np.ndarray, distance: int, roots: np.ndarray) -> None:
    """Joins the trees of all fingerprints within the distance, some rows at a time."""
    step = max(16, PAIRS_AT_ONCE // len(fps))
    for at in range(0, len(fps), step):
        a, b = np.nonzero(np.bitwise_count(fps[at : at + step, None] ^ fps[None, at:]) <= distance)
        later = b > a
        _join(roots, a[later] + at, b[later] + at)


def forest(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint (unsigned) the place of its component's root, by links within the distance."""
    order = np.argsort(gray_rank(fps), kind="stable")
    fps, roots = fps[order], np.arange(len(fps))
    if len(fps) <= 4 * LEAF or distance > PRUNES:
        _all_against_all(fps, distance, roots)
    else:
        index, step = GrayIndex(fps), max(16, PAIRS_AT_ONCE // len(fps))
        for at in range(0, len(fps), step):
            a, b = index.near(fps[at : at + step], distance)
            later = b > a + at
            _join(roots, a[later] + at, b[later])
    out = np.empty(len(fps), np.int64)
    out[order] = order[roots]
    return out


def _masks(bits: list[int], parts: int) -> list[int]:
    """The bits, dealt into masks of consecutive ones."""
    return [sum(1 << b for b in chunk.tolist()) for chunk in np.array_split(np.array(bits), parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(rows: DataFrame, masks: list[Column]) -> DataFrame:
    """Each row once for each mask; ``node`` becomes the hash of its node, the mask and the masked bits, ``used`` gets the mask."""
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), m.alias("mask")) for i, m in enumerate(masks)])).alias("m")
    spread = rows.select("fp", "node", "used", which)
    return spread.select("fp", F.xxhash64("node", "m.i", F.col("fp").bitwiseAND(F.col("m.mask"))).alias("node"), F.col("used").bitwiseOR(F.col("m.mask")).alias("used"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of nodes up to the limit; rows of larger ones with their node's size; whether there are any of these."""
    rows = materialise(rows, "nodes")
    large = materialise(rows.groupBy(F.col("node").alias("large")).agg(F.count("*").alias("size")).where(F.col("size") > NODE_LIMIT), "large")
    n = large.count()
    if not n:
        return rows, rows.limit(0).withColumn("size", F.lit(0).cast("long")), False
    side = F.broadcast(large) if n <= BROADCAST_ROWS else large
    met = rows.join(side, F.col("node") == F.col("large"), "left").drop("large")
    return met.where("size is null").drop("size"), met.where("size is not null"), True


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v) over the distinct fingerprints ``classes`` (fp): their components are those of all pairs within the distance."""
    import pyarrow as pa

    ship(classes.sparkSession)
    rows = classes.select("fp", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("used"))
    first = _masks(list(range(64)), distance + 1)
    small, large, more = _split(_nodes(rows, [F.lit(_signed(m)).cast("long") for m in first]))
    searched = [small.select("fp", "node")]
    if more:  # the masks that factor a node are those of the bits that its own mask leaves
        free = {m: _masks([b for b in range(64) if not m >> b & 1], distance + 1) for m in first}
        def of(i: int) -> Column:
            out = F.lit(None).cast("long")
            for m, parts in free.items():
                out = F.when(F.col("used") == _signed(m), F.lit(_signed(parts[i])).cast("long")).otherwise(out)
            return out
        small, large, more = _split(_nodes(large.drop("size"), [of(i) for i in range(distance + 1)]))
        searched.append(small.select("fp", "node"))
    if more:
        chunks = F.ceil(F.col("size") / NODE_LIMIT)
        own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks)
        dealt = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        searched.append(dealt.select("fp", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node")))
    every = searched[0]
    for x in searched[1:]:
        every = every.unionByName(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fp in whole_nodes(batches, ("node", "fp")):
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            cuts = np.flatnonzero(np.diff(node)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(node)), strict=True):
                if b - a > 1:
                    roots = forest(fp[a:b].view(np.uint64), distance)
                    far = np.flatnonzero(roots != np.arange(b - a))
                    us.append(fp[a:b][far])
                    vs.append(fp[a:b][roots[far]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return every.repartition("node").sortWithinPartitions("node").mapInArrow(run, "u long, v long")


def whole_nodes(batches: Iterator, columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows sorted by the first of them, a long, so that rows of one value are never parted."""
    kept: list[tuple[np.ndarray, ...]] = []  # rows of the value that the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in columns))
        if kept[0][0][0] == kept[-1][0][-1]:
            continue
        some = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        last = np.searchsorted(some[0], some[0][-1], "left")
        kept = [tuple(x[last:] for x in some)]
        yield tuple(x[:last] for x in some)
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _components(marked: DataFrame, distance: int) -> DataFrame:
    """(class_fp, component): each fingerprint with the fingerprint that names its component."""
    classes = materialise(marked.select("fp").distinct(), "classes")
    reached = smallest_reachable(links(classes, distance))
    return classes.join(reached, F.col("fp") == F.col("u"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("v", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest id that links of fingerprints reach, its own included."""
    marked = materialise(fingerprints(docs, words, id_column, text), "fingerprints")
    known = materialise(_components(marked, distance), "components")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(known, F.col("fp") == F.col("class_fp")).groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select("class_fp", "component_id")
    return marked.join(named, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, grouped: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row of each group, whole, that of the smallest id (then text hash); rows that ``grouped`` doesn't know stay.

    ``grouped`` (doc_id, h, component) has the rows' ids and ``text_hash`` of their texts, so rows of one id with
    different texts are told apart.
    """
    rows = grouped.groupBy("doc_id", "h", "component").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)))
    first = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("all")).where(F.col("all") > 1)
    first = first.select("component", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))  # a hot component's rows meet in several tasks
    stays = F.struct("doc_id", "h") == F.col("first")
    goes = materialise(rows.join(first, ["component", "salt"]).select(F.col("doc_id").alias("gone"), F.col("h").alias("gone_h"), "n", stays.alias("stays")).where("not stays or n > 1"), "goes")
    # The row travels as one value, so that no name of its columns can clash with those of the join.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("h"))
    same = (F.col("doc_id") == F.col("gone")) & (F.col("h") == F.col("gone_h"))
    # Most rows stay, and a filter of those that go tells so where they lie: only the others meet the exact join.
    may_go = among(F.col("doc_id"), F.col("h"), goes.select(F.col("gone").alias("doc_id"), F.col("gone_h").alias("h")))
    kept = whole.where(~may_go).unionByName(whole.where(may_go).join(goes, same, "left_anti"))
    again = goes.where("stays")  # rows that are there several times: one of them stays
    if not again.isEmpty():
        kept = kept.unionByName(whole.where(may_go).join(again, same, "left_semi").dropDuplicates(["doc_id", "h"]))
    return kept.select("row.*")


def among(doc_id: Column, h: Column, keys: DataFrame) -> Column:
    """Whether a row's id and text hash may be among ``keys`` (doc_id, h): never false for one that is, and false for a null id.

    A blocked Bloom filter of at most ``url_filter.MAX_FILTER_BYTES``; beyond the keys that fill it, more others pass.
    """
    key = lambda i, t: F.concat_ws(":", i.cast("string"), t.cast("string"))
    blocks = max(1, min(-(-keys.count() // url_filter.KEYS_A_BLOCK), url_filter.MAX_FILTER_BYTES // 32))
    words = url_filter.bloom_filter(keys.select(key(F.col("doc_id"), F.col("h")).alias("key")), blocks).scalar()
    return doc_id.isNotNull() & F.coalesce(url_filter.may_hold(words, key(doc_id, h), blocks), F.lit(False))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def deduplicate(docs: DataFrame, words: int = 4, distance: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of linked fingerprints, whole, that of the smallest id; rows without an id stay."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(made, pa.int64())], ["doc_id", "h", "fp"])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("h"), F.col(text).alias("text")).where("doc_id is not null")
    marked = materialise(own.mapInArrow(run, "doc_id long, h long, fp long"), "fingerprints")
    known = _components(marked, distance)
    return keep_first(docs, marked.join(known, F.col("fp") == F.col("class_fp")).select("doc_id", "h", "component"), id_column, text)
