"""SimHash near-duplicates at a stated Jaccard similarity of word shingles, for the pipeline.

Sets: A-Z lower-cased text, words between white space, different shingles of ``words`` words, each as 64 bits; a
text with fewer words is one shingle, a text without words the empty set, and equal sets (empty ones too) are
copies. Texts are linked at a similarity of SIMILAR or more.

* Fingerprints are those of simhash.py, over the set, but of WORDS words of 64 bits, each from hashes of its own: at
  similarity 4/5 two of them differ in some 15 % of their bits, and 64 bits can't tell such texts from others.
* Upper nodes: MASKS masks of MASK bits each, no bit in two of them. Similar sets agree on a whole mask of 13 bits with
  probability 0.118, so on none of 93 with 0.000008. Sets of under SMALL shingles differ in up to 19 % of the bits, so
  their masks have 10 bits. A node's size grows with the table, the number of nodes that a set is in doesn't.
* Below, a node's fingerprints are sorted by Gray rank, runs of them become leaves, and leaves inner nodes, which keep
  the bits that all below share. Pairs of such nodes go down from the top; differences in bits that both share are
  added up word by word and compared with LIMITS after each, over the first three words, and a pair that exceeds
  them is pruned with all below. Up to LAGS fingerprints, three leaves, are compared row by row. Of 100,000 pairs at similarity 4/5 exactly masks and limits together lose one or two of long
  texts, up to seven of sets of about 13 shingles, of more similar ones fewer; of unlike pairs of a node one in a
  billion passes (of small sets one in a million), so
  what is linked doesn't grow with the square of the table.
* A node of over NODE_LIMIT fingerprints is dealt into chunks, of which each pair is searched as a node. Where that makes
  more than FACTORED chunks the node is factored once more: each set goes to a node for each other mask, by its first FREE
  bits, and only what is still too large is dealt into chunks. Pairs at similarity 4/5 exactly agree on none of these
  92 masks with probability 2e-9 (of small sets, 7e-9).
* Blocks: components of these links. Within a block texts are compared exactly. A block of over NODE_SHINGLES shingles
  is dealt into chunks, and each pair of chunks is searched as a node, so what a task holds is bounded (but for
  single texts); a block of hot near copies costs the square of its chunks.
* A node returns a forest over its classes, never all pairs, and a task one forest for all its nodes, in which each
  class is linked to the smallest name of its tree. A group of near copies is in up to MASKS nodes, and as its smallest
  names are the same in many of them, these give the same links. What a task reads of all these links becomes one
  forest again, and components over all tasks follow by star rounds.

Defined cases: rows without an id stay; equal ids don't make texts alike; repeated rows stay once; null and empty
texts are copies of each other; an empty table gives no rows; all columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import simhash
from lodestrata.llm.components import smallest_reachable
from lodestrata.shipping import ship
from lodestrata.storage import materialise

SIMILAR = (4, 5)  # numerator and denominator, so that comparisons are exact
FREQUENT = 1 << 17  # not used any more; tests set it
AT_ONCE = 1 << 20
NODE_SHINGLES = 1 << 23
WORDS, MASKS, MASK, SMALL_MASK, SMALL = 19, 93, 13, 10, 9
DISTANCE, NODE_LIMIT = 24, 8192
LIMITS, SMALL_LIMITS = (DISTANCE, 40, 54), (28, 46, 62)  # bits that may differ in the first word, two and three words
FREE, SMALL_FREE, FACTORED = 10, 8, MASKS  # bits of the masks that factor a node once more, and the chunks beyond which that sends fewer rows
LAGS, LINKS_HELD, PAIRS_AT_ONCE, DEALT_AT_ONCE = 48, 1 << 18, 1 << 19, 500
FACTOR = 0x9E3779B97F4A7C55  # odd, no meaning otherwise
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_FIELDS = [np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)]  # of two, four and eight bits
FIRST = ("fp", "fp1", "fp2")  # columns of the words that LIMITS are for
_known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if len(_known[0]) < n:
        size = max(n, 2 * len(_known[0]))
        _known[:] = [np.append(np.uint64(1), np.cumprod(np.full(size, x, np.uint64))) for x in (FACTOR, pow(FACTOR, -1, 1 << 64))]
    return _known[0][:n], _known[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A number for each word between white space of lower-cased UTF-8."""
    if len(raw) > AT_ONCE:  # words in groups, so that what is held at once is bounded but for single words
        out, group, size = [np.empty(0, np.uint64)], [], 0
        for word in raw.split():
            if group and size + len(word) >= AT_ONCE:
                out.append(word_hashes(b" ".join(group)))
                group, size = [], 0
            group.append(word)
            size += len(word) + 1
        return np.concatenate([*out, _hashes(b" ".join(group))])
    return _hashes(raw)


def _hashes(raw: bytes) -> np.ndarray:
    letters = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[letters]
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1])) if len(raw) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(raw))
    sums = np.add.reduceat((letters + inside).astype(np.uint64) * inside * power, starts)  # a letter counts one more than its byte, white space nothing
    return _mixed(sums * inverse[starts])


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The different shingles of a text as sorted signed longs."""
    hashes = word_hashes((text or "").encode().lower())  # touches ASCII only
    if not len(hashes):
        return np.empty(0, np.int64)
    n = max(1, len(hashes) - words + 1)
    made = np.full(n, min(len(hashes), words), np.uint64)
    for i in range(min(words, len(hashes))):
        made = _mixed(made + hashes[i : i + n])
    return np.unique(made.view(np.int64))


def fingerprint(made: np.ndarray) -> np.ndarray:
    """WORDS words; a bit is 1 where it is set in over half of the shingles' hashes, or in half and in the first one's, so that sets of two have as many ones as others."""
    counts = np.zeros((WORDS, 8, 8), np.int64)
    for at in range(0, len(made), 255):
        hashes = _mixed(made[at : at + 255].view(np.uint64)[:, None] + _STEPS)
        sums = [(0, np.concatenate((hashes, np.zeros((-len(hashes) % 15, WORDS), np.uint64))))]
        for width, rows, field in zip((1, 2, 4), (3, 5, 17), _FIELDS, strict=True):  # fields as wide again hold the sums of so many rows
            sums = [(bit + low, ((x >> np.uint64(low)) & field)) for bit, x in sums for low in (0, width)]
            sums = [(bit, x.reshape(rows, -1, WORDS).sum(axis=0) if rows < 17 else x.sum(axis=0)) for bit, x in sums]
        for bit, x in sums:
            counts[:, :, bit] += x.view(np.uint8).reshape(WORDS, 8)
    first = np.unpackbits(_mixed(made[:1].view(np.uint64)[:, None] + _STEPS).view(np.uint8), bitorder="little") if len(made) else 0
    return np.packbits(counts.ravel() * 2 + first > len(made), bitorder="little").view(np.uint64)


def upper_nodes(fps: np.ndarray, small: bool) -> np.ndarray:
    """For each row of words its nodes, one a mask; those of small sets are negative."""
    nodes = _masked(fps, SMALL_MASK if small else MASK)
    return -1 - nodes if small else nodes


def _masked(fps: np.ndarray, width: int) -> np.ndarray:
    """For each row of words and each mask its number, followed by the first ``width`` of its bits."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, : MASKS * MASK].reshape(len(fps), MASKS, MASK)[:, :, :width]
    return np.arange(MASKS) << MASK | bits @ (1 << np.arange(width))


def prefix_length(n: int) -> int:
    """How many shingles of n, in the common order, must meet those of any similar set."""
    top, below = SIMILAR
    return n - -(-n * top // below) + 1 if n else 0


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _numbered(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number, and how often each number is there; in a third of the memory of ``np.unique``."""
    order = np.argsort(flat)
    flat = flat[order]
    new = np.append(True, flat[1:] != flat[:-1])
    del flat
    names = np.empty(len(order), np.int32)
    names[order] = np.cumsum(new, dtype=np.int32) - 1
    return names, np.diff(np.append(np.flatnonzero(new), len(order)))


def _merge(roots: np.ndarray, *places: int) -> None:
    met = np.unique(roots[list(places)])
    if len(met) > 1:
        roots[np.isin(roots, met)] = met[0]


class _Sets:
    """Sets as numbers, for exact comparison of one with many."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        sets.clear()
        self.names, self.seen = _numbered(flat)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.mine = np.zeros(len(self.seen), bool)

    def own(self, i: int) -> np.ndarray:
        return self.names[self.begins[i] : self.begins[i] + self.sizes[i]]

    def prefix(self, i: int) -> np.ndarray:
        own = self.own(i)
        return own[np.lexsort((own, self.seen[own]))[: prefix_length(len(own))]]

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are similar to set i."""
        top, below = SIMILAR
        sizes, n = self.sizes[others], self.sizes[i]
        others = others[(sizes * below >= n * top) & (n * below >= sizes * top)]
        if not len(others):
            return others
        self.mine[self.own(i)] = True
        found = []
        for some in np.array_split(others, 1 + self.sizes[others].sum() // AT_ONCE):
            if len(some):
                held = self.sizes[some]
                shared = np.add.reduceat(self.mine[self.names[_ragged(self.begins[some], held)]], np.cumsum(held) - held, dtype=np.int64)
                found.append(some[shared * (top + below) >= top * (held + n)])
        self.mine[self.own(i)] = False
        return np.concatenate(found)


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none is empty) the place of its component's root, the smallest, by links of similar sets. Empties the list.

    Sets that share a shingle of their prefixes are compared: first all with the first set that has the shingle, which
    makes one component of near copies; then only sets that are still in different components.
    """
    s = _Sets(sets)
    roots = np.arange(len(s.sizes))
    prefixes = [s.prefix(i) for i in range(len(roots))]
    kept = np.array([len(p) for p in prefixes])
    listed, lister = np.concatenate(prefixes), np.repeat(roots, kept).astype(np.int32)
    del prefixes
    order = np.argsort(listed, kind="stable")
    listed, lister = listed[order], lister[order]
    starts = np.flatnonzero(np.append(True, listed[1:] != listed[:-1]))
    heads = np.repeat(lister[starts], np.diff(np.append(starts, len(listed))))
    pairs = np.unique(heads.astype(np.int64) << 32 | lister)
    pairs = pairs[(pairs >> 32) != (pairs & 0xFFFFFFFF)]
    cuts = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
    for a, z in zip(cuts, np.append(cuts[1:], len(pairs))[: len(cuts)], strict=True):
        head, others = int(pairs[a] >> 32), pairs[a:z] & 0xFFFFFFFF
        _merge(roots, head, *s.alike(head, others[roots[others] != roots[head]]).tolist())
    # What is left to compare: lists with sets of several components, each cut into runs of one component.
    several = np.minimum.reduceat(roots[lister], starts) != np.maximum.reduceat(roots[lister], starts)
    alive = np.repeat(several, np.diff(np.append(starts, len(listed))))
    listed, lister = listed[alive], lister[alive]
    if not len(listed):
        return roots
    was = roots.copy()
    order = np.lexsort((lister, was[lister], listed))
    listed, lister = listed[order], lister[order]
    runs = np.flatnonzero(np.append(True, (listed[1:] != listed[:-1]) | (was[lister[1:]] != was[lister[:-1]])))
    run_list, run_root, run_size = listed[runs], was[lister[runs]], np.diff(np.append(runs, len(listed)))
    first = np.searchsorted(run_list, np.arange(len(s.seen) + 1))
    by_set = np.lexsort((listed, lister))
    shingle_of, places = listed[by_set], np.searchsorted(lister[by_set], np.arange(len(roots) + 1))
    for i in np.unique(lister).tolist():
        p = shingle_of[places[i] : places[i + 1]]
        r = _ragged(first[p], first[p + 1] - first[p])
        r = r[roots[run_root[r]] != roots[i]]
        if len(r):
            near = np.unique(lister[_ragged(runs[r], run_size[r])])
            near = near[(near < i) & (roots[near] != roots[i])]
            if len(near):
                _merge(roots, i, *s.alike(i, near).tolist())
    return roots


def _marked(own: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, name, size, fp, fp1, fp2, bits) of rows (doc_id, h, text): the name of the set, its number of shingles and fingerprint, whole in ``bits``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, fps = [], [], np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, t in enumerate(batch.column("text")):
                made = shingles(t.as_py(), words)
                names.append(xxhash.xxh64_intdigest(made.tobytes(), seed=42) - (1 << 63))
                sizes.append(len(made))
                fps[i] = fingerprint(made)
            first = [pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(len(LIMITS))]
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *first, pa.array([x.tobytes() for x in fps], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "name", "size", "fp", "fp1", "fp2", "bits"])

    return own.mapInArrow(run, "doc_id long, h long, name long, size long, fp long, fp1 long, fp2 long, bits binary")


def _dealt(classes: DataFrame) -> DataFrame:
    """(node, fp, fp1, fp2, name): each set (name, size, bits) in its upper nodes; sets about as large as SMALL in both kinds."""
    top, below = SIMILAR

    def nodes(fps: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for small, there in ((True, sizes * top <= (SMALL - 1) * below), (False, sizes >= SMALL)):
            rows = np.flatnonzero(there)
            yield np.repeat(rows, MASKS), upper_nodes(fps[rows], small).ravel()

    return _spread(classes, "size", nodes, ["node"]).select("node", *FIRST, "name")


def _factored(rows: DataFrame) -> DataFrame:
    """(node, fp, fp1, fp2, name): each row (node, name, bits) of a large node in nodes of its own, one for each mask but the node's."""

    def nodes(fps: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for small, there in ((True, node < 0), (False, node >= 0)):
            rows = np.flatnonzero(there)
            own = (-1 - node[rows] if small else node[rows]) >> MASK
            at, mask = np.nonzero(np.arange(MASKS) != own[:, None])
            yield rows[at], node[rows][at], _masked(fps[rows], SMALL_FREE if small else FREE)[at, mask]

    named = F.xxhash64("node", "under").bitwiseAND(F.lit((1 << 63) - 1))
    return _spread(rows, "node", nodes, ["node", "under"]).select(F.when(F.col("node") < 0, -1 - named).otherwise(named).alias("node"), *FIRST, "name")


def _spread(rows: DataFrame, by: str, nodes: Callable, columns: list[str]) -> DataFrame:
    """The first words and name of sets (name, bits) with what ``nodes`` says of their words and column ``by``: places of sets, and a column for each name."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT_AT_ONCE):
                some = batch.slice(at, DEALT_AT_ONCE)
                said, name = (some.column(c).to_numpy(zero_copy_only=False) for c in (by, "name"))
                fps = np.frombuffer(b"".join(some.column("bits").to_pylist()), np.uint64).reshape(-1, WORDS)
                for places, *made in nodes(fps, said):
                    first = [fps[places, w].view(np.int64) for w in range(len(FIRST))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*made, *first, name[places])], [*columns, *FIRST, "name"])

    return rows.select(by, "name", "bits").mapInArrow(run, ", ".join(f"{c} long" for c in (*columns, *FIRST, "name")))


def _kept(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, limits: tuple[int, ...], shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (row of left, row of right) those whose differences (in bits that are shared below both), added up word by word, stay within the limits."""
    seen = np.zeros(len(a), np.uint8)
    for w, limit in zip(range(left.shape[1]), limits, strict=False):
        x = left[a, w] ^ right[b, w]
        seen = seen + np.bitwise_count(x if shared is None else x & shared[a, w] & shared[b, w])
        near = seen <= limit
        a, b, seen = a[near], b[near], seen[near]
    return a, b


class _Tree:
    """The index of simhash.py over rows of several words, sorted by Gray rank."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps, self.levels, size = fps, [], simhash.LEAF
        while True:
            starts = np.arange(0, len(fps), size)
            differing = np.bitwise_or.reduceat(fps ^ np.repeat(fps[starts], np.diff(np.append(starts, len(fps))), axis=0), starts, axis=0)
            self.levels.append((fps[starts] & ~differing, ~differing))
            if len(starts) <= simhash.FAN:
                break
            size *= simhash.FAN

    def join(self, limits: tuple[int, ...], roots: np.ndarray) -> None:
        """Joins the trees of all rows within the limits of each other: pairs of nodes go down together, and one that differs too much is pruned with all pairs below."""
        a, b = np.triu_indices(len(self.levels[-1][0]))
        for level in reversed(range(len(self.levels))):
            pattern, shared = self.levels[level]
            a, b = _kept(a, b, pattern, pattern, limits, shared)
            if level:
                i, j = np.divmod(np.arange(simhash.FAN**2), simhash.FAN)
                a, b = (a[:, None] * simhash.FAN + i).ravel(), (b[:, None] * simhash.FAN + j).ravel()
                inside = (a <= b) & (b < len(self.levels[level - 1][0]))
                a, b = a[inside], b[inside]
        n, leaf = len(self.fps), simhash.LEAF
        first = np.zeros(-(-n // leaf) * leaf, np.uint64)
        first[:n] = self.fps[:, 0]
        first = first.reshape(-1, leaf)
        step = max(1, PAIRS_AT_ONCE // leaf**2)
        for at in range(0, len(a), step):
            left, right = a[at : at + step], b[at : at + step]
            hit = np.flatnonzero(np.bitwise_count(first[left][:, :, None] ^ first[right][:, None, :]) <= limits[0])
            pair, place = hit // leaf**2, hit % leaf**2
            x, y = left[pair] * leaf + place // leaf, right[pair] * leaf + place % leaf
            apart = (x < y) & (y < n)
            x, y = x[apart], y[apart]
            apart = roots[x] != roots[y]
            simhash._join(roots, *_kept(x[apart], y[apart], self.fps, self.fps, limits))


def _roots(fps: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """For each row of words the place of its component's root, by links within the limits."""
    order = np.argsort(simhash.gray_rank(fps[:, 0]), kind="stable")
    roots = np.arange(len(fps))
    _Tree(fps[order]).join(limits, roots)
    out = np.empty(len(fps), np.int64)
    out[order] = order[roots]
    return out


def _node_links(node: np.ndarray, fps: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest for each node: links from names to the smallest of their component, by fingerprints (rows of words) within the limits."""
    roots = np.arange(len(node))
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(starts, len(node)))
    ends = np.repeat(starts + sizes, sizes)
    few = np.repeat((sizes <= LAGS) & (sizes > 1), sizes)
    for limits, kind in ((LIMITS, node >= 0), (SMALL_LIMITS, node < 0)):
        rows = np.flatnonzero(few & kind)
        for lag in range(1, LAGS):
            rows = rows[rows + lag < ends[rows]]
            if not len(rows):
                break
            simhash._join(roots, *_kept(rows, rows + lag, fps, fps, limits))
    for a, n in zip(starts[sizes > LAGS], sizes[sizes > LAGS], strict=True):
        roots[a : a + n] = a + _roots(fps[a : a + n], LIMITS if node[a] >= 0 else SMALL_LIMITS)
    return _stars(roots, name)


def _stars(roots: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each name to the smallest of its tree: nodes and tasks that hold the same ones then give the same links."""
    least = name.copy()
    np.minimum.at(least, roots, name)
    least = least[roots]
    far = name != least
    return name[far], least[far]


class _Forest:
    """Links that a task has found, as a forest of all of them."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.links, self.more, self.n = np.empty((2, 0), np.int64), [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.more.append(np.stack((u, v)))
        self.n += len(u)

    def rest(self) -> np.ndarray:
        """All links, in two rows; none are held from now on."""
        names, places = np.unique(np.concatenate([self.links, *self.more], axis=1), return_inverse=True)
        roots = np.arange(len(names))
        simhash._join(roots, *places.reshape(2, -1))
        self.clear()
        return np.stack(_stars(roots, names))

    def excess(self) -> np.ndarray:
        """None while the forest is small enough to be held, else all of it."""
        if self.n < LINKS_HELD:
            return self.links[:, :0]
        links = self.rest()
        if links.shape[1] >= LINKS_HELD // 2:
            return links
        self.links = links
        return links[:, :0]


def _merged(links: DataFrame) -> DataFrame:
    """(u, v): forests with the components of the links, one for what each task reads."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Forest()
        for batch in batches:
            held.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.excess()], ["u", "v"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.rest()], ["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _searched(rows: DataFrame, limit: int) -> DataFrame:
    """(u, v, node, further words): links of names where node is null; else first word and name, and its other words, of a row of a node that has over ``limit`` fingerprints.

    ``rows`` (node, fp, name) may have further words fp1 and fp2.
    """
    import pyarrow as pa

    words = [c for c in FIRST if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Forest()
        kept = (np.empty(0, np.int64), np.empty((0, len(words)), np.uint64), np.empty(0, np.int64))  # rows of the node that the next batch may go on with, one for each fingerprint
        large = None

        def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *[pa.nulls(len(u), pa.int64()) for _ in words]], ["u", "v", "node", *words[1:]])

        def whole(node: np.ndarray, fps: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
            first, *more = (pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(len(words)))
            return pa.RecordBatch.from_arrays([first, pa.array(name), pa.array(node), *more], ["u", "v", "node", *words[1:]])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, name = (np.concatenate((k, batch.column(c).to_numpy(zero_copy_only=False))) for k, c in ((kept[0], "node"), (kept[2], "name")))
            fps = np.concatenate((kept[1], np.column_stack([batch.column(w).to_numpy(zero_copy_only=False) for w in words]).view(np.uint64)))
            new = np.append(True, (node[1:] != node[:-1]) | (fps[1:] != fps[:-1]).any(axis=1))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]  # rows come sorted by node, fingerprint and name
            held.add(name[~new], name[first[~new]])
            node, fps, name = node[new], fps[new], name[new]
            last = int(np.searchsorted(node, node[-1], "left"))
            if large is not None and node[0] == large:  # its other rows have gone out already
                end = int(np.searchsorted(node, large, "right"))
                stop = end - 1 if end == len(node) else end  # the last one waits for its equals
                yield whole(node[:stop], fps[:stop], name[:stop])
                node, fps, name, last = node[stop:], fps[stop:], name[stop:], max(0, last - stop)
            held.add(*_node_links(node[:last], fps[:last], name[:last]))
            kept = (node[last:], fps[last:], name[last:])
            if len(kept[0]) > limit:
                large = kept[0][0]
                yield whole(*(x[:-1] for x in kept))
                kept = tuple(x[-1:] for x in kept)
            yield out(*held.excess())
        if large is not None and len(kept[0]) and kept[0][0] == large:
            yield whole(*kept)
        else:
            held.add(*_node_links(*kept))
        yield out(*held.rest())

    return rows.repartition("node").sortWithinPartitions("node", *words, "name").mapInArrow(run, ", ".join(f"{c} long" for c in ("u", "v", "node", *words[1:])))


def _parted(searched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) and (node, fp, fp1, fp2, name): links, and rows of nodes that are too large."""
    found = materialise(searched, "searched")
    return found.where("node is null").select("u", "v"), found.where("node is not null").select("node", F.col("u").alias("fp"), *FIRST[1:], F.col("v").alias("name"))


def _counted(dense: DataFrame) -> DataFrame:
    """(large, chunks) of the nodes of ``dense``."""
    return materialise(dense.groupBy(F.col("node").alias("large")).agg(F.ceil(F.count("*") / (NODE_LIMIT // 2)).alias("chunks")), "large")


def _blocks(marked: DataFrame) -> DataFrame:
    """(u, v): sets that may have a similar one, with their block, the smallest name of it (itself not listed)."""
    classes = marked.where("size > 0").select("name", "size", "bits").dropDuplicates(["name"])
    near, dense = _parted(_searched(_dealt(classes), NODE_LIMIT))
    counted = _counted(dense)
    if not counted.where(F.col("chunks") > FACTORED).isEmpty():
        met = dense.join(counted, F.col("node") == F.col("large"))
        deep = met.where(F.col("chunks") > FACTORED).select("node", F.col("name").alias("n")).join(classes, F.col("n") == F.col("name")).select("node", "name", "bits")
        links, still = _parted(_searched(_factored(deep), NODE_LIMIT))
        near, dense = near.unionByName(links), met.where(F.col("chunks") <= FACTORED).select(*still.columns).unionByName(still)
        counted = _counted(dense)
    if not counted.isEmpty():
        dealt = dense.join(counted, F.col("node") == F.col("large")).withColumn("own", F.pmod(F.xxhash64(*FIRST), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit((1 << 63) - 1))
        dealt = dealt.select(F.when(F.col("node") < 0, -1 - pair).otherwise(pair).alias("node"), *FIRST, "name")
        near = near.unionByName(_parted(_searched(dealt, 1 << 40))[0])
    return smallest_reachable(_merged(near))


def _links(own: DataFrame, marked: DataFrame, words: int) -> DataFrame:
    """(u, v) over the names of sets: their components are those of all similar pairs."""
    import pyarrow as pa

    found = _blocks(marked)
    block = found.select(F.col("u").alias("class"), F.col("v").alias("block")).unionByName(found.select(F.col("v").alias("class"), F.col("v").alias("block")).distinct())
    one = marked.groupBy(F.col("name").alias("class"), F.col("size")).agg(F.min(F.struct("doc_id", "h")).alias("one"))
    placed = materialise(block.join(one, "class"), "placed")
    total = F.sum("size")
    chunks = placed.groupBy("block").agg(F.when(total > NODE_SHINGLES, F.ceil(total * 2 / NODE_SHINGLES)).otherwise(1).alias("chunks"))
    part = F.pmod(F.xxhash64("class"), F.col("chunks"))
    dealt = placed.join(chunks, "block").withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.where("chunks = 1 or own <> other")  # there are three chunks at least, and a chunk's own pairs are in every pair with it
    dealt = dealt.select("class", F.col("one.doc_id").alias("one"), F.col("one.h").alias("one_h"), F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("node"))
    dealt = materialise(dealt, "dealt")
    asked = simhash.among(F.col("doc_id"), F.col("h"), dealt.select(F.col("one").alias("doc_id"), F.col("one_h").alias("h")))  # other texts stay where they lie
    every = own.where(asked).join(dealt, (F.col("doc_id") == F.col("one")) & (F.col("h") == F.col("one_h"))).select("node", "class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        at = None

        def search() -> pa.RecordBatch:
            names, sets = np.fromiter(held, np.int64, len(held)), list(held.values())
            held.clear()
            roots = forest(sets)
            far = np.flatnonzero(roots != np.arange(len(roots)))
            return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[roots[far]])], ["u", "v"])

        for batch in batches:
            for node, name, t in zip(*(batch.column(c) for c in ("node", "class", "text")), strict=True):
                if node.as_py() != at and held:  # nodes come sorted
                    yield search()
                at = node.as_py()
                if name.as_py() not in held:
                    held[name.as_py()] = shingles(t.as_py(), words)
        if held:
            yield search()

    return every.repartition("node").sortWithinPartitions("node").mapInArrow(run, "u long, v long")


def deduplicate(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of similar texts, whole, that of the smallest id; see above for the defined cases."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), simhash.text_hash(F.col(text)).alias("h"), F.col(text).alias("text")).where("doc_id is not null")
    marked = materialise(_marked(own, words), "sets")
    reached = smallest_reachable(_links(own, marked, words))
    named = marked.join(reached, F.col("name") == F.col("u"), "left").select("doc_id", "h", F.coalesce("v", "name").alias("component"))
    return simhash.keep_first(docs, materialise(named, "named"), id_column, text)
