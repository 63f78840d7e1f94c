"""Best-fit packing of tokenised documents into sequences of fixed length, with certified counts.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut; a cut document's first piece
takes the remainder, the others are full). Pieces are dealt at random into partitions of bounded size, and each
partition is packed best-fit decreasing. Dual feasible functions bound from below how many sequences any packing
of a partition's lengths needs: for such a function f with f(capacity) = 1, no sequence holds more than 1 in
sum, so the sum of f over all lengths, rounded up, is a bound. The families used are the roundings of
Fekete and Schepers and the threshold functions behind the Martello-Toth bound L2, as exact integers.

A partition whose count meets its bound is certified: it can't be packed better, and its full sequences are
final. One that misses it is packed once more with exact fills first (the rest of a sequence is matched with one
or two pieces that fill it), and the better packing is kept; while it still misses the bound, its unfilled sequences
and some of the full ones, drawn anew each time, are emptied and packed again, and taken over if that saves a
sequence, until ``FAILED_TRIES`` tries in a row have saved none.

The bound of the whole table is taken from the histogram of all lengths. While the table's count exceeds it,
partitions with a gap (their count above their unrounded bound) exchange what lies in their unfilled sequences: it
is dealt anew among fewer partitions and packed again, and taken over if that saves a sequence. Rounds end when the
bound is met, when one partition held all of the exchange, or when ``FAILED_DEALS`` deals in a row have saved
nothing; the table's count and bound are logged. Partitions never hold more than about ``partition_size`` pieces,
whatever the table's size or its repeats.

Defined cases: a null text is empty, and an empty text is the closing id alone; repeated rows are packed each;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bytepair import encoder
from lodestrata.shipping import ship
from lodestrata.storage import materialise

_log = logging.getLogger(__name__)

PARTITION_SIZE = 40_000
FAILED_DEALS, FAILED_TRIES, DRAWN = 3, 12, 0.15
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "sequence_id long, offset long, fill long, bucket long, bins long, bound long, slack boolean"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each row: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` their ids as little-endian 32-bit numbers."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, made, ids = [], [], []
            for i, t in enumerate(batch.column("text")):
                raw = memoryview(e.encode(t.as_py() or "") + end)
                for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + n)]
                    rows.append(i)
                    made.append((k, start, n, zlib.crc32(own)))
                    if with_ids:
                        ids.append(bytes(own))
            columns = np.array(made, np.int64).reshape(-1, 4)
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(columns[:, 0], pa.int32()), *(pa.array(columns[:, i]) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> tuple[int, int]:
    """(sequences that any packing needs, the same rounded down): counts[x] pieces have length x, up to capacity."""
    x, best, floor = np.arange(capacity + 1), 0, 0

    def take(total: int, scale: int) -> None:
        nonlocal best, floor
        best, floor = max(best, -(-total // scale)), max(floor, total // scale)

    n = counts[: capacity + 1].astype(np.int64)
    sums, sizes = np.cumsum(n), np.cumsum(n * x)
    for low in range(1, capacity // 2 + 1):  # lengths under low count nothing, those over capacity - low count as whole
        whole = int(sums[-1] - sums[capacity - low])
        take(whole * capacity + int(sizes[capacity - low] - sizes[low - 1]), capacity)
    for k in range(1, 33):  # steps of 1/k; a multiple of 1/(k+1) stays as it is
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * (scaled // capacity), (k + 1) * (scaled // capacity))
        take(int((n * value).sum()), k * (k + 1))
    return best, floor


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, and each sequence's fill."""
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by what they can still take
    open_ = 0  # bit r: some sequence can take r more
    used: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_ >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                open_ &= ~(1 << room)
        else:
            own, room = len(used), capacity
            used.append(0)
        where[i], offset[i] = own, used[own]
        used[own] += n
        if room > n:
            free[room - n].append(own)
            open_ |= 1 << room - n
    return where, offset, np.array(used, np.int64)


def exact_fill_first(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_fit_decreasing``, but sequence by sequence: the rest of each is matched with one or two pieces that fill it
    exactly where there are such, else with the longest piece that fits."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(capacity + 2), "left")
    places = [order[ends[n] : ends[n + 1]].tolist() for n in range(capacity + 1)]  # pieces by length
    present = sum(1 << n for n in range(1, capacity + 1) if places[n])
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []

    def put(n: int) -> None:
        nonlocal present
        i = places[n].pop()
        if not places[n]:
            present &= ~(1 << n)
        where[i], offset[i] = len(used) - 1, used[-1]
        used[-1] += n

    while present:
        used.append(0)
        put(present.bit_length() - 1)
        while (rest := capacity - used[-1]) and (fitting := present & ((1 << rest + 1) - 1)):
            longest = fitting.bit_length() - 1
            chosen = [longest]
            left = fitting
            while longest < rest and left and 2 * (n := left.bit_length() - 1) >= rest:
                if present >> (rest - n) & 1 and (2 * n != rest or len(places[n]) > 1):
                    chosen = [n, rest - n]
                    break
                left &= ~(1 << n)
            for n in chosen:
                put(n)
    return where, offset, np.array(used, np.int64)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(sequence and offset of each piece, each sequence's fill, lower bound, the same rounded down).

    Best-fit decreasing; where it misses the bound, exact fills first as well, and the better of the two.
    """
    bound, floor = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    packed = best_fit_decreasing(lengths, capacity)
    if len(packed[2]) > bound:
        packed = min(packed, exact_fill_first(lengths, capacity), key=lambda p: len(p[2]))
    return *_repacked(lengths, capacity, *packed, bound), bound, floor


def _repacked(lengths: np.ndarray, capacity: int, where: np.ndarray, offset: np.ndarray, used: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A packing with fewer sequences than the given one, or that one, by emptying some sequences and packing them again."""
    draw, failed = np.random.default_rng(len(lengths)), 0
    while len(used) > bound and failed < FAILED_TRIES:
        emptied = (used < capacity) | (draw.random(len(used)) < DRAWN * (1 + failed % 4))
        mine = np.flatnonzero(emptied[where])
        again = min((f(lengths[mine], capacity) for f in (best_fit_decreasing, exact_fill_first)), key=lambda p: len(p[2]))
        if len(again[2]) >= emptied.sum():
            failed += 1
            continue
        failed = 0
        renamed = np.cumsum(~emptied) - 1  # those that stay come first, then the new ones
        where, offset, used = renamed[where], offset.copy(), np.concatenate((used[~emptied], again[2]))
        where[mine], offset[mine] = again[0] + (~emptied).sum(), again[1]
    return where, offset, used


def _pack_round(pieces: DataFrame, n: int, number: int, capacity: int, partition_size: int) -> DataFrame:
    """``pieces`` with the columns of _PLACED; sequences of one round never share a number with another's."""
    import pyarrow as pa

    buckets = max(1, -(-n // partition_size))
    own = [f.name for f in pieces.schema]

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bucket = table.column("bucket")[0].as_py()
        where, offset, used, bound, floor = pack_lengths(lengths, capacity)
        more = {"sequence_id": (number << 46) + (bucket << 24) + where, "offset": offset, "fill": used[where], "bucket": np.full(len(where), bucket), "bins": np.full(len(where), len(used)), "bound": np.full(len(where), bound), "slack": np.full(len(where), len(used) > floor)}
        out = table.select(own)
        for k, v in more.items():
            out = out.append_column(k, pa.array(v))
        return out

    # The row number within the stored table deals repeated rows apart, and is the same when a task is run again.
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(number)), F.lit(buckets)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("bucket").applyInArrow(run, f"{schema}, {_PLACED}")


def pack(pieces: DataFrame, capacity: int = 1024, partition_size: int = PARTITION_SIZE) -> DataFrame:
    """``pieces`` (a stored table with doc_id, piece and length) with sequence_id and offset."""
    ship(pieces.sparkSession)
    own = pieces.columns
    by_length = pieces.groupBy("length").count().collect()  # a row for each length up to the capacity
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_length:
        counts[length] += n
    bound, n = lower_bound(counts, capacity)[0], int(counts.sum())
    if not n:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    placed = materialise(_pack_round(pieces, n, 0, capacity, partition_size), "packed")
    total = placed.agg(F.sum(F.when(F.col("offset") == 0, 1))).first()[0]
    final, round_, failed = [], 0, 0
    while total > bound and failed < FAILED_DEALS:
        round_ += 1
        exchanged = F.col("slack") & (F.col("fill") < capacity)
        was, moved = placed.where(exchanged).agg(F.coalesce(F.sum(F.when(F.col("offset") == 0, 1)), F.lit(0)), F.count("*")).first()
        if was < 2:
            break
        again = materialise(_pack_round(placed.where(exchanged).select(*own), moved, round_, capacity, partition_size), "packed")
        now = again.agg(F.sum(F.when(F.col("offset") == 0, 1))).first()[0]
        failed = failed + 1 if now >= was else 0
        if not failed:
            final.append(placed.where(~exchanged))
            placed, total = again, total - was + now
        if moved <= partition_size:
            break
    _log.info("%d sequences of %d pieces; no packing has fewer than %d", total, n, bound)
    out = placed
    for x in final:
        out = out.unionByName(x)
    return out.select(*own, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False, partition_size: int = PARTITION_SIZE) -> DataFrame:
    """Pieces of all rows of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(materialise(tokenise(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity, partition_size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids) of packed pieces that carry their ids: one row for each training sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.col("parts.doc_id").alias("doc_ids"), F.expr("aggregate(parts.ids, X'', (a, b) -> concat(a, b))").alias("ids"))
