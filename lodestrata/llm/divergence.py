"""How far the sources of a language differ in the words they use, exactly.

Terms of a text are runs of Latin letters and characters outside ASCII, only A-Z in lower case. A language keeps the
terms that at least ``min_docs`` of its documents hold (a document is a row). The work:

1. *Sketch.* Tasks count document frequencies by language and term and add them to a count-min sketch of bounded size.
   Its counters stop at ``min_docs``, one byte each; sketches are merged block by block, counters added up to the same
   stop. So a merged counter is ``min_docs`` wherever a term that falls on it has that many documents: it never
   underestimates, and of each counter one bit is enough.
2. *Count.* Tasks count again and let through only terms all of whose counters are full, before anything is shuffled.
   Survivors are counted exactly by language, source and term, and those that are frequent enough in truth stay.
3. *Compare.* Only counts above zero are rows. Two sources meet on the terms that both have; what the terms of one
   only contribute comes from its histogram of counts, as the other's share of an absent term is one number.

All numbers are exact: shares are integers, products are taken in decimals of 38 digits.

The sketch has ``WIDTH`` counters in each of ``DEPTH`` rows (12 MB in a worker, 1.5 MB of bits at the end), whatever the
input. With far more different terms than counters it lets more through, and the exact counts decide; it is never wrong.

Defined cases: null text, language and source are ''. A source without terms is compared too. A language without kept
terms gives pairs of value 0 and no terms. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.shipping import ship
from lodestrata.storage import materialise

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
WIDTH, DEPTH, BLOCK = 1 << 22, 3, 1 << 16
#: Different terms that a task holds before it passes them on.
HELD = 300_000
#: Texts between two looks at how many these are.
FEW = 200
#: Parts that a pair of tables which meet by language alone is dealt to.
PARTS = 16
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order, repeats included. Bytes from 128 up are those of characters outside ASCII."""
    return raw.translate(_TABLE).split()


def _places(lang: bytes, words: list[bytes], width: int) -> np.ndarray:
    """Each term's counter in each row, (rows, terms)."""
    from xxhash import xxh3_64_intdigest as digest

    seed = digest(lang)
    h = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) & np.uint64(width - 1)).astype(np.int64) for i in range(DEPTH)])


def _read(batches: Iterator[pa.RecordBatch], held: dict, add) -> Iterator[bool]:
    """Gives each text's terms to ``add``; stops where too many terms are held, and at the end."""
    for batch in (b.slice(i, FEW) for b in batches for i in range(0, b.num_rows, FEW)):
        langs, sources, texts = (batch.column(i).to_pylist() for i in range(3))
        for lang, source, text in zip(langs, sources, texts, strict=True):
            add(lang, source, terms(text))
        if sum(map(len, held.values())) > HELD:
            yield True
    yield True


def _rows(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    return docs.select(known(lang).alias("lang"), known(source).alias("source"), known(text).alias("text"))


def document_sketch(rows: DataFrame, min_docs: int, width: int = WIDTH) -> bytes:
    """Bits of the merged sketch: 1 where a counter reached ``min_docs``."""
    stop = np.uint8(min_docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held = np.zeros((DEPTH, width), np.uint8), {}
        for _ in _read(batches, held, lambda lang, source, words: held.setdefault(lang, Counter()).update(set(words))):
            for lang, counts in held.items():
                n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), min_docs)
                for row, at in zip(sketch, _places(lang, list(counts), width), strict=True):
                    cell, inverse = np.unique(at, return_inverse=True)
                    row[cell] = np.minimum(row[cell] + np.bincount(inverse, n), min_docs)  # in doubles: no overflow
            held.clear()
        for i, block in enumerate(sketch.reshape(-1, BLOCK)):
            if block.any():
                yield _record(_BLOCKS, [i], [zlib.compress(block.tobytes(), 1)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(zlib.decompress(packed), np.uint8)
                merged[i] = np.minimum(merged[i].astype(np.uint16) + block, stop).astype(np.uint8) if i in merged else block
        for i, block in merged.items():
            yield _record(_BLOCKS, [i], [np.packbits(block >= stop).tobytes()])

    blocks = rows.mapInArrow(build, _BLOCKS).repartition("block").mapInArrow(merge, _BLOCKS)
    bits = bytearray(DEPTH * width // 8)
    for r in blocks.collect():  # 192 blocks of 8 KB at most
        bits[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = r["cells"]
    return bytes(bits)


_BLOCKS = "block int, cells binary"
_COUNTS = "lang binary, source binary, term binary, n long, docs long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _record(schema: str, *columns: list) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def surviving_counts(rows: DataFrame, bits: bytes, width: int = WIDTH) -> DataFrame:
    """lang, source, term, n (occurrences), docs of the terms that the sketch can't rule out, exactly."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # of the sketch's fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, held = np.frombuffer(shared.value, np.uint8), {}

        def add(lang: bytes, source: bytes, words: list[bytes]) -> None:
            if (lang, source) not in held:
                held[lang, source] = Counter()
                docs[lang, source] = Counter()
            held[lang, source].update(words)
            docs[lang, source].update(set(words))

        docs: dict[tuple[bytes, bytes], Counter] = {}
        for _ in _read(batches, held, add):
            for (lang, source), counts in held.items():
                words = list(counts)
                keep = np.ones(len(words), bool)
                for i, at in enumerate(_places(lang, words, width)):
                    at = at + i * width
                    keep &= (full[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
                kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                if kept:
                    yield _record(_COUNTS, [lang] * len(kept), [source] * len(kept), kept, [counts[w] for w in kept], [docs[lang, source][w] for w in kept])
            held.clear()
            docs.clear()

    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, lang: str = "lang", source: str = "source", text: str = "text", width: int = WIDTH) -> DataFrame:
    """lang, source, term, n, lang_n of every kept term that occurs in a source; stored."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255")
    if width < BLOCK or width & (width - 1):
        raise ValueError(f"width must be a power of two from {BLOCK}")
    ship(docs.sparkSession)
    rows = _rows(docs, lang, source, text)
    counts = surviving_counts(rows, document_sketch(rows, min_docs, width), width)
    by_term = Window.partitionBy("lang", "term")
    totals = counts.withColumn("lang_n", F.sum("n").over(by_term)).withColumn("lang_docs", F.sum("docs").over(by_term)).where(F.col("lang_docs") >= min_docs)
    return materialise(totals.select(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("term").cast("string"), "n", "lang_n"), "counts")


def _share(count: Column, total: Column, kept: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)) as a long; 0 without kept terms."""
    wide = lambda c: c.cast("decimal(27,0)")
    above = (F.lit(scale).cast("decimal(10,0)") * wide(count + prior)).cast("decimal(38,0)")
    below = (total + prior * kept).cast("decimal(38,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1).otherwise(F.lit(0)).cast("long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text", width: int = WIDTH) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    ``pair``: the item is another source of the language, the value the sum over all kept terms of the difference of their
    shares. ``term``: the ``top`` terms whose share is above that of the language, with the difference.
    """
    counts = term_counts(docs, min_docs, lang, source, text, width)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = docs.select(known(lang).alias("lang"), known(source).alias("source")).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    share = lambda count, total: _share(count, F.col(total), F.col("kept"), prior, scale)
    groups = every.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    groups = materialise(groups.withColumn("absent", share(F.lit(0), "total")), "groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), "total").alias("p"), share(F.col("lang_n"), "lang_total").alias("q"), "absent")
    shares = materialise(shares, "shares")
    named = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best))
    return ranked(named).where(F.col("rank") <= top).unionByName(ranked(_pairs(groups, shares)))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Sum of differences of each two sources of a language, both ways.

    Were no term in either source, each kept one would add the difference of the absent shares. A term of one source adds
    what that leaves out, and a term of both corrects what the two have added apart.
    """
    other = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("other_absent"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    dealt = lambda rows, *by: rows.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
    apart = lambda rows: rows.join(other, ["lang", "part"]).where("source <> other").drop("part")
    wide = lambda c: c.cast("decimal(38,0)")
    nothing = F.abs(F.col("absent") - F.col("other_absent"))
    base = apart(dealt(groups, "source")).select("lang", "source", "other", wide(wide(nothing) * F.col("kept")).alias("value"))
    # rows of a histogram grow with different counts only
    histogram = shares.groupBy("lang", "source", "absent", "p").agg(F.count("*").alias("terms"))
    alone = apart(dealt(histogram, "source", "p")).groupBy("lang", "source", "other").agg(F.sum(wide((F.abs(F.col("p") - F.col("other_absent")) - nothing) * F.col("terms"))).alias("value"))
    alone = alone.select("lang", F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other")))).alias("pair"), "value").select("lang", "pair.*", "value")
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("absent").alias("other_absent"))
    met = shares.join(right, ["lang", "term"]).where("source < other")
    both = F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_absent")) - F.abs(F.col("other_p") - F.col("absent")) + nothing
    both = met.groupBy("lang", "source", "other").agg(F.sum(wide(both)).alias("value"))
    both = both.unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    added = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("value").cast("long").alias("value"))
    return added.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
