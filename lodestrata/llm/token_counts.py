"""Token counts of sections by offset mapping.

A document is encoded once, as a whole, so that a section's count is what it adds to the document's, not what it
would come to alone. Every token has a span of characters; spans and sections are two ordered lists of
intervals, which a merge (binary search of section starts) joins. A token that lies in several sections goes to
one of them by ``rule``: ``first`` or ``last`` that it touches, or ``most``, that with most of its characters,
of equal ones the first. So the sections' counts add up to the document's.

Sections are lines by default (a line ends with its newline); ``sections`` may be any function from a text to
the ascending starts of its sections, the first of them 0. ``fields_as_sections`` writes several columns as one
text of which each column is a section.

Defined cases: a null or empty text has one empty section with no tokens; repeated rows are counted each; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bytepair import ByteEncoder, encoder
from lodestrata.shipping import ship

RULES = ("first", "last", "most")
FIELD_END = "\n"


def line_starts(text: str) -> np.ndarray:
    """0, and the place after each newline that isn't the text's last character."""
    lengths = np.fromiter(map(len, text.split("\n")), np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts


def fields_as_sections(columns: Sequence[str]) -> tuple[Column, Column]:
    """A text of all the columns' texts, each closed by a newline, and the array of their starts."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    starts, at = [], F.lit(0)
    for v in values:
        starts.append(at)
        at = at + F.length(v) + len(FIELD_END)
    return F.concat(*[x for v in values for x in (v, F.lit(FIELD_END))]), F.array(*starts).cast("array<long>")


def _owner(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each span [first, end)."""
    low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, end - 1, "right") - 1
    if rule == "first":
        return low
    if rule == "last":
        return high
    out = low.copy()
    bounds = np.append(starts, np.iinfo(np.int64).max)
    for i in np.flatnonzero(low != high):
        inside = np.arange(low[i], high[i] + 1)
        overlap = np.minimum(bounds[inside + 1], end[i]) - np.maximum(bounds[inside], first[i])
        out[i] = inside[np.argmax(overlap)]
    return out


def attribute(e: ByteEncoder, text: str, starts: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens of each section."""
    counts, at = np.zeros(len(starts), np.int64), 0
    for run, added in e.runs(text):
        if added is None:
            _count(e, run, at, starts, rule, counts)
        else:
            counts[_owner(np.array([at]), np.array([at + len(run)]), starts, rule)[0]] += 1
        at += len(run)
    return counts


def _count(e: ByteEncoder, text: str, at: int, starts: np.ndarray, rule: str, counts: np.ndarray) -> None:
    """Adds to ``counts`` the tokens of a run that begins at ``at``."""
    parts = e.split(text)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes) + at
    begins = ends - sizes
    low = np.searchsorted(starts, begins, "right") - 1
    within = low == np.searchsorted(starts, np.maximum(ends - 1, begins), "right") - 1  # no section starts inside the part
    if len(parts) > 1:
        tokens = np.fromiter(map(len, map(e.words.__getitem__, parts)), np.int64, len(parts)) // 4
        counts += np.bincount(low[within], tokens[within], len(starts)).astype(np.int64)
    elif text:
        within[:] = False
    for i in np.flatnonzero(~within):
        first, end = e.spans(parts[i])
        counts += np.bincount(_owner(first + begins[i], end + begins[i], starts, rule), minlength=len(starts))


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "most", id_column: str = "doc_id", text: Column | str = "text", starts: Column | str | None = None, sections: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """(doc_id, section, start, length, n_tokens): for each section of each row, in characters and tokens.

    ``starts``, where given, is an array column of section starts and used instead of ``sections``.
    """
    import pyarrow as pa

    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, bounds, lengths, counts = [], [], [], []
            for i, (t, own) in enumerate(zip(batch.column("text"), batch.column("starts"), strict=True)):
                t = t.as_py() or ""
                own = own.as_py()
                s = sections(t) if own is None else np.array(own, np.int64)
                rows.append(np.full(len(s), i))
                bounds.append(s)
                lengths.append(np.diff(np.append(s, len(t))))
                counts.append(attribute(e, t, s, rule))
            number = np.concatenate([np.arange(len(r)) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(number, pa.int32()), *(pa.array(np.concatenate(x), pa.int64()) for x in (bounds, lengths, counts))], ["doc_id", "section", "start", "length", "n_tokens"])

    own = F.lit(None).cast("array<long>") if starts is None else (F.col(starts) if isinstance(starts, str) else starts)
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"), own.alias("starts"))
    return chosen.mapInArrow(run, "doc_id long, section int, start long, length long, n_tokens long")
