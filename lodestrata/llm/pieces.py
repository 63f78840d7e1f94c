"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A text becomes ``▁`` + text with spaces as ``▁``. No piece of the vocabulary has a ``▁`` after another
character, and for many other pairs of characters no piece has the two side by side; merges never cross such a
place, so a text is cut there and each cut part, which recurs often, is encoded once and kept (bounded cache).

A part is encoded by backtracking. An Aho-Corasick automaton gives the pieces that start at each position. From
the left, the longest piece is tried first; it may follow the previous piece only if re-merging the two
together gives back just these two (answers are kept by pair). Where no piece fits, the position goes into a
bitfield of failed positions and the previous piece is replaced by its next shorter one; a position that has
failed is never entered again, so the work is linear in the part's length.

Re-merging follows the library: of all adjacent pairs whose concatenation is a piece, the one with the best
score is merged first, of equal ones the leftmost. Runs of several ``▁`` have equally scored pieces, which pair
checks alone can't order; parts with such runs are encoded by re-merging as a whole. A character that is in no
piece becomes its UTF-8 bytes' pieces. The vocabulary file is read from a path parameter by every worker.

Defined cases: null text is empty; empty text has no ids; control pieces in a text are ordinary characters.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.recent import Recent
from lodestrata.shipping import ship

SPACE = "▁"
CACHED_CHUNKS = 250_000
CACHED_PARTS = 250_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + n]
        at += n


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict[str, int]]:
    """Pieces (text, score, type) and the settings of a SentencePiece model file."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, settings = [], {"model_type": 1, "add_dummy_prefix": 1, "remove_extra_whitespaces": 1, "escape_whitespaces": 1, "byte_fallback": 0, "charsmap": 0}
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
        elif number == 2:
            x = dict(_fields(value))
            settings |= {"model_type": x.get(3, 1), "byte_fallback": x.get(35, 0)}
        elif number == 3:
            x = dict(_fields(value))
            settings |= {"add_dummy_prefix": x.get(3, 1), "remove_extra_whitespaces": x.get(4, 1), "escape_whitespaces": x.get(5, 1), "charsmap": len(x.get(2, b""))}
    return pieces, settings


class PieceEncoder:
    """Encodes and decodes with one model. Only BPE with byte fallback, without normalisation, is accepted."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        pieces, settings = read_model(path)
        if settings != {"model_type": 2, "add_dummy_prefix": 1, "remove_extra_whitespaces": 0, "escape_whitespaces": 1, "byte_fallback": 1, "charsmap": 0} or any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("only BPE models with byte fallback, dummy prefix and no normalisation or symbols of the user's")
        self.text = [p for p, _, _ in pieces]
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.byte = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.special = {self.unknown, *self.silent, *self.byte_of}
        self.known = {c for p in self.id for c in p}
        self.adjacent = {a + b for p in self.id for a, b in pairwise(p)}
        if any(x[1] == SPACE != x[0] for x in self.adjacent):
            raise ValueError("a piece has a space inside")
        self.pairs: dict[int, bool] = {}
        # A piece that re-merging splits can't be part of any encoding.
        self.whole = {p for p in self.id if len(p) <= 2 or self.merge(p) == [self.id[p]]}
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, (self.id[p], len(p)))
        self.automaton.make_automaton()

    def merge(self, part: str) -> list[int]:
        """Ids by repeated best merge."""
        n, symbols = len(part), list(part)
        after, before, alive, queue = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n, []

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right >= 0 and (s := self.score.get(both := symbols[left] + symbols[right])) is not None:
                heapq.heappush(queue, (-s, left, right, len(both)))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, left, right, size = heapq.heappop(queue)
            if not (alive[left] and alive[right]) or after[left] != right or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            alive[right] = False
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [x for i in range(n) if alive[i] for x in ([self.id[symbols[i]]] if symbols[i] in self.id else [self.byte[b] for b in symbols[i].encode()])]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when they stand side by side."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.text[left], self.text[right]
            known = self.pairs[key] = self.merge(a + b) == [left, right]
        return known

    def backtrack(self, part: str) -> list[int]:
        n, starts = len(part), [[] for _ in part]
        for end, piece in self.automaton.iter(part):
            starts[end - piece[1] + 1].append(piece)  # ends come in order: longer ones later
        pairs, failed = self.pairs, 0  # failed, bit i: no encoding of the rest starts at i
        ids: list[int] = []
        choice: list[int] = []  # for each id, its place among the pieces that start there
        at, last, options = 0, -1, starts[0]
        left = len(options) - 1
        while at < n:
            while left >= 0:
                token, size = options[left]
                if not failed or not failed >> (at + size) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | token)
                    if self.fits(last, token) if fits is None else fits:
                        break
                left -= 1
            if left >= 0:
                ids.append(token)
                choice.append(left)
                at += size
                last = token
                if at < n:
                    options = starts[at]
                    left = len(options) - 1
            else:
                if not ids:
                    return self.merge(part)
                failed |= 1 << at
                at -= len(self.text[ids.pop()])
                left, options, last = choice.pop() - 1, starts[at], ids[-1] if ids else -1
        return ids

    def part(self, part: str) -> list[int]:
        """Ids of a part within which any two neighbours stand side by side in some piece."""
        if part[0] not in self.known:
            return [self.byte[b] for b in part.encode()]
        return self.merge(part) if SPACE * 2 in part else self.backtrack(part)

    def cut(self, chunk: str) -> list[str]:
        """The chunk's parts: runs of letters and single other characters, joined where some piece spans the place."""
        parts: list[str] = []
        for run in _RUN.findall(chunk):
            if parts and parts[-1][-1] + run[0] in self.adjacent:
                parts[-1] += run
            else:
                parts.append(run)
        if not self.known.issuperset(chunk):  # characters of no piece stand alone
            parts = [x for p in parts for x in ([p] if self.known.issuperset(p) else _around(p, self.known))]
        return parts

    def chunk(self, chunk: str) -> list[int]:
        return [x for part in self.cut(chunk) for x in self.part(part)]

    def encode(self, text: str) -> list[int]:
        return [x for c in _chunks(text) for x in self.chunk(c)] if text else []

    def decode(self, ids: list[int]) -> str:
        """As the library: byte pieces gather into UTF-8, of which bad bytes become U+FFFD each; one leading space goes."""
        if self.special.isdisjoint(ids):
            return "".join([self.text[x] for x in ids]).removeprefix(SPACE).replace(SPACE, " ")
        out, raw, first = [], bytearray(), True
        for x in [*ids, -1]:
            if x in self.byte_of:
                raw.append(self.byte_of[x])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                first = False
            if x < 0 or x in self.silent:
                continue
            piece = " ⁇ " if x == self.unknown else self.text[x]
            if first and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out)


_RUN = re.compile(rf"{SPACE}*[^\W\d_]+|[\W\d_]")
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _around(part: str, known: set[str]) -> list[str]:
    """The part's runs of known characters, and each other character alone."""
    return [x for of, run in groupby(part, known.__contains__) for x in (["".join(run)] if of else run)]


def _chunks(text: str) -> list[str]:
    return _CHUNK.findall((SPACE + text).replace(" ", SPACE))


def _utf8(raw: bytes) -> str:
    """Every byte that is not part of a whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def digests(path: str) -> TextDigests:
    return TextDigests(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker and model."""
    return PieceEncoder(path)


class TextDigests:
    """Digests of many texts. What chunks and their parts come to is kept: ids as written in the digest, decoded text, number of ids."""

    def __init__(self, path: str) -> None:
        self.model = encoder(path)
        self.before = self.model.id["a"]
        self.chunks, self.parts = Recent(self.chunk, CACHED_CHUNKS), Recent(self.part, CACHED_PARTS)

    def part(self, part: str) -> tuple[str, str, int]:
        ids = self.model.part(part)
        # A piece before it keeps decode() from taking the leading space.
        return "," + ",".join(map(str, ids)), self.model.decode([self.before, *ids])[1:], len(ids)

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        found = [self.parts[p] for p in self.model.cut(chunk)]
        return found[0] if len(found) == 1 else ("".join([x[0] for x in found]), "".join([x[1] for x in found]), sum([x[2] for x in found]))

    def of(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text) of a text."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        if "  " in text or SPACE in text or text[0] == " ":
            cut = _chunks(text)
        else:
            cut = (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        found = list(map(self.chunks.__getitem__, cut))
        ids = "".join([x[0] for x in found])[1:]
        decoded = "".join([x[1] for x in found])
        return sum([x[2] for x in found]), hashlib.sha256(ids.encode("ascii")).hexdigest(), hashlib.sha256(decoded[1:].encode()).hexdigest()


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row's whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            e = encoder(model)
            ids = [e.encode(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [e.decode(x) for x in ids]})

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, encoded and decoded."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = digests(model)
            made = [kept.of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
