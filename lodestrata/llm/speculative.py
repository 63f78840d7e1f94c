"""BPE with word ends by speculation: greedy longest matches are proposed, pair checks verify them, and only words that fail are merged.

A text is cut at white space into chunks, which recur and are kept (bounded). A new chunk is normalised and cut
into words as the tokenizer file says, and all new words of a slice of texts are encoded together:

1. *Propose.* Each word is cut greedily into the longest tokens that re-merging leaves whole.
2. *Verify.* A sequence of such tokens is what BPE gives if and only if no merge ever reaches across a place between
   two of them. That is checked for all adjacent pairs of all words at once, on arrays: the later merge of the two
   neighbours is undone again and again, and wherever the two symbols then at the place make a pair, its rank tells
   whether it would have been merged before. Merges of one rank go from left to right.
3. *Merge.* Words with a place that fails are encoded by repeated best merge.

Ids, digests and decoded texts are those of the ``tokenizers`` library with the same file: strings of added tokens in
a text become their ids, and decoding joins the tokens' strings by single spaces, as the file names no decoder.

Defined cases: null text is empty; empty text and white space alone have no ids; a text may be one chunk of any length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bytepair import byte_letters
from lodestrata.llm.recent import LONGEST, Recent
from lodestrata.shipping import ship

CACHED_CHUNKS = 300_000
#: Characters of the texts that are encoded together.
SLICE = 4_000_000
#: Letters of the words that are merged together, round by round; longer words are merged one by one.
TOGETHER = 48
#: Fixed value: the words of texts in Latin letters up to U+017F, as the tokenizer file's pattern gives them.
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ſ²³¹¼-¾]+")
_NONE = 1 << 40


class _Table:
    """Numbers by number, looked up in arrays: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length() + 1)
        self.keys, self.values = np.full((1 << self.bits) + 1, -1, np.int64), np.zeros((1 << self.bits) + 1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slot[took]], self.values[slot[took]] = keys[left[took]], values[left[took]]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, slot = left[rest], self._next(slot[rest])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], missing)
        left = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = self._next(slot)
            held = self.keys[slot]
            met = held == keys[left]
            out[left[met]] = self.values[slot[met]]
            rest = ~met & (held >= 0)
            left, slot = left[rest], slot[rest]
        return out


class SpeculativeEncoder:
    """Encodes and decodes with one tokenizer file: BPE over byte letters with word ends.

    A word is an array of symbols: a letter's token, for the last letter that of the letter with the word's end.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("only BPE with a word end, without decoder and post-processor")
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError("only texts in lower case, cut by a pattern into byte letters")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only added tokens that are taken as they stand")
        library = Tokenizer.from_file(path)
        self.normalise, self.words_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in added}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        vocabulary = model["vocab"]
        n = self.size = 1 + max(*vocabulary.values(), *self.added.values())
        self.token = [""] * n
        for t, i in (vocabulary | self.added).items():
            self.token[i] = t
        letters = byte_letters()
        self.inner, self.final = np.full(1 + max(map(ord, letters)), -1, np.int64), np.full(1 + max(map(ord, letters)), -1, np.int64)
        for c in letters:
            self.inner[ord(c)], self.final[ord(c)] = vocabulary[c], vocabulary[c + end]
        self._read_merges(vocabulary, [m if isinstance(m, list) else m.split(" ") for m in model["merges"]])
        self._grow_tree()
        self.proposed = self.merged = 0  # words so far, and those of them that were merged

    def _read_merges(self, vocabulary: dict[str, int], merges: list[list[str]]) -> None:
        made = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        n = self.size
        self.rank = np.zeros(n, np.int64)  # of the merge that makes a token, from 1; 0 for single letters
        self.left, self.right = np.arange(n), np.arange(n)
        for r, (a, b, c) in enumerate(made, 1):
            if self.rank[c] or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError("each token must come from one merge, of tokens that were made before")
            self.rank[c], self.left[c], self.right[c] = r, a, b
        a, b, c = np.array(made, np.int64).T
        self.of_rank = np.concatenate(([-1], c))
        self.pairs = _Table(a * n + b, np.arange(1, len(made) + 1))
        self.pair_rank = {x * n + y: r for r, (x, y, _) in enumerate(made, 1)}
        self.whole = np.ones(n, bool)  # whether BPE leaves a token's own string as this token
        for (x, y, z), apart in zip(made, self.apart(a, b, np.arange(1, len(made) + 1)).tolist(), strict=True):
            self.whole[z] = apart and self.whole[x] and self.whole[y]

    def _grow_tree(self) -> None:
        """A tree of the whole tokens by their symbols; a node is numbered and holds the token that ends there, or -1."""
        symbols = [[i] for i in range(self.size)]
        for r in self.of_rank[1:].tolist():  # parts come before what is made of them
            symbols[r] = symbols[self.left[r]] + symbols[self.right[r]]
        child, ends = {}, [-1]
        for t in [*set(self.inner[self.inner >= 0].tolist()), *set(self.final[self.final >= 0].tolist()), *self.of_rank[1:].tolist()]:
            if self.whole[t]:
                node = 0
                for x in symbols[t]:
                    key = node * self.size + x
                    node = child.get(key, 0)
                    if not node:
                        node = child[key] = len(ends)
                        ends.append(-1)
                ends[node] = t
        self.ends = np.array(ends, np.int64)
        self.tree = _Table(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))

    def apart(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each two neighbours, whether no merge (of a rank under ``below``) reaches across the place between them."""
        a, b, result = a.copy(), b.copy(), np.ones(len(a), bool)
        below = np.full(len(a), _NONE, np.int64) if below is None else below.astype(np.int64)
        left = np.arange(len(a))
        while len(left):
            x, y = a[left], b[left]
            across = self.pairs.get(x * self.size + y, _NONE) < below[left]  # it would have been made before
            result[left[across]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~across & ((rx > 0) | (ry > 0))
            left, x, y, rx, ry = left[more], x[more], y[more], rx[more], ry[more]
            undo = rx > ry  # the left one was made later; of equal ones the right one, as the left one was merged first
            a[left[undo]] = self.right[x[undo]]
            b[left[~undo]] = self.left[y[~undo]]
            # the left symbol goes into its merge before a pair of the same rank that starts at it; the right one after
            below[left] = np.minimum(below[left], np.where(undo, rx, ry + 1))
        return result

    def propose(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest whole tokens of words that stand one after another, and where they start. No token goes beyond a last letter."""
        token, length = symbols.copy(), np.ones(len(symbols), np.int64)
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            node = self.tree.get(node * self.size + symbols[at + depth], 0)
            depth += 1
            ends = self.ends[node]
            met = (node > 0) & (ends >= 0)
            token[at[met]], length[at[met]] = ends[met], depth
            more = (node > 0) & (at + depth < len(symbols))
            at, node = at[more], node[more]
        steps, starts, here = length.tolist(), [], 0
        while here < len(steps):
            starts.append(here)
            here += steps[here]
        picked = np.array(starts, np.int64)
        return token[picked], picked

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids of a word by repeated best merge: the lowest rank first, of equal ones the leftmost."""
        ids, rank, n = list(symbols), self.pair_rank, self.size
        after, before, queue = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := rank.get(ids[i] * n + ids[after[i]])) is not None:
                heapq.heappush(queue, (r, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.of_rank[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def merge_together(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Ids of many words by the same rule, one merge of every word in each round."""
        width = int(size.max())
        columns = np.arange(width)
        ids = np.where(columns < size[:, None], symbols[np.minimum(first[:, None] + columns, len(symbols) - 1)], -1)
        lookup = lambda a, b: np.where((a >= 0) & (b >= 0), self.pairs.get(np.maximum(a, 0) * self.size + np.maximum(b, 0), _NONE), _NONE)
        ranks = np.full(ids.shape, _NONE)
        ranks[:, :-1] = lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        out, word = np.full(ids.shape, -1), np.arange(len(ids))
        while True:
            place = ranks.argmin(axis=1)  # the leftmost of the lowest
            best = ranks[np.arange(len(ids)), place]
            going = best < _NONE
            if not going.all():
                out[word[~going]] = ids[~going]
                ids, ranks, word, place, best = ids[going], ranks[going], word[going], place[going], best[going]
            if not len(ids):
                return [row[:k] for row, k in zip(out.tolist(), (out >= 0).sum(axis=1).tolist(), strict=True)]
            rows = np.arange(len(ids))
            shift = np.minimum(columns + (columns > place[:, None]), width - 1)
            last = ids[:, -1].copy()
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[rows[last >= 0], -1] = -1
            ranks[:, -1] = _NONE
            ids[rows, place] = self.of_rank[best]
            after = np.where(place + 1 < width, ids[rows, np.minimum(place + 1, width - 1)], -1)
            ranks[rows, place] = lookup(ids[rows, place], after)
            inner = place > 0
            ranks[rows[inner], place[inner] - 1] = lookup(ids[rows[inner], place[inner] - 1], ids[rows[inner], place[inner]])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in byte letters: proposed, verified and, where that fails, merged."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = self.inner[letters]
        symbols[first + size - 1] = self.final[letters[first + size - 1]]
        tokens, starts = self.propose(symbols)
        word = np.searchsorted(first, starts, "right") - 1
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, place = np.unique(tokens[inside] * self.size + tokens[inside + 1], return_inverse=True)
        fine = self.apart(pairs // self.size, pairs % self.size)[place]
        flat, stops = tokens.tolist(), np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        found = [flat[a:b] for a, b in pairwise(stops)]
        failed = np.unique(word[inside[~fine]])
        for low, high in ((0, 8), (8, 14), (14, TOGETHER)):
            some = failed[(size[failed] > low) & (size[failed] <= high)]
            if len(some):
                for w, ids in zip(some.tolist(), self.merge_together(symbols, first[some], size[some]), strict=True):
                    found[w] = ids
        for w in failed[size[failed] > TOGETHER].tolist():
            found[w] = self.merge(symbols[first[w] : first[w] + size[w]].tolist())
        self.proposed, self.merged = self.proposed + len(words), self.merged + len(failed)
        return found

    def cut(self, chunk: str) -> list[str | int]:
        """A chunk's words in byte letters, and the ids of added tokens."""
        if chunk.isalpha() and chunk.isascii():
            return [chunk.lower()]
        out: list[str | int] = []
        for run in self.mark.split(chunk) if "<|" in chunk else (chunk,):
            if run in self.added:
                out.append(self.added[run])
            elif run.isascii() and run.isprintable():
                out += _LATIN_WORDS.findall(run.lower())
            elif max(run) < "\u0180" and "\u0130" not in run:  # each of these is its own normal form
                out += [w.encode().decode("latin-1").translate(_LETTER) for w in _LATIN_WORDS.findall(run.lower())]
            else:
                out += [w for w, _ in self.words_of(self.normalise(run))]
        return out

    def encode_chunks(self, chunks: Iterable[str]) -> list[list[int]]:
        """Ids of chunks without white space, verified together."""
        parts = [self.cut(c) for c in chunks]
        words = list(dict.fromkeys(p for part in parts for p in part if p.__class__ is str))
        ids = dict(zip(words, self.encode_words(words), strict=True))
        ids |= {i: [i] for i in self.added.values()}
        return [ids[part[0]] if len(part) == 1 else [x for p in part for x in ids[p]] for part in parts]

    def encode(self, text: str | None) -> list[int]:
        return [x for ids in self.encode_chunks(c for c in chunks(text) if c) for x in ids]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.token[i] for i in ids])


_LETTER = {b: c for c, b in byte_letters().items()}


def chunks(text: str | None) -> list[str]:
    """The text cut at blanks, tabs and line ends, none of which is in a word; with empty strings where these adjoin."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if text else []


class TextDigests:
    """Digests of many texts, slice by slice; chunks' ids and decoded strings are kept, long ones for their slice only."""

    def __init__(self, path: str) -> None:
        self.model = encoder(path)
        self.kept = Recent(lambda chunk: None, CACHED_CHUNKS)

    def found(self, cuts: list[list[str]]) -> dict[str, tuple[bytes, str, int]]:
        """What each chunk of a slice comes to."""
        every, kept = set().union(*cuts), self.kept
        every.discard("")
        here = {c: kept[c] for c in every & kept.keys()}
        every -= here.keys()
        older = {c: kept.older[c] for c in every & kept.older.keys()}
        new = list(every - older.keys())
        decode, made = self.model.decode, older
        for c, ids in zip(new, self.model.encode_chunks(new), strict=True):
            made[c] = array("I", ids).tobytes(), decode(ids) + " " if ids else "", len(ids)
        for c, known in made.items():
            if len(c) <= LONGEST:
                kept.keep(c, known)
        here |= made
        here[""] = b"", "", 0
        return here

    def of(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text) of each text of a slice."""
        cuts = [chunks(t) for t in texts]
        here, out = self.found(cuts), []
        for cut in cuts:
            met = [here[c] for c in cut]
            decoded = "".join([m[1] for m in met])[:-1]
            out.append((sum([m[2] for m in met]), hashlib.sha256(b"".join([m[0] for m in met])).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> SpeculativeEncoder:
    """One for each worker and file."""
    return SpeculativeEncoder(path)


@lru_cache(maxsize=2)
def digests(path: str) -> TextDigests:
    return TextDigests(path)


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[list[str | None]]:
    """Runs of texts of at most ``size`` characters together, or of one longer text."""
    held, chars = [], 0
    for t in texts:
        n = len(t) if t else 0
        if held and chars + n > size:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += n
    if held:
        yield held


def encode_documents(docs: DataFrame, file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row's whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            e = encoder(file)
            ids = [e.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [e.decode(x) for x in ids]})

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, encoded and decoded."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = digests(file)
            made = [d for texts in slices(batch.column("text").to_pylist()) for d in kept.of(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
