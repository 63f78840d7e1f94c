"""Byte-level BPE of whole texts from a tokenizer file, with what recurs kept.

Words are split off at single spaces between other characters: the pattern by which a byte-level tokenizer
cuts its texts always cuts there, and looks no further than the word. So each word is encoded once and kept
(bounded). A text with a space after other white space is encoded as a whole. Added tokens' strings in a text (as
``<|endoftext|>``) are found first, as the file's library finds them, and become their ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from lodestrata.llm.recent import Recent

CACHED_WORDS = 80_000
#: Fixed value: the pattern that byte-level tokenizers of this family cut by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_AFTER_SPACE = re.compile(r"\s |\0")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class ByteEncoder:
    """Encodes with the vocabulary of a ``tokenizers`` file; its merges must rank as their ids do."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec.get("normalizer") or cut["type"] != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only byte-level BPE without normaliser and prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that are taken as they stand")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = set(self.added)
        self.mark = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters, vocabulary = byte_letters(), model["vocab"]
        self.ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges must rank as their ids do")
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.words: dict[str, bytes] = Recent(self.ids, CACHED_WORDS)

    def ids(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit numbers, of a text without added tokens."""
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def runs(self, text: str) -> list[tuple[str, int | None]]:
        """The text as runs without added tokens, and these with their ids."""
        if self.mark is None or not (found := list(self.mark.finditer(text))):
            return [(text, None)]
        out, at = [], 0
        for m in found:
            out += [(text[at : m.start()], None), (m[0], self.added[m[0]])]
            at = m.end()
        return [r for r in [*out, (text[at:], None)] if r[0]]

    def split(self, text: str) -> list[str]:
        """Parts of a run that can be encoded apart, in order."""
        return [text] if _AFTER_SPACE.search(text) else text.replace(" ", "\0 ").split("\0")

    def _run(self, text: str) -> bytes:
        parts = self.split(text)
        return b"".join(map(self.words.__getitem__, parts)) if len(parts) > 1 else self.ids(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit numbers."""
        runs = self.runs(text)
        return self._run(text) if runs == [(text, None)] else b"".join(self._run(t) if i is None else np.array([i], "<u4").tobytes() for t, i in runs)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each token of a run; a character cut by tokens belongs to each."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(x) for x in self.encoding.decode_tokens_bytes(np.frombuffer(self.ids(text), "<u4").tolist())], dtype=np.int64)
        return character[np.concatenate(([0], ends[:-1]))] if len(ends) else ends, character[ends - 1] + 1 if len(ends) else ends


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One for each worker and file."""
    return ByteEncoder(path)
