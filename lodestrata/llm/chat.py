"""Chat formatting with typed content parts.

A conversation is one string: ``<s>``, then for each turn ``[INST]role`` newline text ``[/INST]``, and ``</s>``
at the end. What the texts (and roles) hold of the template's control strings is broken up by an escape mark
and restored on reading, so a formatted string has exactly one reading (``read_back``).

A turn's content is plain text or a list of typed parts (kind, text, ref, size). A visitor with one method for
each kind flattens the parts in order: text stays, an image, audio clip or document becomes a numbered
placeholder ``<|kind:n|>``; the attachment is recorded with its reference, its place in the string and the
number of tokens into which a model expands it.

Defined cases: null text, role or list of parts is empty; a part of an unknown kind is an error; turns of equal
number are ordered by role, then text, so repeated rows are kept, one after the other; an empty table gives an
empty result; only the named columns are read, so others may have any name. One conversation is one string and
so is made in one task; conversations of one id are the only group, pre-sorted nowhere, as they are short by
nature (their text must fit a row in any case).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.shipping import ship

OPEN, CLOSE, TURN, END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (OPEN, CLOSE, TURN, END, "<<SYS>>", "<</SYS>>", "<|")
ESCAPE = "␛"  # itself written ESCAPE + "0"; ESCAPE + "1" breaks up a control string
_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
PARTS = "array<struct<kind:string,text:string,ref:string,size:double>>"
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,length:long>>, attachments array<struct<kind:string,ref:string,turn:long,at:long,tokens:long>>, expanded_tokens long, n_turns long"


def escape(text: str) -> str:
    """The text without any control string; ``unescape`` gives it back."""
    return _BREAK.sub(lambda m: m[0] + ESCAPE + "1", text.replace(ESCAPE, ESCAPE + "0"))


def unescape(text: str) -> str:
    return text.replace(ESCAPE + "1", "").replace(ESCAPE + "0", ESCAPE)


class Flatten:
    """Visits a turn's parts in order. ``tokens``: kind to a function from a part's size to its token count.

    Sizes: an image's pixels, an audio clip's seconds, a document's pages.
    """

    tokens = {"image": lambda pixels: math.ceil(pixels / 784), "audio": lambda seconds: math.ceil(seconds * 25), "document": lambda pages: math.ceil(pages) * 1024}

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []
        self.said: list[str] = []  # adjacent texts, escaped together: a control string may lie across two of them

    def write(self, piece: str) -> None:
        for x in (escape("".join(self.said)), piece):
            self.pieces.append(x)
            self.length += len(x)
        self.said.clear()

    def visit(self, part: dict, turn: int) -> None:
        method = getattr(self, f"visit_{part['kind']}", None)
        if method is None:
            raise ValueError(f"unknown kind of content part: {part['kind']!r}")
        method(part, turn)

    def visit_text(self, part: dict, turn: int) -> None:
        self.said.append(part["text"] or "")

    def attach(self, part: dict, turn: int) -> None:
        self.write("")
        size = part["size"]
        tokens = self.tokens[part["kind"]](size if size and math.isfinite(size) and size > 0 else 1)
        self.attachments.append({"kind": part["kind"], "ref": part["ref"], "turn": turn, "at": self.length, "tokens": tokens})
        self.write(f"<|{part['kind']}:{len(self.attachments) - 1}|>")

    visit_image = visit_audio = visit_document = attach


def format_turns(turns: list[tuple[int, str | None, str | None, list[dict] | None]]) -> dict:
    """turns, in order: (number, role, text, parts). Loss: the spans of what assistants say, as escaped."""
    out, loss = Flatten(), []
    out.write(OPEN)
    for number, role, text, parts in turns:
        out.write(f"{TURN}{escape(role or '').replace(chr(10), ESCAPE + '2')}\n")
        start = out.length
        out.visit({"kind": "text", "text": text}, number)
        for part in parts or ():
            out.visit(part, number)
        out.write("")
        if role == "assistant":
            loss.append({"start": start, "length": out.length - start})
        out.write(END)
    out.write(CLOSE)
    return {"formatted": "".join(out.pieces), "loss": loss, "attachments": out.attachments, "expanded_tokens": sum(a["tokens"] for a in out.attachments), "n_turns": len(turns)}


def read_back(formatted: str, attachments: list[dict] | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; placeholders of attachments are taken out of the text."""
    body = formatted.removeprefix(OPEN).removesuffix(CLOSE)
    return [(unescape(m[1].replace(ESCAPE + "2", "\n")), unescape(_PLACEHOLDER.sub("", m[2]))) for m in _TURN.finditer(body)]


def masked(formatted: str, loss: list[dict]) -> str:
    """All text under the loss mask, unescaped, without placeholders."""
    return "".join(unescape(_PLACEHOLDER.sub("", formatted[x["start"] : x["start"] + x["length"]])) for x in loss)


def format_chats(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """conv_id, formatted, loss, attachments, expanded_tokens, n_turns for each conversation of conv_id, turn, role, text (and a list of parts)."""
    ship(turns.sparkSession)
    extra = F.col(parts).cast(PARTS) if parts else F.lit(None).cast(PARTS)
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"), extra.alias("parts")).alias("said"))
    grouped = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [format_turns([(t["turn"], t["role"], t["text"], None if t["parts"] is None else list(t["parts"])) for t in said]) for said in batch["said"]]
            frame = pd.DataFrame(made, columns=["formatted", "loss", "attachments", "expanded_tokens", "n_turns"])
            frame.insert(0, "conv_id", batch["conv_id"].to_numpy() if len(batch) else [])
            yield frame

    return grouped.mapInPandas(form, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when they are read back: digests of all turns and of the text under the loss mask."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(batch["conv_id"], batch["formatted"], batch["loss"], strict=True):
                turns, learnt = read_back(text), masked(text, loss)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
