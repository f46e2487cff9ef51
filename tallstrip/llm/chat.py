"""Chat formatting of typed content parts.

A visitor flattens the parts of each turn into text with ordered placeholders, records what the placeholders refer to
and how many tokens they expand to, and escapes control strings inside texts so that the template can be read back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: the strings that only the template itself may write.
OPEN_USER, CLOSE_USER = "[INST]", "[/INST]"
OPEN_ASSISTANT, CLOSE_ASSISTANT = "<s>", "</s>"
OPEN_OTHER, MIDDLE_OTHER, CLOSE_OTHER = "[ROLE]", "[/ROLE]", "[/TURN]"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROL = (OPEN_USER, CLOSE_USER, OPEN_ASSISTANT, CLOSE_ASSISTANT, OPEN_OTHER, MIDDLE_OTHER, CLOSE_OTHER, *PLACEHOLDERS.values())

_control = re.compile("|".join(map(re.escape, CONTROL)))
_escaped = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes are doubled and each control string gets one after its first character; no control string is left."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Params:
    """Tokens a placeholder expands to: per image tile and per tile_px pixels of either side, per second of audio, per
    page of a document."""

    image_tokens: int = 85
    tile_px: int = 512
    audio_tokens: int = 25
    page_tokens: int = 600


@dataclass
class Visitor:
    """Visits parts in order; out holds the escaped text so far."""

    params: Params
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.expanded += tokens
        self.out.append(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        tiles = -(-max(1, part.get("width") or 1) // self.params.tile_px) * -(-max(1, part.get("height") or 1) // self.params.tile_px)
        self._attach("image", part, tiles * self.params.image_tokens)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, -int(-(part.get("seconds") or 0) // 1)) * self.params.audio_tokens)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.params.page_tokens)


def format_turn(role: str | None, parts: list[dict], params: Params) -> tuple[str, int, int, Visitor]:
    """The turn in the template, and where the text under the loss mask starts and ends in it (equal: none)."""
    visitor = Visitor(params)
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.out)
    if role == "user":
        return OPEN_USER + body + CLOSE_USER, 0, 0, visitor
    if role == "assistant":
        return OPEN_ASSISTANT + body + CLOSE_ASSISTANT, len(OPEN_ASSISTANT), len(OPEN_ASSISTANT) + len(body), visitor
    return OPEN_OTHER + escape(role or "") + MIDDLE_OTHER + body + CLOSE_OTHER, 0, 0, visitor


_turn = re.compile("|".join((rf"{re.escape(OPEN_USER)}(?P<user>.*?){re.escape(CLOSE_USER)}", rf"{re.escape(OPEN_ASSISTANT)}(?P<assistant>.*?){re.escape(CLOSE_ASSISTANT)}", rf"{re.escape(OPEN_OTHER)}(?P<role>.*?){re.escape(MIDDLE_OTHER)}(?P<other>.*?){re.escape(CLOSE_OTHER)}")), re.DOTALL)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay as they are. Fails if anything stands between turns."""
    at = 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            yield "user", unescape(m["user"])
        elif m["assistant"] is not None:
            yield "assistant", unescape(m["assistant"])
        else:
            yield unescape(m["role"]), unescape(m["other"])
        at = m.end()


TURN_SCHEMA = "conv_id bigint, turn bigint, role string, formatted string, loss_from int, loss_to int, attachments array<struct<ordinal: int, kind: string, ref: string, tokens: bigint>>, expanded_tokens bigint"


def format_turns(conversations: DataFrame, params: Params = Params(), *, content: str = "text", parts: bool = False) -> DataFrame:
    """One row per turn in the template; a conversation's text is its turns' one after another.

    content: the column of the turn's content; with parts=True it holds a JSON list of parts such as
    {"type": "text", "text": ...}, {"type": "image", "ref": ..., "width": ..., "height": ...},
    {"type": "audio", "ref": ..., "seconds": ...}, {"type": "document", "ref": ..., "pages": ...}; otherwise it is one
    text part. loss_from and loss_to count code points of the turn's formatted text. A null or empty content is an
    empty text, a null role an empty role; an unknown part type raises. Repeated turns stay, each as its own row; no
    rows give no rows; other columns are not read.
    """

    def work(frames):
        for frame in frames:
            rows = []
            for conv, turn, role, said in frame.itertuples(index=False):
                said = None if said is None or said != said else said
                role = None if role is None or role != role else role
                formatted, a, b, visitor = format_turn(role, (json.loads(said) if said else []) if parts else [{"type": "text", "text": said}], params)
                rows.append((conv, turn, role, formatted, a, b, visitor.attachments, visitor.expanded))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "formatted", "loss_from", "loss_to", "attachments", "expanded_tokens"])

    picked = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col(content).cast("string").alias("content"))
    keyed = picked.withColumns({"conv_id": F.coalesce("conv_id", F.lit(-(1 << 63) + 1)), "turn": F.coalesce("turn", F.lit(-(1 << 63) + 1))})
    out = keyed.mapInPandas(work, TURN_SCHEMA)
    return out.withColumns({c: F.nullif(F.col(c), F.lit(-(1 << 63) + 1)) for c in ("conv_id", "turn")})


def in_order(turns: DataFrame) -> DataFrame:
    """Turns dealt by conversation and sorted within: a reader streams a conversation of any length in constant memory."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
