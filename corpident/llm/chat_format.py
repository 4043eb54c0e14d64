"""Chat formatting over typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) in order: text is
escaped, other parts become one placeholder each, and their references and expanded token
counts are recorded beside the text. Turns are formatted independently of one another, in
the tasks that read them; nothing gathers a conversation. Reading back goes over rows sorted
by conversation and turn as a stream: it holds one turn, whatever the conversation's length.

Template: <|im_start|>ROLE newline TEXT <|im_end|> newline. Control strings inside texts and
roles are escaped by a backslash between < and | (one more where some stand there already),
line breaks and backslashes in roles as a backslash and n, and two backslashes; all can be undone.

Nulls and edge cases: null roles and texts are empty; null turns come first; equal turns go
by role, then text; rows with a null conversation id form one conversation; repeated rows are
turns of their own; a null part, or one of unknown kind, is left out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
TURN = "conv_id long, turn long, role string, formatted string, spans array<struct<start: int, stop: int>>, attachments array<struct<at: int, kind: string, ref: string, tokens: int>>, n_tokens long"
#: Tokens that parts expand to: an image tile of so many pixels a side, a second, a page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 28, 1, 25, 1500

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Visitor:
    """Collects a turn's content part by part."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict | None) -> None:
        handle = getattr(self, f"visit_{part['kind']}", None) if part and part["kind"] else None
        if handle:
            handle(part)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"at": self.size, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})
        self.tokens += tokens
        self._add(f"<|{part['kind']}|>")

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self.tokens += len(text.split())
        self._add(escape(text))

    def visit_image(self, part: dict) -> None:
        side = lambda n: max(1, -(-(n or 0) // TILE))
        self._attach(part, side(part["width"]) * side(part["height"]) * TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, int(-(-(part["seconds"] or 0.0) * SECOND_TOKENS // 1))))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part["pages"] or 0) * PAGE_TOKENS)


def format_turn(role: str | None, parts: list[dict | None]) -> tuple[str, list[dict], list[dict], int]:
    """The formatted turn, its spans under the loss mask, its attachments, its tokens. Places are code points."""
    role, seen = role or "", Visitor()
    for part in parts:
        seen.visit(part)
    head, body = f"{START}{escape_role(role)}\n", "".join(seen.out)
    for a in seen.attachments:
        a["at"] += len(head)
    spans = [{"start": len(head), "stop": len(head) + len(body)}] if role == "assistant" else []
    return f"{head}{body}{END}\n", spans, seen.attachments, seen.tokens


def text_part(text: Column) -> Column:
    """One text part, as the array of parts that format_turns() takes."""
    n = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), n("string").alias("ref"), n("int").alias("width"), n("int").alias("height"), n("double").alias("seconds"), n("int").alias("pages")))


def format_turns(turns: DataFrame, parts: Column | None = None) -> DataFrame:
    """turns: conv_id, turn, role, and text, or parts as an array of PART. One row per turn, see TURN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turn(role, p or []) for role, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            formatted, spans, attached, tokens = map(list, zip(*done)) if done else ([], [], [], [])
            span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
            item = pa.struct([("at", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(formatted, pa.string()), pa.array(spans, pa.list_(span)), pa.array(attached, pa.list_(item)), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "formatted", "spans", "attachments", "n_tokens"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", (text_part(F.col("text")) if parts is None else parts).alias("parts"))
    return rows.mapInArrow(run, TURN)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text as they were before format_turn (placeholders stay)."""
    if not (formatted.startswith(START) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted: as format_turns() gives. Per conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, all taken from the formatted text and its mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> tuple:
            n, turns, chars, loss, formatted_chars = state
            return (now[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars)

        for batch in batches:
            out = []
            for conv, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                for s in spans:
                    own = unescape(text[s["start"] : s["stop"]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(text)
            yield _rows(out, names)
        if now is not None:
            yield _rows([row()], names)

    order = ["conv_id", "turn", "role", "formatted"]
    rows = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "spans")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
