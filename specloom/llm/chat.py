"""Chat formatting with typed content parts.

A visitor flattens text, image, audio and document parts into ordered placeholders and records each attachment's reference and
the tokens it expands to. A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts are escaped reversibly:
``<|`` can only be written by the template, since ``<``, some backslashes and ``|`` in a text gain one backslash.

Rows are dealt by conversation and sorted by turn, and each conversation is read as a stream: no conversation is gathered in memory, however long.
Null texts and roles are empty. Equal turn numbers are ordered by role, then text; repeated rows stay repeated turns. A null conversation id
is a conversation of its own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flat:
    text: str = ""
    attachments: list = field(default_factory=list)


class Flatten:
    """Visits typed parts in order. Token rules: an image has one per 28 x 28 patch, audio 25 a second (rounded up), a document 256 a page."""

    def visit(self, parts: list[dict]) -> Flat:
        out = Flat()
        for p in parts:
            getattr(self, f"on_{p.get('type')}", self.on_other)(p, out)
        return out

    def on_text(self, p: dict, out: Flat) -> None:
        out.text += escape(str(p.get("text") or ""))

    def on_image(self, p: dict, out: Flat) -> None:
        self.attach("image", p, math.ceil((p.get("width") or 28) / 28) * math.ceil((p.get("height") or 28) / 28), out)

    def on_audio(self, p: dict, out: Flat) -> None:
        self.attach("audio", p, math.ceil((p.get("seconds") or 0) * 25), out)

    def on_document(self, p: dict, out: Flat) -> None:
        self.attach("document", p, 256 * int(p.get("pages") or 1), out)

    def on_other(self, p: dict, out: Flat) -> None:
        raise ValueError(f"unknown part type {p.get('type')!r}")

    def attach(self, kind: str, p: dict, tokens: int, out: Flat) -> None:
        out.text += f"<|{kind}|>"
        out.attachments.append({"kind": kind, "ref": str(p.get("ref") or ""), "tokens": tokens})


def turn_text(role: str | None, parts: list[dict]) -> tuple[str, int, int, list]:
    """(formatted turn, begin and end of its content, attachments)."""
    flat = Flatten().visit(parts)
    head = f"{START}{_role(role or '')}\n"
    return head + flat.text + END + "\n", len(head), len(head) + len(flat.text), flat.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, content) of one formatted turn, unescaped."""
    if not formatted.startswith(START) or not formatted.endswith(END + "\n"):
        raise ValueError("not a turn")
    role, _, content = formatted[len(START) : -len(END) - 1].partition("\n")
    if START in content or END in content:
        raise ValueError("a control string inside a turn")
    return _unrole(role), unescape(content)


TURNS = "conv_id long, n long, formatted string, char_start long, content_start long, content_end long, in_loss boolean, expanded_tokens long, attachments array<struct<kind: string, ref: string, tokens: long>>"
_OUT = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("formatted", pa.string()), ("char_start", pa.int64()), ("content_start", pa.int64()), ("content_end", pa.int64()), ("in_loss", pa.bool_()), ("expanded_tokens", pa.int64()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """Formatted turns in order, each with its place in the conversation's text; content of ``loss_role`` is under the loss mask.

    ``parts_col`` names a column with a JSON list of typed parts; without it, or where it is null, the text is the only part.
    Rows of a conversation stay together and in order in one partition.
    """
    _runtime.ship(rows.sparkSession)
    parts = F.col(parts_col).cast("string") if parts_col else F.lit(None).cast("string")
    laid = rows.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"), parts.alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, at = object(), 0, 0
        for b in batches:
            out = []
            for c, r, x, p in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if c != now:
                    now, n, at = c, 0, 0
                formatted, a, z, attached = turn_text(r, json.loads(p) if p else [{"type": "text", "text": x}])
                out.append((c, n, formatted, at, at + a, at + z, r == loss_role, sum(y["tokens"] for y in attached), attached))
                n, at = n + 1, at + len(formatted)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 9, _OUT.types)], schema=_OUT)

    return laid.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(run, TURNS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIG = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest(turns: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the output of ``format_turns`` as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = object()
        state: list | None = None

        def close(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 6, _DIG.types)], schema=_DIG)

        for b in batches:
            rows = []
            for c, formatted, begin, end, start, loss in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 5, 3, 6))):
                if state is None or c != now:
                    if state:
                        rows.append(close(state))
                    now, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    masked = unescape(formatted[begin - start : end - start])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(formatted)
            yield batch(rows)
        if state:
            yield batch([close(state)])

    return turns.mapInArrow(run, DIGEST)
