"""Chat formatting with typed content parts, reversible escapes and a loss mask.

A visitor flattens the parts of each turn in order: text is escaped, and image, audio and document
parts become numbered placeholders whose references and expanded token counts are recorded. A turn
is written as ``<|turn|>role\\n`` + body + ``<|end|>\\n``; only assistant bodies are under the loss
mask. Inside texts and roles the escape character is doubled and every control string is broken
by the escape character and a dash, so no text can forge a mark and reading back is exact.

Turns are formatted independently, and read back as a stream in turn order, so memory does not
grow with a conversation. Defined results: a null text or role is empty; rows with null ids form
one conversation; equal turn numbers (and null ones, which come first) are ordered by role, then
text; empty tables give empty results; unknown part types are kept as documents; of typed content, what is
not JSON, and parts that are no mappings, are text, and sizes that are no numbers count as the least.
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

ESCAPE = "␛"
TURN, END = "<|turn|>", "<|end|>"
#: Strings that texts must not contain as they are: this template's marks and those of common ones.
CONTROLS = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_BROKEN = re.compile(ESCAPE + "(.)", re.DOTALL)
_PLACE = re.compile(r"<\|(image|audio|document)_(\d+)\|>")


def escape(text: str, newlines: bool = False) -> str:
    """``text`` without control strings; ``unescape`` gives it back."""
    out = _CONTROL.sub(lambda m: m[0][0] + ESCAPE + "-" + m[0][1:], text.replace(ESCAPE, ESCAPE + ESCAPE))
    return out.replace("\n", ESCAPE + "n") if newlines else out


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda m: {"-": "", "n": "\n"}.get(m[1], m[1]), text)


def number(value, default: float) -> float:
    """A size as a number: itself, or the digits that a string begins with (``"12px"``); the default if there is none."""
    if isinstance(value, bool) or value is None:
        return default
    if isinstance(value, str):
        found = re.match(r"\s*\d+(?:\.\d+)?", value)
        value = float(found[0]) if found else default
    return float(value) if isinstance(value, int | float) and math.isfinite(value) else default


@dataclass
class Attachment:
    """A part that is not text: its number in the conversation, where it is and what it expands to."""

    number: int
    kind: str
    ref: str
    tokens: int


@dataclass
class PartVisitor:
    """Flattens typed parts in order; one visitor per conversation, so numbers run through it."""

    attachments: list[Attachment] = field(default_factory=list)
    image_tile: int = 512
    tokens_per_tile: int = 256
    audio_tokens_per_second: int = 25
    tokens_per_page: int = 1024

    def visit(self, parts: list) -> str:
        return "".join(self._visit(p) for p in parts)

    def _visit(self, part) -> str:
        """A part that is no mapping is text."""
        if not isinstance(part, dict):
            return escape("" if part is None else part if isinstance(part, str) else json.dumps(part, ensure_ascii=False))
        kind = part.get("type") or "text"
        return {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio}.get(kind if isinstance(kind, str) else "", self.visit_document)(part)

    def visit_text(self, part: dict) -> str:
        text = part.get("text")
        return escape("" if text is None else text if isinstance(text, str) else json.dumps(text, ensure_ascii=False))

    def visit_image(self, part: dict) -> str:
        tiles = [-(-max(int(number(part.get(side), 1)), 1) // self.image_tile) for side in ("width", "height")]
        return self._place("image", part, tiles[0] * tiles[1] * self.tokens_per_tile)

    def visit_audio(self, part: dict) -> str:
        return self._place("audio", part, -(-int(max(number(part.get("seconds"), 0), 0) * 1000) * self.audio_tokens_per_second // 1000))

    def visit_document(self, part: dict) -> str:
        return self._place("document", part, max(int(number(part.get("pages"), 1)), 1) * self.tokens_per_page)

    def _place(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append(Attachment(len(self.attachments) + 1, kind, str(part.get("ref") or ""), tokens))
        return f"<|{kind}_{len(self.attachments)}|>"


@dataclass
class Turn:
    """A formatted turn, and where in it the body stands."""

    text: str
    body_from: int
    body_to: int
    loss: bool


def format_turn(role: str, parts: list[dict], visitor: PartVisitor) -> Turn:
    head = TURN + escape(role, newlines=True) + "\n"
    body = visitor.visit(parts)
    return Turn(head + body + END + "\n", len(head), len(head) + len(body), role == "assistant")


def format_conversation(turns: list[tuple[str, list[dict]]]) -> tuple[str, list[tuple[int, int]], list[Attachment]]:
    """Formatted text, loss spans in code points, attachments."""
    visitor, out, spans, at = PartVisitor(), [], [], 0
    for role, parts in turns:
        turn = format_turn(role or "", parts, visitor)
        if turn.loss:
            spans.append((at + turn.body_from, at + turn.body_to))
        out.append(turn.text)
        at += len(turn.text)
    return "".join(out), spans, visitor.attachments


def read_back(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Turns of formatted text: role and parts, ``("text", ...)`` or ``(kind, number)``."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END + "\n", line)
        body, parts, k = formatted[line + 1 : stop], [], 0
        for place in _PLACE.finditer(body):
            if place.start() > k:
                parts.append(("text", unescape(body[k : place.start()])))
            parts.append((place[1], place[2]))
            k = place.end()
        if k < len(body):
            parts.append(("text", unescape(body[k:])))
        yield unescape(formatted[at + len(TURN) : line]), parts
        at = stop + len(END) + 1


def _in_order(rows: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """Rows of a conversation together and in order, in as many partitions as the session shuffles to."""
    picked = rows.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return picked.repartition(n, "key").sortWithinPartitions("key", "turn", "role", "content")


def _parts_of(content: str | None, typed: bool) -> list[dict]:
    if not typed:
        return [{"type": "text", "text": content}]
    try:
        value = json.loads(content) if content else []
    except ValueError:
        value = content  # not JSON, so it is text
    return value if isinstance(value, list) else [value]


def format_turns(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", typed: bool = False) -> DataFrame:
    """One row per turn in order: formatted text, its place in the conversation, loss span, attachments.

    With ``typed`` the content is a JSON array of parts. Concatenating ``formatted`` by ``position``
    gives the conversation; one is never held whole.
    """

    def run(batches):
        now, position, offset, visitor = None, 0, 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if visitor is None or row["key"] != now:
                    now, position, offset, visitor = row["key"], 0, 0, PartVisitor()
                before = len(visitor.attachments)
                t = format_turn(row["role"] or "", _parts_of(row["content"], typed), visitor)
                out.append({
                    "key": now, "position": position, "formatted": t.text, "char_from": offset, "loss": t.loss,
                    "loss_from": offset + t.body_from, "loss_to": offset + (t.body_to if t.loss else t.body_from),
                    "attachments": [vars(a) for a in visitor.attachments[before:]],
                    "expanded_tokens": sum(a.tokens for a in visitor.attachments[before:]),
                })
                position, offset = position + 1, offset + len(t.text)
            schema = _TURNS.set(0, pa.field("key", batch.schema.field("key").type))
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = dict(rows.dtypes)[key]
    ordered = _in_order(rows, key, turn, role, content)
    return ordered.mapInArrow(run, _TURNS_DDL.format(kind)).withColumnRenamed("key", key)


_ATTACHMENT = pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_TURNS = pa.schema([
    ("key", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("char_from", pa.int64()), ("loss", pa.bool_()),
    ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("attachments", pa.list_(_ATTACHMENT)), ("expanded_tokens", pa.int64()),
])
_TURNS_DDL = (
    "key {}, position long, formatted string, char_from long, loss boolean, loss_from long, loss_to long, "
    "attachments array<struct<number:long,kind:string,ref:string,tokens:long>>, expanded_tokens long"
)


def read_back_report(turns: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Digests per conversation, read back from formatted turns (the output of ``format_turns``).

    Turns of a conversation arrive in order in the partition that formatted them; running digests
    are all that is kept of a conversation.
    """

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["key"] != now["key"]:
                    if now is not None:
                        done.append(now)
                    now = {"key": row["key"], "n_turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
                for role, parts in read_back(row["formatted"]):
                    now["n_turns"] += 1
                    now["all"].update(f"{role}\n{''.join(v for k, v in parts if k == 'text')}\n".encode())
                if row["loss"]:
                    masked = row["formatted"][row["loss_from"] - row["char_from"] : row["loss_to"] - row["char_from"]]
                    text = unescape(_PLACE.sub("", masked))
                    now["loss_chars"] += len(text)
                    now["loss"].update(text.encode())
                now["formatted_chars"] += len(row["formatted"])
            yield _digested(done, batch.schema.field("key").type)
        if now is not None:
            yield _digested([now], batch.schema.field("key").type)

    kind = dict(turns.dtypes)[key]
    picked = turns.select(F.col(key).alias("key"), "formatted", "char_from", "loss", "loss_from", "loss_to")
    schema = f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)


def _digested(done: list[dict], key: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d["key"] for d in done], key),
            pa.array([d["n_turns"] for d in done], pa.int64()),
            pa.array([d["all"].hexdigest() for d in done], pa.string()),
            pa.array([d["loss_chars"] for d in done], pa.int64()),
            pa.array([d["loss"].hexdigest() for d in done], pa.string()),
            pa.array([d["formatted_chars"] for d in done], pa.int64()),
        ],
        names=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold another template's control strings."""
    spark = rows.sparkSession
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
