"""Chat formatting of typed content parts.

The content of a turn is a text or a list of typed parts. A visitor walks over the parts in
order: text is escaped, and each image, audio clip or document becomes a placeholder, with its
reference and the number of tokens it stands for on record. A turn is marked by control strings;
where one occurs in a text or a role it is escaped, so a formatted turn reads back exactly.

Turns are formatted row by row. Reading a conversation back runs over turns sorted by
conversation and keeps running digests only, so its memory does not grow with a conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import packed

PARTS_DDL = ("array<struct<type:string,text:string,ref:string,width:int,height:int,"
             "seconds:double,pages:int>>")
TURN = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()),
    ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachment_tokens", pa.int64()),
    ("attachments", pa.list_(pa.struct([
        ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64()),
    ]))),
])
TURN_DDL = ("conv_id long, turn long, formatted string, loss_start long, loss_end long, "
            "attachment_tokens long, "
            "attachments array<struct<kind:string,ref:string,at:long,tokens:long>>")
DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
DIGEST_DDL = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long")


@dataclass(frozen=True)
class Template:
    """Control strings of a chat template and the token cost of attachments."""

    start: str = "<|turn|>"
    content: str = "<|content|>"
    end: str = "<|end|>\n"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    patch: int = 28
    audio_per_second: float = 25.0
    document_per_page: int = 512

    @property
    def controls(self) -> list[str]:
        marks = (self.start, self.content, self.end.rstrip("\n"), self.image, self.audio,
                 self.document)
        return [*marks, *self.reserved]


class Escape:
    """Replaces the backslash and every control string by a backslash and one sign."""

    def __init__(self, template: Template):
        self.code = {"\\": "\\\\"}
        self.code |= {c: "\\" + chr(97 + i) for i, c in enumerate(template.controls)}
        self.plain = {v: k for k, v in self.code.items()}
        longest_first = sorted(self.code, key=len, reverse=True)
        self.find = re.compile("|".join(map(re.escape, longest_first)))
        self.back = re.compile(r"\\.", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: self.code[m[0]], text)

    def unescape(self, text: str) -> str:
        return self.back.sub(lambda m: self.plain[m[0]], text)


class PartVisitor:
    """Flattens the typed parts of one turn into text with placeholders."""

    def __init__(self, template: Template, escape: Escape):
        self.template, self.escape = template, escape
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_unknown)(part)

    def _write(self, piece: str) -> None:
        self.out.append(piece)
        self.length += len(piece)

    def _attach(self, kind: str, mark: str, ref: str | None, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": ref, "at": self.length, "tokens": tokens})
        self._write(mark)

    def visit_text(self, part: dict) -> None:
        self._write(self.escape.escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = self.template.patch
        across = math.ceil((part.get("width") or side) / side)
        down = math.ceil((part.get("height") or side) / side)
        self._attach("image", self.template.image, part.get("ref"), across * down)

    def visit_audio(self, part: dict) -> None:
        tokens = math.ceil((part.get("seconds") or 0.0) * self.template.audio_per_second)
        self._attach("audio", self.template.audio, part.get("ref"), tokens)

    def visit_document(self, part: dict) -> None:
        tokens = (part.get("pages") or 1) * self.template.document_per_page
        self._attach("document", self.template.document, part.get("ref"), tokens)

    def visit_unknown(self, part: dict) -> None:
        """Any other type, and none: its text, if it has one, and a record without tokens."""
        self.attachments.append({"kind": part.get("type") or "unknown", "ref": part.get("ref"),
                                 "at": self.length, "tokens": 0})
        self.visit_text(part)


def format_turn(template: Template, escape: Escape, role: str, parts: list[dict]) -> tuple:
    """Formatted turn, where its content starts and ends, and its attachments."""
    visitor = PartVisitor(template, escape)
    head = template.start + escape.escape(role) + template.content
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.out)
    attachments = [a | {"at": a["at"] + len(head)} for a in visitor.attachments]
    return head + body + template.end, len(head), len(head) + len(body), attachments


def read_turn(template: Template, escape: Escape, formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay in the text as they are."""
    if not formatted.startswith(template.start) or not formatted.endswith(template.end):
        raise ValueError("not a formatted turn")
    role, mark, body = formatted[len(template.start):-len(template.end)].partition(
        template.content)
    if not mark:
        raise ValueError("a formatted turn without content mark")
    return escape.unescape(role), escape.unescape(body)


def format_turns(
    turns: DataFrame, template: Template = Template(), learned_role: str = "assistant",
    parts_col: str | None = None,
) -> DataFrame:
    """One formatted row per turn: text, loss span, attachments and the tokens they stand for.

    Needs the columns conv_id, turn, role and text; ``parts_col`` names an array of typed parts
    that is used instead of the text where it is not NULL. NULL text and NULL role count as
    empty, a NULL part is left out, and a part of another type, or none, gives its text and is
    recorded with 0 tokens. The loss mask covers the content of the learned role. Positions count
    code points in the formatted turn. Repeated turns stay repeated; an empty table gives an empty one.
    """
    packed.bounded_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = Escape(template)
        for b in packed.slices(batches):
            rows = []
            for r in b.to_pylist():
                role = r["role"] or ""
                parts = r["parts"]
                if parts is None:
                    parts = [{"type": "text", "text": r["text"]}]
                text, low, high, found = format_turn(template, escape, role, parts)
                learned = role == learned_role
                rows.append((r["conv_id"], r["turn"], text, low if learned else None,
                             high if learned else None, sum(a["tokens"] for a in found), found))
            columns = list(zip(*rows, strict=True)) or [()] * len(TURN)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, TURN, strict=True)], schema=TURN)

    parts = F.col(parts_col) if parts_col else F.lit(None)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        parts.cast(PARTS_DDL).alias("parts"),
    )
    return rows.mapInArrow(run, TURN_DDL)


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the formatted turns alone: number of turns and running digests.

    Turns run in the order of ``turn`` (NULL first), ties by role and text. One conversation is read by
    one task, since a digest of its turns in order is a sequence; memory stays constant.
    """
    packed.bounded_batches(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape, now, done = Escape(template), None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(DIGEST)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, DIGEST, strict=True)],
                schema=DIGEST)

        for b in batches:
            for r in b.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(r["conv_id"])
                role, text = read_turn(template, escape, r["formatted"])
                now.turns.update(f"{role}\n{text}\n".encode())
                now.n += 1
                now.chars += len(r["formatted"])
                if r["loss_start"] is not None:
                    learned = escape.unescape(r["formatted"][r["loss_start"]:r["loss_end"]])
                    now.loss.update(learned.encode())
                    now.loss_chars += len(learned)
            if len(done) >= packed.BATCH_ROWS:
                yield flush()
        if now is not None:
            done.append(now.row())
        yield flush()

    n = packed.partitions(formatted.sparkSession)
    ordered = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end")
    ordered = ordered.repartition(n, "conv_id").sortWithinPartitions(
        "conv_id", "turn", "formatted"
    )
    return ordered.drop("turn").mapInArrow(run, DIGEST_DDL)
