"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<|turn|>" role LF text "<|end|>" LF

Texts are written as they are where the parser reads the same turn back;
otherwise they are escaped: a backslash is doubled, and each control string
gets a backslash after its first character, so that no control string, of this
template or of the other common ones listed, stands in a text.  Every rendered
turn is parsed again and compared with its source before it is handed on.

Turns are rendered where they lie; a conversation's turns then meet in order of
``turn``, and are folded as a stream: memory is bounded by one turn, however
long the conversation.  A digest over a conversation is sequential by nature,
so one conversation is one task's work.

Defined results: null text and null role are empty; null turns come first, and
turns that tie are in order of their rendered form; repeated rows are repeated
turns; null conv_ids are one conversation; no rows give none; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: What must not stand in a text: this template's marks, and control strings of other templates.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    """Until no control string is left: breaking one cannot make another, but the loop doesn't rely on it."""
    text = text.replace("\\", "\\\\")
    while _CONTROL.search(text):
        text = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


class ParseError(ValueError):
    pass


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """role, text, where the written text begins and ends, and where the turn ends."""
    if not rendered.startswith(OPEN, at):
        raise ParseError("a turn has to begin with its mark")
    begin = at + len(OPEN)
    line = begin
    while True:
        line = rendered.find("\n", line)
        if line < 0:
            raise ParseError("the role does not end")
        behind = len(rendered[begin:line]) - len(rendered[begin:line].rstrip("\\"))
        if behind % 2 == 0:
            break
        line += 1
    end = rendered.find(CLOSE + "\n", line + 1)
    if end < 0:
        raise ParseError("the text does not end")
    return unescaped(rendered[begin:line]), unescaped(rendered[line + 1 : end]), line + 1, end, end + len(CLOSE) + 1


def render_turn(role: str, text: str) -> str:
    name = escaped(role).replace("\n", "\\\n")
    for written in (text, None):
        if written is None:
            written = escaped(text)
        elif _CONTROL.search(written):
            continue
        rendered = f"{OPEN}{name}\n{written}{CLOSE}\n"
        try:
            if parse_turn(rendered)[:2] == (role, text) and parse_turn(rendered)[4] == len(rendered):
                return rendered
        except ParseError:
            pass
    raise ParseError("the turn cannot be rendered")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted: each turn's rendered form, verified by reparsing; no shuffle."""

    def render(batches):
        for b in batches:
            rows = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([render_turn(r or "", t or "") for r, t in rows], pa.string())], names=["conv_id", "turn", "formatted"])

    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(render, "conv_id long, turn long, formatted string")


class Digest:
    """What is read back from a conversation's rendered turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        at = 0
        while at < len(formatted):
            role, text, begin, end, at = parse_turn(formatted, at)
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":  # the loss mask covers [begin, end)
                read = unescaped(formatted[begin:end])
                self.loss_chars += len(read)
                self.loss.update(read.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, from its formatted turns alone."""

    def fold(batches):
        now: Digest | None = None
        for b in batches:
            rows = []
            for conv_id, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        rows.append(now.row())
                    now = Digest(conv_id)
                now.add(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), DIGESTS, strict=True)], schema=DIGESTS)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.row(), DIGESTS, strict=True)], schema=DIGESTS)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return dealt.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return read_back(format_turns(turns.unionByName(more)))
