"""Conversations formatted by a compiled template, and read back from what was written."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.chat_template import compile_template, unescape

#: Marks turns; roles and texts are escaped, and only what assistants say is in the loss mask.
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | control }}{% endgeneration %}{% else %}{{ m.text | control }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
#: Characters after which a conversation goes on in another part, at a place between two pieces.
PART_CHARS = 1_000_000
PARTS = "conv_id bigint, part int, formatted string, loss array<struct<start:int,end:int>>"
SUMMARY = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS, partitions: int | None = None) -> DataFrame:
    """Each conversation of ``turns`` (conv_id, turn, role, text) as formatted text: rows of PARTS.

    One row per conversation, or more, numbered by ``part`` and to be joined in
    that order, where it is longer than ``part_chars``; ``loss`` are the spans
    of the loss mask in the part (code points). One shuffle by ``conv_id``; turns
    stream through the template in the order (turn, role, text), nulls first, so
    that no conversation is held whole and ties have one order. Null roles and
    texts are empty strings; rows without ``conv_id`` are one conversation. Other
    columns are ignored, repeated rows are turns of their own, no rows give none.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = compile_template(template)
        out: list[tuple] = []
        size = 0
        for row in _parts(_turns(batches), written, part_chars):
            out.append(row)
            size += len(row[2])
            if size > 4 * PART_CHARS or len(out) >= 4096:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return rows.mapInArrow(run, PARTS)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _parts(turns: Iterator[tuple], written, part_chars: int) -> Iterator[tuple]:
    for conv, group in groupby(turns, lambda t: t[0]):
        part, pieces, spans, at = 0, [], [], 0
        for piece, loss in written(messages=({"role": r or "", "text": x or ""} for _, r, x in group)):
            if at > part_chars:
                yield conv, part, "".join(pieces), spans
                part, pieces, spans, at = part + 1, [], [], 0
            if loss:
                spans.append((at, at + len(piece)))
            pieces.append(piece)
            at += len(piece)
        yield conv, part, "".join(pieces), spans


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    conv, part, text, spans = zip(*rows, strict=True)
    spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(text, pa.string()), pa.array(spans, span)], ["conv_id", "part", "formatted", "loss"])


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(parts: DataFrame) -> DataFrame:
    """What the formatted conversations say: rows of SUMMARY.

    ``parts`` must still lie as ``format_conversations`` made them (each
    conversation's parts in one partition, in order). Turns are read from the
    markers and unescaped, the loss text from the mask's spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True))
        out: list[tuple] = []
        for conv, group in groupby(rows, lambda r: r[0]):
            n, loss_chars, chars, turns, loss, rest = 0, 0, 0, hashlib.sha256(), hashlib.sha256(), ""
            for _, text, spans in group:
                chars += len(text)
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss_chars += len(said)
                    loss.update(said.encode())
                end, rest = 0, rest + text
                for m in TURN.finditer(rest):
                    turns.update(f"{unescape(m[1], line=True)}\n{unescape(m[2])}\n".encode())
                    n, end = n + 1, m.end()
                rest = rest[end:]
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield _summary(out)
                out = []
        if out:
            yield _summary(out)

    return parts.mapInArrow(run, SUMMARY)


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SUMMARY.split(", ")])
