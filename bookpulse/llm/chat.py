"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: every turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and
texts, ``<`` with any number of backslashes and ``|`` gets one backslash more, so no text contains a
marker, and taking one backslash away again gives the text back.

The rendering is encoded once, with offsets. The markers are tokens of their own, so no token lies
across a turn's border there. The spans of the assistants' texts are sorted, and so are the tokens;
binary search finds the tokens that meet each span, and the meeting parts are the loss spans.

Turns are ordered by turn, role and text; null turns come first, null roles and texts are empty.
Rows of a null ``conv_id`` are one conversation. Equal rows are turns of their own.

A conversation of any length streams: its rows are sorted in their partition and come out in parts of
about ``PART`` characters that end between turns. Encoding part by part gives the same tokens as
encoding whole, since markers are always tokens of their own. Only the hash states and the part at
hand are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import pa_schema

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, END = "<|im_start|>", "<|im_end|>"
PART = 1_000_000
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    """Roles stand on one line: line feeds and backslashes are written as two characters."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    found = Tokenizer.from_file(path)
    found.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets tile the text
    found.encode_special_tokens = False
    found.add_special_tokens([START, END])
    return found


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns and the sorted spans of the assistants' texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped_role(role)}\n", escaped(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def aligned(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The tokens that meet a span, and the parts of spans that tokens cover, joined where they touch."""
    mask = np.zeros(len(starts), bool)
    covered: list[tuple[int, int]] = []
    for low, high in spans:
        first = int(np.searchsorted(ends, low, "right"))
        last = int(np.searchsorted(starts, high, "left"))
        mask[first:last] = True
        for s, e in zip(np.maximum(starts[first:last], low).tolist(), np.minimum(ends[first:last], high).tolist(), strict=True):
            if covered and covered[-1][0] >= low and s <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
            else:
                covered.append((s, e))
    return mask, covered


SCHEMA = (
    "conv_id {kind}, part int, text string, input_ids array<int>, loss_mask array<boolean>, "
    "loss_spans array<struct<start:int,end:int>>"
)


def format_conversations(rows: DataFrame, path: str = TOKENIZER, part_chars: int = PART) -> DataFrame:
    """Each conversation in one or more parts, in order within a partition; spans count from a part's start."""
    schema = SCHEMA.format(kind=rows.schema["conv_id"].dataType.simpleString())
    fields = pa_schema(rows.sparkSession, schema)
    turns = (
        rows.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def encoded(parts: list[tuple]) -> pa.RecordBatch:
        made = [rendered(turns) for _, _, turns in parts]
        columns: list[list] = [[], [], [], [], [], []]
        coded = tokenizer(path).encode_batch([text for text, _ in made], add_special_tokens=False)
        for (conv, number, _), (text, spans), tokens in zip(parts, made, coded, strict=True):
            offsets = np.array(tokens.offsets, np.int64).reshape(-1, 2)
            mask, covered = aligned(spans, offsets[:, 0], offsets[:, 1])
            values = conv, number, text, tokens.ids, mask.tolist(), [{"start": s, "end": e} for s, e in covered]
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        waiting = size = number = 0
        conv: object = ...
        turns: list[tuple[str, str]] = []
        for batch in batches:
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for k, role, text in zip(ids, roles, texts, strict=True):
                if turns and (k != conv or size >= part_chars):
                    ready.append((conv, number, turns))
                    waiting += size
                    number, turns, size = number + 1, [], 0
                    if waiting >= part_chars:
                        yield encoded(ready)
                        ready, waiting = [], 0
                if k != conv:
                    conv, number = k, 0
                turns.append((role, text))
                size += len(text)
        if turns:
            ready.append((conv, number, turns))
        if ready:
            yield encoded(ready)

    return turns.mapInArrow(run, schema)


DIGEST = (
    "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from their parts as they come."""
    schema = DIGEST.format(kind=formatted.schema["conv_id"].dataType.simpleString())
    fields = pa_schema(formatted.sparkSession, schema)

    class Reading:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
            self.all, self.masked = hashlib.sha256(), hashlib.sha256()

        def read(self, text: str, spans: list[dict]) -> None:
            self.chars += len(text)
            for role, body in TURN.findall(text):
                self.turns += 1
                self.all.update(f"{unescaped_role(role)}\n{unescaped(body)}\n".encode())
            for span in spans:
                said = unescaped(text[span["start"]:span["end"]])
                self.loss += len(said)
                self.masked.update(said.encode())

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        now: Reading | None = None
        for batch in batches:
            done = []
            for conv, part, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or part == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Reading(conv)
                now.read(text, spans)
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([now.row()])

    return formatted.select("conv_id", "part", "text", "loss_spans").mapInArrow(run, schema)
