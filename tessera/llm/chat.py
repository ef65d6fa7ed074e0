"""Chat formatting with a loss mask that is aligned by offsets.

A conversation is rendered as one string: for every turn `### role: text</turn>` and a newline. A backslash goes before
every backslash and every control string that a text holds, so that the string reads back unambiguously. The string is
encoded once with offsets; the sorted spans of the assistant's texts and the sorted spans of the tokens are intersected by
binary search, which gives a mask by token and, where a token straddles a bound, the part of it that counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer

HEAD, COLON, END = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"\\|</turn>|### ")
ROLE_CONTROL = re.compile(r"\\|: |</turn>|### ")
TURN = re.compile(r"### ((?:\\.|(?!: )[^\\])*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.DOTALL)
FORMATTED = "conv_id long, formatted string, ids array<int>, mask array<byte>, loss_starts array<int>, loss_ends array<int>"


def escaped(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], loss_roles: set[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the texts of loss_roles in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = HEAD + escaped(role, ROLE_CONTROL) + COLON, escaped(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


def intersect(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask by token, starts, ends of the covered pieces) of tokens [n, 2] and sorted disjoint spans.

    Tokens of one character may share its offsets; a piece never starts before the end of the one before it, so that
    every character counts once.
    """
    mask = np.zeros(len(tokens), np.int8)
    starts, ends = [], []
    for lo, hi in spans:
        if lo == hi:
            continue
        a = int(np.searchsorted(tokens[:, 1], lo, "right"))
        b = int(np.searchsorted(tokens[:, 0], hi, "left"))
        mask[a:b] = 1
        done = np.maximum.accumulate(np.concatenate([[lo], np.minimum(tokens[a:b, 1], hi)]))
        s, e = np.maximum(tokens[a:b, 0], done[:-1]), np.minimum(tokens[a:b, 1], hi)
        full = s < e
        starts.append(s[full])
        ends.append(e[full])
    none = np.empty(0, np.int64)
    return mask, np.concatenate([none, *starts]), np.concatenate([none, *ends])


#: Turns and characters that are held as Python objects at once.
MOST_TURNS, MOST_CHARS = 2_000, 1 << 18


def _format(path: str, loss_roles: set[str]):
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["conv_id", "formatted", "ids", "mask", "loss_starts", "loss_ends"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, ordinary=True)
        for batch in batches:
            turns = batch.column(1)
            sizes = (len(x.values) for x in turns)
            for lo, hi in slices(sizes, 256, MOST_TURNS) if len(turns) else ():
                own = [x.values for x in turns[lo:hi]]
                done = [render(list(zip(x.field("role").to_pylist(), x.field("text").to_pylist(), strict=True)), loss_roles) for x in own]
                convs = batch.column(0)[lo:hi].to_pylist()
                for a, b in slices((len(x) for x, _ in done), 256, MOST_CHARS):
                    rows = []
                    for conv, (text, spans), e in zip(convs[a:b], done[a:b], t.encode_batch([x for x, _ in done[a:b]], add_special_tokens=False), strict=True):
                        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                        mask, starts, ends = intersect(offsets, spans)
                        rows.append((conv, text, np.array(e.ids, np.int32), mask, starts.astype(np.int32), ends.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def format_chats(rows: DataFrame, path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, ids, mask, loss_starts, loss_ends) of rows(conv_id, turn, role, text), one for each conversation.

    Turns go by turn, then role, then text; a null turn comes first, a null text or role is empty, a null conv_id is a
    conversation of its own, repeated rows are turns each, an empty table gives no rows, other columns are ignored. mask is
    1 for tokens that hold a part of the texts of loss_roles; loss_starts and loss_ends are those parts in `formatted`.
    """
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return convs.mapInArrow(_format(path, set(loss_roles)), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), loss array of strings, formatted_chars) from format_chats' rows alone."""
    kinds = [pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.list_(pa.string()), pa.int64()]
    names = ["conv_id", "turns", "loss", "formatted_chars"]

    def run(batches):
        for batch in batches:
            sizes = pc.utf8_length(batch.column("formatted")).to_pylist()
            for lo, hi in slices(iter(sizes), 256, MOST_CHARS) if sizes else ():
                rows = [(r["conv_id"], [{"role": a, "text": b} for a, b in parse(r["formatted"])], _pieces(r), len(r["formatted"])) for r in batch.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = formatted.select("conv_id", "formatted", "loss_starts", "loss_ends")  # neither ids nor mask are read
    return own.mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss array<string>, formatted_chars long")


def _pieces(row: dict) -> list[str]:
    """The text under the mask, unescaped: pieces that touch are joined before, as a bound may part a backslash from its character."""
    out, last = [], None
    for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
        if a == last:
            out[-1] += row["formatted"][a:b]
        else:
            out.append(row["formatted"][a:b])
        last = b
    return [unescaped(x) for x in out]
