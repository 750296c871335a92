"""Chat formatting: conversations as one string each, with marks around turns and a mask of what is learned.

A turn is `### role: text</turn>` and a line end. Inside roles and texts, backslashes, `###` and `</turn>` (in roles
colons too) are written with a backslash and a letter, so that every mark in the output is one of the template's.
Columns of bytes are put together in numpy: segment lengths, their cumulative offsets, and for every content byte its
place in one output buffer that is allocated once and becomes the Arrow column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = b"### ", b": ", b"</turn>\n"
_ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
_PLAIN = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":"}
_TURN = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.S)
LEARNED = "assistant"
SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("mask", pa.list_(pa.int64()))])


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    for plain, coded in (*_ESCAPES, *((":", "\\c"),) * role):
        column = pc.replace_substring(column, plain, coded)
    return column


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def _scatter(out: np.ndarray, at: np.ndarray, column: pa.Array) -> None:
    """Copies each string of the column to its place `at` in out."""
    data, offsets = _bytes(column)
    lengths = np.diff(offsets)
    own = np.arange(offsets[0], offsets[-1])
    out[own + np.repeat(at - offsets[:-1], lengths)] = data[offsets[0] : offsets[-1]]


def _chars_before(out: np.ndarray) -> np.ndarray:
    """Code points in front of each byte place, and behind the last."""
    return np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))


def assemble(t: pa.Table) -> pa.RecordBatch:
    """One row per conversation from its rows in order (conv_id, role, text), all of a conversation being in t. mask: start and end, in code points, of each learned text."""
    conv = t.column("conv_id").combine_chunks()
    role, text = (pc.fill_null(t.column(c).combine_chunks(), "") for c in ("role", "text"))
    learned = pc.equal(role, LEARNED).to_numpy(zero_copy_only=False)
    role, text = escape(role, role=True), escape(text)
    role_n, text_n = (pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (role, text))
    lengths = np.stack([np.full(len(role_n), len(OPEN)), role_n, np.full(len(role_n), len(COLON)), text_n, np.full(len(role_n), len(CLOSE))], axis=1)
    places = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(places[-1], np.uint8)
    at = places[:-1].reshape(-1, 5)
    for k, mark in ((0, OPEN), (2, COLON), (4, CLOSE)):
        out[at[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, at[:, 1], role)
    _scatter(out, at[:, 3], text)
    valid = conv.is_valid().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])) + 1))
    ends = np.concatenate((starts[1:], [len(ids)]))
    offsets = np.concatenate((at[starts, 0], [places[-1]]))
    formatted = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
    before = _chars_before(out)
    base = np.repeat(before[at[starts, 0]], ends - starts)
    spans = np.stack([before[at[:, 3]] - base, before[at[:, 4]] - base], axis=1)[learned]
    counts = np.add.reduceat(learned.astype(np.int64), starts) * 2
    mask = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(spans.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(starts)), formatted, pa.array(ends - starts, pa.int64()), mask], schema=SCHEMA)


def _within(t: pa.Table, most: int = 1 << 28) -> Iterator[pa.RecordBatch]:
    """assemble() over parts of whole conversations of about `most` bytes each; a larger conversation is a part of its own."""
    conv, size = t.column("conv_id").combine_chunks(), t.nbytes
    if size > most and t.num_rows > 1:
        ids, valid = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), conv.is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])) + 1
        if len(cuts):
            cut = int(cuts[len(cuts) // 2])
            yield from _within(t.slice(0, cut), most)
            yield from _within(t.slice(cut), most)
            return
    yield assemble(t)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """assemble() over sorted rows; the last conversation of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        conv = batch.column("conv_id")
        last = conv[-1].as_py()
        same = pc.is_null(conv) if last is None else pc.fill_null(pc.equal(conv, last), False)
        other = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
        if not len(other) and (len(held) == 1 or held[0].column("conv_id")[-1].as_py() == last):
            continue
        keep = batch.num_rows - int(other[-1]) - 1 if len(other) else batch.num_rows
        t = pa.Table.from_batches(held)
        yield from _within(t.slice(0, t.num_rows - keep))
        held = t.slice(t.num_rows - keep).to_batches()
    if held:
        yield from _within(pa.Table.from_batches(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, mask) from rows (conv_id, turn, role, text).

    Turns go by number, null first; equal numbers by role and text; repeated rows are repeated turns. A null role or
    text is empty. Rows with a null conv_id form one conversation. A conversation's output is one string, so one task
    has the rows of a conversation, a batch at a time until they are put together; conversations are dealt out by id."""
    own = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_whole, "conv_id long, formatted string, n_turns long, mask array<long>")
