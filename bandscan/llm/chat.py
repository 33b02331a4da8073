r"""Chat formatting by columnar byte assembly.

The template of a turn is `### Role: text</turn>` and a line end, the role
capitalised; a role that begins with a capital gets a backslash first. Inside roles and texts a backslash goes in front of every
backslash, of every # that begins ###, and of every < that begins </turn>;
in roles also in front of every colon. Reading takes the character after a
backslash as it is, so the template is reversible whatever the texts hold.

Formatting works on whole Arrow columns: the lengths of all segments (header,
escaped text, end of turn), their cumulative offsets and the scatter indices
of every byte are computed in numpy, and headers and contents are copied into
one preallocated buffer that becomes the Arrow string column. Turns are dealt
out by conversation and sorted by turn; a conversation is emitted in parts of
bounded size, so one of any length streams through a task.

Defined results: null texts and roles are empty; turns with equal or null
numbers are ordered by role, then text (null numbers first); repeated rows are
turns of their own; a null conversation id is a conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, BETWEEN, CLOSE = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = "assistant"
#: Formatted bytes after which a part of a conversation is closed.
PART_BYTES = 4 << 20


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and the offsets of its values in them."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _starts(raw: np.ndarray, ends: np.ndarray, needle: bytes) -> np.ndarray:
    """Where the needle begins, inside one value; ends has each byte's value's end."""
    n = len(raw) - len(needle) + 1
    found = np.zeros(len(raw), bool)
    if n > 0:
        hit = raw[:n] == needle[0]
        for k in range(1, len(needle)):
            hit &= raw[k : k + n] == needle[k]
        found[:n] = hit & (np.arange(len(needle), n + len(needle)) <= ends[:n])
    return found


def _escaped(raw: np.ndarray, at: np.ndarray, colon: bool) -> np.ndarray:
    """For each byte, whether a backslash goes in front of it."""
    ends = np.repeat(at[1:], np.diff(at))
    mask = (raw == ord("\\")) | _starts(raw, ends, b"###") | _starts(raw, ends, b"</turn>")
    return mask | (raw == ord(":")) if colon else mask


def _scatter(out: np.ndarray, to: np.ndarray, raw: np.ndarray, at: np.ndarray, mask: np.ndarray) -> None:
    """Copies values to the places `to`, each escaped byte one further for the backslash before it."""
    before = np.cumsum(mask)  # of the escapes up to and with each byte
    base = np.concatenate([[0], before])[at[:-1]]
    where = np.arange(len(raw)) + before + np.repeat(to - at[:-1] - base, np.diff(at))
    out[where] = raw
    out[where[mask] - 1] = ord("\\")


def _fixed(out: np.ndarray, to: np.ndarray, what: bytes) -> None:
    out[to[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, the offsets of the turns, and where each turn's escaped text starts and ends."""
    role_raw, role_at = _buffers(roles)
    role_raw = role_raw.copy()
    first = role_at[:-1][np.diff(role_at) > 0]
    capital = (role_raw[first] >= ord("A")) & (role_raw[first] <= ord("Z"))
    small = (role_raw[first] >= ord("a")) & (role_raw[first] <= ord("z"))
    role_raw[first[small]] -= 32  # capitalised
    text_raw, text_at = _buffers(texts)
    role_mask, text_mask = _escaped(role_raw, role_at, True), _escaped(text_raw, text_at, False)
    role_mask[first[capital]] = True
    grown = lambda at, mask: np.diff(at) + np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    role_len, text_len = grown(role_at, role_mask), grown(text_at, text_mask)
    length = len(OPEN) + role_len + len(BETWEEN) + text_len + len(CLOSE)
    turn_at = np.concatenate([[0], np.cumsum(length)])
    role_to = turn_at[:-1] + len(OPEN)
    text_to = role_to + role_len + len(BETWEEN)
    out = np.empty(turn_at[-1], np.uint8)
    _fixed(out, turn_at[:-1], OPEN)
    _fixed(out, role_to + role_len, BETWEEN)
    _fixed(out, text_to + text_len, CLOSE)
    _scatter(out, role_to, role_raw, role_at, role_mask)
    _scatter(out, text_to, text_raw, text_at, text_mask)
    return out, turn_at, text_to, text_to + text_len


PART_SCHEMA = "part long, formatted string, loss_starts array<long>, loss_ends array<long>"


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Conversations as template text, in parts: (conv, part, formatted, loss_starts, loss_ends).

    Parts number from 0 within a conversation; their texts, joined, are the
    conversation's. The loss mask is the byte ranges of the assistant's
    escaped texts in the part. One shuffle, by conversation.
    """
    conv_type = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = (), 0
        for b in batches:
            if not b.num_rows:
                continue
            out, turn_at, text_at, text_end = assembled(b.column(1), b.column(2))
            convs, loss = b.column(0).to_pylist(), np.array([r == LOSS_ROLE for r in b.column(1).to_pylist()])
            cuts, since = [0], 0
            for k in range(1, b.num_rows):
                if convs[k] != convs[k - 1] or turn_at[k] - since >= part_bytes:
                    cuts.append(k)
                    since = turn_at[k]
            cuts.append(b.num_rows)
            numbers, ids = [], []
            for k in cuts[:-1]:
                part = part + 1 if last == (convs[k],) else 0
                last = (convs[k],)
                numbers.append(part)
                ids.append(convs[k])
            offsets = turn_at[cuts]
            text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            starts, ends = [], []
            for a, z in zip(cuts, cuts[1:]):
                mask = loss[a:z]
                starts.append(text_at[a:z][mask] - turn_at[a])
                ends.append(text_end[a:z][mask] - turn_at[a])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(numbers, pa.int64()), text, pa.array(starts, kind), pa.array(ends, kind)], names=["conv", "part", "formatted", "loss_starts", "loss_ends"])

    return rows.mapInArrow(run, f"conv {conv_type.simpleString()}, {PART_SCHEMA}").withColumnRenamed("conv", conv_col)


_MARK = re.compile(rb"\\.|: |</turn>\n", re.S)
_ESCAPE = re.compile(rb"\\(.)", re.S)


def unescaped(data: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1", data)


def read_turns(data: bytes) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted part."""
    start, role = len(OPEN), None
    for m in _MARK.finditer(data):
        what = m[0]
        if what[:1] == b"\\":
            continue
        if what == BETWEEN and role is None:
            role = unescaped(data[start : m.start()]).decode()
            if b"A" <= data[start : start + 1] <= b"Z":
                role = role[0].lower() + role[1:]
            start = m.end()
        elif what == CLOSE:
            yield role, unescaped(data[start : m.start()]).decode()
            start, role = m.end() + len(OPEN), None


def digests(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What each conversation says, read back from its formatted parts.

    The parts of a conversation must follow each other in a partition, as
    formatted() leaves them. Only running digests are held.
    """
    schema = f"`{conv_col}` {parts.schema[conv_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def result(done: list) -> pa.RecordBatch:
            cols = list(zip(*done))
            cols[2], cols[4] = [x.hexdigest() for x in cols[2]], [x.hexdigest() for x in cols[4]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c) for c in cols[1:])], names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            kind, done = b.column(0).type, []
            for conv, part, text, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
                if part == 0:
                    done += [held] if held else []
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.encode()
                for role, said in read_turns(raw):
                    held[1] += 1
                    held[2].update(f"{role}\n{said}\n".encode())
                for a, z in zip(starts, ends):
                    said = unescaped(raw[a:z])
                    held[3] += len(said.decode())
                    held[4].update(said)
                held[5] += len(text)
            if done:
                yield result(done)
        if held:
            yield result([held])

    return parts.select(conv_col, "part", "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)
