r"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role<|im_sep|>text<|im_end|>``.  A control string (one of the template's or of two
other common ones, :data:`CONTROLS`) inside a role or text gets one backslash more after its first character
than it has, so formatted texts hold markers of the template alone and dropping one backslash restores them.

Rows are range-sorted by conversation and turn.  A task takes some megabytes of them, escapes whole columns,
computes the lengths of the five segments of every turn, their cumulative offsets and scatter indices in numpy,
and copies headers and contents into one preallocated buffer, which is the Arrow column of formatted texts; the
loss mask is the byte range of each assistant's escaped text.  Conversations that span tasks, or exceed the size
of a slice, come as several pieces (:mod:`.pieces`), so none is ever held whole.

Defined edge cases: null text and role are empty; rows are ordered by turn (null first), then role, then text;
rows with a null conv_id form one conversation; repeated rows are turns of their own; only the role
``assistant`` is under the loss mask; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from .pieces import LAYOUT, cut_into_runs, read_pieces
from .token_ids import slices

START, BREAK, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = [START, BREAK, END, "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
LEARNED = "assistant"
SLICE = 2 << 20                    # text assembled at a time
LONG = 1 << 16                     # segments beyond it are copied as a block, without indices
RESULT = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rests(first: str) -> str:
    return "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)


ESCAPES = [(rf"{re.escape(c)}(\\*)({_rests(c)})", c) for c in "<["]
_UNESCAPES = [(re.compile(rf"{re.escape(c)}\\(\\*)({_rests(c)})"), rf"{c}\1\2") for c in "<["]


def escaped(column: pa.Array) -> pa.Array:
    for pattern, first in ESCAPES:
        column = pc.replace_substring_regex(column, pattern, rf"{first}\\\1\2")
    return column


def unescaped(text: str) -> str:
    if "\\" in text:
        for pattern, again in _UNESCAPES:
            text = pattern.sub(again, text)
    return text


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, n + 1 offsets of the turns, (begin, end) of each escaped text in the bytes)."""
    n = len(roles)
    contents = {1: _content(escaped(roles)), 3: _content(escaped(texts))}
    marks = {0: START, 2: BREAK, 4: END}
    lengths = np.empty((n, 5), np.int64)
    for j, mark in marks.items():
        lengths[:, j] = len(mark)
    for j, (_, offsets) in contents.items():
        lengths[:, j] = np.diff(offsets)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for j, mark in marks.items():
        out[starts[:, j, None] + np.arange(len(mark))] = np.frombuffer(mark.encode(), np.uint8)
    for j, (raw, offsets) in contents.items():
        size = lengths[:, j]
        for i in np.flatnonzero(size > LONG).tolist():
            out[starts[i, j]:ends[i, j]] = raw[offsets[i]:offsets[i + 1]]
        short = np.where(size > LONG, 0, size)
        within = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
        out[np.repeat(starts[:, j], short) + within] = raw[np.repeat(offsets[:-1], short) + within]
    return out, np.append(starts[:, 0], len(out)), np.stack([starts[:, 3], ends[:, 3]], axis=1)


def _sized(batch):
    for part in slices(batch, "text", SLICE):
        yield part, part.column("text").nbytes + part.column("role").nbytes


def _formatted(batches):
    from pyspark import TaskContext
    seq = TaskContext.get().partitionId() << 32
    for rows, starts, cut in cut_into_runs(batches, "conv_id", SLICE, _sized):
        roles, texts = (rows.column(c).combine_chunks() for c in ("role", "text"))
        raw, offsets, spans = assemble(roles, texts)
        begin = np.array(starts)
        bounds = offsets[np.append(begin, len(roles))]
        learned = np.flatnonzero(pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False))
        piece = np.searchsorted(begin, learned, side="right") - 1
        loss = spans[learned] - bounds[piece, None]
        cuts = 2 * np.searchsorted(piece, np.arange(len(begin) + 1))
        formatted = pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds.astype("<i4").tobytes()), pa.py_buffer(raw))
        yield pa.RecordBatch.from_arrays(
            [rows.column("conv_id").combine_chunks().take(pa.array(begin)), pa.array(np.arange(seq, seq + len(begin))),
             pa.array(cut, pa.bool_()), formatted,
             pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(loss.ravel(), pa.int64()))],
            ["conv_id", "seq", "cut", "formatted", "loss"])
        seq += len(begin)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, seq, cut, formatted text, loss mask (begin, end, begin, ... in its UTF-8 bytes) of
    ``conversations(conv_id, turn, role, text)``; a conversation with ``cut`` pieces is theirs in order of ``seq``."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    ordered = (rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"))
               .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    return ordered.mapInArrow(_formatted, LAYOUT.format(key="conv_id", kind=kind) + "formatted string, loss array<bigint>")


class _ReadBack:
    """Turns and text under the loss mask, told from formatted text alone."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[int]) -> None:
        self.chars += len(formatted)
        *turns, rest = formatted.split(END)
        for turn in turns:
            role, mark, text = turn.removeprefix(START).partition(BREAK)
            if not (mark and turn.startswith(START)):
                raise ValueError("damaged turn")
            self.turns_hash.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
        if rest:
            raise ValueError("turn without an end")
        self.turns += len(turns)
        raw = formatted.encode()
        for begin, end in zip(loss[::2], loss[1::2]):
            text = unescaped(raw[begin:end].decode())
            self.loss_chars += len(text)
            self.loss_hash.update(text.encode())

    def result(self) -> tuple:
        return self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from the output of :func:`format_chats`: counts and digests of what it says."""
    return read_pieces(formatted, _ReadBack, RESULT)


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, LEARNED, said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(more)))


def _sql_escaped(column: str) -> str:
    for pattern, first in ESCAPES:
        column = f"regexp_replace({column}, '{pattern}', '{first}\\\\\\1\\2', 'g')"
    return f"length({column})"


OP12_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(START + BREAK + END)} + {_sql_escaped('role')} + {_sql_escaped('text')}) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars
FROM joined
"""
