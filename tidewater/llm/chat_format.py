"""Chat formatting by columnar byte assembly.

Template, with text escaped:
    user        [INST] text [/INST]
    assistant   text</s>
    other role  [TURN]role[/TURN]text</s>
Escaping puts one more backslash behind the first character of every control string in a text, and of those that already
have some there, so that no text holds one; unescaping takes one away. Control strings: [INST] [/INST] [TURN] [/TURN] <s> </s>.

Turns are dealt by range over (conv_id, turn, role, text), so a long conversation is formatted by several tasks. A task
formats a batch of turns at once: numpy computes the lengths of all segments (header, role, middle, text, tail), their
cumulative offsets and the index of each content byte in the output, and headers and contents are copied into one buffer that
becomes the Arrow column. An output row holds up to PART_TURNS turns of one conversation: conv_id, part (ascending through
the conversation), n_turns, formatted, and the loss mask as byte ranges of formatted (loss_start, loss_end).

Defined results. Null text and null role: empty. Turns go by turn, then role, then text, nulls first; equal rows all stay.
A null conv_id is a conversation of its own. Very long texts are copied as they are; a batch of turns is at most what Spark hands over
(64 MB, or one turn). An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import new_path, table

#: Bytes of contents for which indices are made at once.
SCATTER_BYTES = 1 << 20
#: Turns of a conversation in one output row at most.
PART_TURNS = 256
FORMATTED = "conv_id long, part long, n_turns int, formatted string, loss_start array<int>, loss_end array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_CONTROL = r"(/?(?:s>|INST\]|TURN\]))"
_ESCAPE = r"([<\[])(\\*)" + _CONTROL
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[TURN\](.*?)\[/TURN\](.*?)</s>|(.*?)</s>", re.DOTALL)
USER, ASSISTANT, OTHER = 0, 1, 2
#: Before the role, between role and text, after the text; by kind of turn.
HEADER = [b"[INST] ", b"", b"[TURN]"]
MIDDLE = [b"", b"", b"[/TURN]"]
TAIL = [b" [/INST]", b"</s>", b"</s>"]


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(texts, ""), _ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of each value and the end) of a column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(formatted turns as one binary buffer, end of each turn, start and end of each text in it)."""
    roles, texts = pc.fill_null(roles.cast(pa.string()), ""), escaped(texts.cast(pa.string()))
    kind = np.where(pc.equal(roles, "user"), USER, np.where(pc.equal(roles, "assistant"), ASSISTANT, OTHER))
    roles = pc.if_else(pa.array(kind == OTHER), escaped(roles), "")  # told by the template for the other two
    (role_data, role_at), (text_data, text_at) = _bytes_of(roles), _bytes_of(texts)
    fixed = [np.array([len(x) for x in parts])[kind] for parts in (HEADER, MIDDLE, TAIL)]
    lengths = np.stack([fixed[0], np.diff(role_at), fixed[1], np.diff(text_at), fixed[2]], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for column, parts in ((0, HEADER), (2, MIDDLE), (4, TAIL)):
        for k, piece in enumerate(parts):
            out[starts[kind == k, column][:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    for column, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        n = lengths[:, column]
        cuts = np.searchsorted(at, np.arange(at[0], at[-1], SCATTER_BYTES)) if at[-1] - at[0] > SCATTER_BYTES else [0]
        for i, j in zip(cuts, [*cuts[1:], len(n)]):  # rows of about so many bytes at a time: an index takes eight times as many
            if n[i:j].max(initial=0) > SCATTER_BYTES:  # runs are copied as such where rows are long
                for k in range(i, j):
                    out[starts[k, column] : starts[k, column] + n[k]] = data[at[k] : at[k + 1]]
            else:
                out[np.arange(n[i:j].sum()) + np.repeat(starts[i:j, column] - (at[i:j] - at[i]), n[i:j])] = data[at[i] : at[j]]
    return out, ends[:, -1], starts[:, 3], ends[:, 3]


def formatted(turns: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32  # partitions are in order, so parts of a conversation ascend through them
        for b in batches:
            if not b.num_rows:
                continue
            out, turn_end, text_start, text_end = assemble(b.column("role"), b.column("text"))
            assistant = pc.fill_null(pc.equal(b.column("role"), "assistant"), False).to_numpy(zero_copy_only=False)
            conv = b.column("conv_id")
            key, null = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            new = np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])]
            since = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            first = np.flatnonzero(since % PART_TURNS == 0)
            last = np.r_[first[1:], len(key)] - 1
            begin = np.r_[0, turn_end[last[:-1]]]
            loss = np.flatnonzero(assistant)
            row = np.searchsorted(first, loss, side="right") - 1
            at = np.searchsorted(loss, np.r_[first, len(key)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array((x[loss] - begin[row]).astype(np.int32))) for x in (text_start, text_end)]
            text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.r_[0, turn_end[last]].astype(np.int64)), pa.py_buffer(out)])
            ids = pa.array(key[first], mask=null[first])
            parts = pa.array(np.arange(part, part + len(first)))
            part += len(first)
            yield pa.RecordBatch.from_arrays([ids, parts, pa.array((last - first + 1).astype(np.int32)), text.cast(pa.string()), *lists], ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        user, role, other, assistant = m.groups()
        out.append(("user", unescape(user)) if user is not None else (unescape(role), unescape(other)) if role is not None else ("assistant", unescape(assistant)))
        at = m.end()
    return out


def digests(written: DataFrame) -> DataFrame:
    """What formatted rows hold, by conversation: turns are parsed from the strings, loss text is cut out by the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out(rows: list) -> pa.RecordBatch:
            names = DIGESTS.replace(" long", "").replace(" string", "").split(", ")
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        def ended() -> None:
            key, turns, turn_hash, chars, loss_hash, total = now
            rows.append((key, turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), total))

        for b in batches:
            for key, text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if now is None or now[0] != key:
                    if now is not None:
                        ended()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                raw = text.encode()
                for i, j in zip(starts, ends):
                    said = unescape(raw[i:j].decode())
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if rows:
                yield out(rows)
                rows = []
        if now is not None:
            ended()
            yield out(rows)

    return written.select("conv_id", "part", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGESTS)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    path = new_path(spark, "chats")
    formatted(turns).write.parquet(path)
    return digests(spark.read.parquet(path))
