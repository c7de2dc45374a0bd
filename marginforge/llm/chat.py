"""Chat formatting by columnar byte assembly, and reading it back.

Template, by role (each control string stands at the start of a line):

    user       [INST]\\n TEXT \\n[/INST]\\n
    assistant  <s>\\n TEXT \\n</s>\\n
    system     <<SYS>>\\n TEXT \\n<</SYS>>\\n
    any other  [ROLE]\\n NAME \\n[/ROLE]\\n TEXT \\n[/TURN]\\n      (spaces only for reading)

Inside texts and names every control string gets one more backslash in front of
it than it had, so no control string there stands without one, and taking one
away restores the text. The loss mask covers the (escaped) texts of assistants.

Rows are dealt by conversation and sorted by turn (ties by role and text, nulls
first); a batch of rows is assembled at once: segment lengths, cumulative offsets
and scatter indices are computed in numpy, and headers, contents and footers go
into one preallocated buffer, which becomes the Arrow column. A conversation that
spans batches comes out in parts, so no conversation must fit a task's memory.

Null text or role counts as empty; null ids form one conversation; repeated
rows are repeated turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import spread

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
#: Bytes scattered at once.
SCATTER_BYTES = 1 << 20
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPE = rf"(\\*(?:{_ANY}))"
_UNESCAPE = re.compile(rf"\\(\\*(?:{_ANY}))")
_SHAPE = {"user": ("[INST]\n", "\n[/INST]\n"), "assistant": ("<s>\n", "\n</s>\n"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
_TURN = re.compile(r"\[INST\]\n(?P<user>.*?)\n\[/INST\]\n|<s>\n(?P<assistant>.*?)\n</s>\n|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[ROLE\]\n(?P<name>.*?)\n\[/ROLE\]\n(?P<other>.*?)\n\[/TURN\]\n", re.S)


def escape(text: str) -> str:
    return re.sub(_ESCAPE, r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _escaped(col: pa.Array) -> pa.Array:
    col = pc.fill_null(col.cast(pa.string()), "")
    if pc.any(pc.match_substring_regex(col, _ANY)).as_py():
        col = pc.replace_substring_regex(col, _ESCAPE, r"\\\1")
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a string column."""
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns; the end of each turn in it; the span of each loss text (empty if none)."""
    role, text = pc.fill_null(role.cast(pa.string()), ""), _escaped(text)
    names = role.dictionary_encode()
    shapes = [_SHAPE.get(r) or (f"[ROLE]\n{escape(r)}\n[/ROLE]\n", "\n[/TURN]\n") for r in names.dictionary.to_pylist()]
    code = names.indices.to_numpy(zero_copy_only=False)
    heads, feet = [np.frombuffer(h.encode(), np.uint8) for h, _ in shapes], [np.frombuffer(f.encode(), np.uint8) for _, f in shapes]
    offsets, data = _bytes(text)
    n_head, n_text, n_foot = np.array([len(h) for h in heads], np.int64)[code], np.diff(offsets), np.array([len(f) for f in feet], np.int64)[code]
    end = np.cumsum(n_head + n_text + n_foot)
    start = end - (n_head + n_text + n_foot)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for k, (h, f) in enumerate(zip(heads, feet, strict=True)):
        rows = np.flatnonzero(code == k)
        out[start[rows][:, None] + np.arange(len(h))] = h
        out[(end[rows] - len(f))[:, None] + np.arange(len(f))] = f
    body = start + n_head
    # Scatter indices take three numbers a byte, so texts are scattered a bounded number of bytes at a time; a long one is one slice.
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(offsets[:-1] // SCATTER_BYTES) > 0)), len(n_text)) if len(n_text) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        while a < b:
            m = a + 1 if n_text[a] > SCATTER_BYTES else a + int(np.argmax(np.append(n_text[a:b], SCATTER_BYTES + 1) > SCATTER_BYTES))
            lo, hi = offsets[a], offsets[m]
            if m == a + 1:
                out[body[a] : body[a] + n_text[a]] = data[lo:hi]
            else:
                out[np.arange(lo, hi) + np.repeat(body[a:m] - offsets[a:m], n_text[a:m])] = data[lo:hi]
            a = m
    is_loss = np.array([r == "assistant" for r in names.dictionary.to_pylist()], bool)[code] if len(code) else np.zeros(0, bool)
    return out, end, body, np.where(is_loss, body + n_text, body)


FORMATTED = "conv_id long, formatted binary, loss array<struct<start:int,end:int>>"


def format_chats(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from (conv_id, turn, role, text): UTF-8 bytes and the byte spans under the loss mask.

    Parts of one conversation follow one another in one partition, in order.
    """
    rows = spread(df.select("conv_id", "turn", "role", "text"), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0)
            out, end, lo, hi = assemble(b.column(2), b.column(3))
            ids, none = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            last = np.append(np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])), len(ids) - 1)
            stops = end[last]
            begins = np.append(0, stops[:-1])
            offsets = pa.py_buffer(np.append(0, stops).astype(np.int32))
            text = pa.Array.from_buffers(pa.binary(), len(last), [None, offsets, pa.py_buffer(out)])
            base = begins[np.searchsorted(last, np.arange(len(ids)))]
            mask = np.flatnonzero(hi > lo)
            counts = np.searchsorted(mask, np.append(0, last + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array((lo - base)[mask].astype(np.int32)), pa.array((hi - base)[mask].astype(np.int32))], ["start", "end"])
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(last)), text, pa.ListArray.from_arrays(pa.array(counts), spans)], ["conv_id", "formatted", "loss"])

    return rows.mapInArrow(work, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        kind = m.lastgroup
        turns.append((unescape(m["name"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the formatted bytes and spans alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # of the conversation that is being read, which may come in parts
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return batch

        for b in batches:
            for conv, raw, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is None or state["id"] != conv:
                    close()
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                text = raw.decode()
                state["all"] += len(text)
                for role, said in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(raw[span["start"] : span["end"]].decode())
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
            yield flush()
        close()
        yield flush()

    return formatted.mapInArrow(work, READ)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(text, '(\\*(?:<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]|\[/TURN\]))', '\\\1', 'g'))
    + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18 ELSE length(role) + 26 END AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
