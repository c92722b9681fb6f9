"""Chat formatting by columnar byte assembly.

Turns become marked segments of one text a conversation. Segment lengths give offsets by a running sum;
heads, escaped texts and tails are scattered into one preallocated buffer that becomes an Arrow column
as it is. Control strings inside texts and roles are escaped with a backslash after their first
character, and backslashes are doubled, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, small_batches, utf8

CONTROLS = ("<<SYS>>", "<</SYS>>", "[/INST]", "[INST]", "[/ROLE]", "[ROLE]", "</s>", "<s>", "[END]", "[NONE]", "[/NONE]")
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), None: ("[NONE]", "[/NONE]")}
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[NONE\](?P<none>.*?)\[/NONE\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[END\]", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\\", "\\\\")
    for c in CONTROLS:
        texts = pc.replace_substring(texts, c, f"{c[0]}\\{c[1:]}")
    return texts


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _scatter(out: np.ndarray, at: np.ndarray, texts: pa.Array) -> None:
    data, offsets = utf8(texts)
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], np.diff(offsets))] = data


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[list[dict]]]:
    """(formatted, turns, loss) of each run of equal ``conv``; loss: the byte ranges of assistant texts."""
    first = np.append(0, np.flatnonzero(conv[1:] != conv[:-1]) + 1)
    role = roles.to_pylist()
    pairs = [MARKS.get(r, ("[ROLE]", "[END]")) for r in role]
    plain = [r in MARKS for r in role]
    names = escape(pa.array([None if ok else r for r, ok in zip(role, plain)], pa.string()))
    heads = pa.array([h if ok else f"{h}{n}[/ROLE]" for (h, _), ok, n in zip(pairs, plain, names.to_pylist())], pa.string())
    tails, body = pa.array([t for _, t in pairs], pa.string()), escape(texts)
    size = [np.diff(utf8(x)[1]) for x in (heads, body, tails)]
    start = np.append(0, np.cumsum(size[0] + size[1] + size[2]))
    out = np.empty(start[-1], np.uint8)
    text_at = start[:-1] + size[0]
    for at, segment in ((start[:-1], heads), (text_at, body), (text_at + size[1], tails)):
        _scatter(out, at, segment)
    bounds = np.append(start[first], start[-1])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out)).cast(pa.string())
    loss = []
    for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(conv)])):
        own = [j for j in range(a, b) if role[j] == "assistant"]
        loss.append([{"start": int(text_at[j] - bounds[i]), "end": int(text_at[j] + size[1][j] - bounds[i])} for j in own])
    return formatted, np.diff(np.append(first, len(conv))), loss


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _keys(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """A number that changes where a batch's conversation does; null is one of its own."""
    conv = column(rows, "conv_id")
    if not len(conv):
        return np.zeros(0, np.int64)
    same = pc.fill_null(pc.equal(conv.slice(1), conv.slice(0, len(conv) - 1)), False)
    both = pc.and_(conv.slice(1).is_null(), conv.slice(0, len(conv) - 1).is_null())
    return np.append(0, np.cumsum(~pc.or_(same, both).to_numpy(zero_copy_only=False)))


def _format(batches):
    """Conversations come whole and in order; one that a batch cuts waits for its end, and is looked at once."""

    def done(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        formatted, turns, loss = assemble(_keys(table), column(table, "role"), column(table, "text"))
        first = np.append(0, np.cumsum(turns)[:-1])
        return pa.RecordBatch.from_arrays([column(table, "conv_id").take(pa.array(first)), pa.array(turns, pa.int64()), formatted, pa.array(loss, _LOSS)], ["conv_id", "n_turns", "formatted", "loss"])

    waiting, open_id = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _keys(batch)
        breaks = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = column(batch, "conv_id")[0].as_py()
        if waiting and first != open_id:
            yield done(waiting)
            waiting = []
        if len(breaks):
            yield done([*waiting, batch.slice(0, int(breaks[-1]))])
            waiting = []
        waiting.append(batch.slice(int(breaks[-1]) if len(breaks) else 0))
        open_id = column(batch, "conv_id")[-1].as_py()
    if waiting:
        yield done(waiting)


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss (byte ranges of ``formatted`` to train on).

    Turns stand in ascending order of turn (null first), ties by role and text; repeated rows are turns of
    their own. Null texts are empty; null and unknown roles have marks of their own. Null conv_ids are one
    conversation. Ids of any type are passed on. Other columns are left aside; an empty table gives an empty result. A
    conversation is one row of the output, and so is held whole in one task.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", "text")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, f"conv_id {_kind(rows)}, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """(role, text) of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        at, kind = m.end(), m.lastgroup
        role = {"none": None, "other": unescape(m["role"] or "")}.get(kind, kind)
        turns.append((role, unescape(m[kind])))
    return turns


def _digest(batches):
    for batch in batches:
        rows = []
        for text, loss in zip(column(batch, "formatted").to_pylist(), column(batch, "loss").to_pylist()):
            turns, raw = parse(text), text.encode()
            told = "".join(f"{r or ''}\n{t}\n" for r, t in turns)
            masked = "".join(unescape(raw[x["start"] : x["end"]].decode()) for x in loss)
            rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([column(batch, "conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Format, write, read back, and digest what was read."""
    written = materialize(format_chats(conversations), "chats")
    return written.mapInArrow(_digest, f"conv_id {_kind(written)}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
