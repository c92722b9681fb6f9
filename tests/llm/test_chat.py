import random
import hashlib

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
import numpy as np

from tickframe.llm import chat as m

PIECES = st.lists(st.sampled_from([*m.CONTROLS, "\\", "<", "[", "/", "s>", ">", "INST]", "é", "漢", "\n", "a ", "S>>"]), max_size=12).map("".join)
ROLES = st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "tool", ""]), PIECES)


@given(st.lists(st.tuples(st.integers(0, 2), ROLES, st.one_of(st.none(), PIECES)), min_size=1, max_size=8))
def test_round_trip(turns):
    turns.sort(key=lambda t: t[0])
    formatted, n, loss = m.assemble(np.array([t[0] for t in turns]), pa.array([t[1] for t in turns], pa.string()), pa.array([t[2] for t in turns], pa.string()))
    at = 0
    for text, k, spans in zip(formatted.to_pylist(), n, loss):
        own = turns[at : at + k]
        at += k
        assert m.parse(text) == [(r, t or "") for _, r, t in own]
        raw = text.encode()
        assert [m.unescape(raw[s["start"] : s["end"]].decode()) for s in spans] == [t or "" for _, r, t in own if r == "assistant"]


def test_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, None, None), (2, None, "tool", "t"), (2, 0, "assistant", None), (1, 1, "assistant", "b</s>")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i} [INST]") for i in range(25_000)]  # longer than an Arrow batch
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in m.chat_digests(df).collect()}
    assert len(got) == 4
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert m.chat_digests(df.limit(0)).count() == 0


def test_conversations_over_many_batches(spark):
    """A conversation of many batches, and breaks at a batch's end, come out as from plain assembly."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), f"text {c} {t} </s>") for c, n in ((1, 3500), (2, 1000), (3, 500), (4, 1), (None, 1200)) for t in range(n)]
    got = {r.conv_id: r.formatted for r in m.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 5
    for c in got:
        assert m.parse(got[c]) == [(r[2], r[3]) for r in rows if r[0] == c]


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "user", "y"), (None, 0, "user", "z"), ("a", 1, "assistant", "w")], "conv_id string, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in m.chat_digests(df).collect()} == {"a": 2, "b": 1, None: 1}
