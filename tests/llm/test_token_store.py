import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickframe.llm import ordered
from tickframe.llm import token_store as m

from .cases import corpus, frame, in_order

PATH = P.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_code(values):
    control, data = m.encode(np.array(values, np.uint32))
    assert m.decode(control, data, len(values)).tolist() == values


@pytest.mark.parametrize("size", [20_000, 8 << 20])
def test_store(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "RANGE_BYTES", size)
    monkeypatch.setattr(m, "BLOCK_BYTES", size // 2)
    rows = corpus(2) + [(900 + i, t, *[None] * 6) for i, t in enumerate(["<|endoftext|>", "a <|endoftext|> b<|endoftext|>\n!", "<|endoftext"])] + [(None, f"none {i} of many", *[None] * 6) for i in range(40)] + [(905, f"same {i}", *[None] * 6) for i in range(40)]
    plain = Tokenizer.from_file(PATH)
    want, start = [], 0
    for d, t in in_order(spark, rows):
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(map(tuple, m.token_store(frame(spark, rows), PATH, keep_ids=True).collect()), key=lambda r: r[1])
    assert got == want


def test_empty(spark):
    assert m.token_store(frame(spark, []), PATH).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "none")], "doc_id string, text string")
    got = sorted(map(tuple, m.token_store(docs, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, "a", "b"]
