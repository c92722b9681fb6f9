import random
import sys

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickframe.llm import bpe
from tickframe.llm.common import utf8

PATH = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
OURS = bpe.Bpe(PATH)


def agree(texts):
    ids, first = OURS.encode(*utf8(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == PLAIN.encode(t or "", add_special_tokens=False).ids, repr(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t  'stremvld.!?0159aZéß漢😀²½́-<|>_")), max_size=40), max_size=6))
def test_odd_texts(texts):
    agree(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<", " ", "\n", "!", "a", "'s", "9", "é"]), max_size=12).map("".join), max_size=5))
def test_added_tokens(texts):
    agree(texts)


def test_long_and_mixed():
    rng = random.Random(4)
    agree([None, "", "".join(chr(rng.choice([32, 39, 10, 97, 115, 0x2028, 0x3000, 0x85, rng.randrange(1, 0xD7FF), rng.randrange(0xE000, sys.maxunicode)])) for _ in range(5000)), "<|endoftext|>", "it's we'll they've I'd", "x" * 20000])


def test_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Bpe(PATH)
    texts = [" ".join(f"word{i}{j}" for j in range(30)) for i in range(10)]
    for t in texts:
        ids, _ = own.encode(*utf8(pa.array([t])))
        assert ids.tolist() == PLAIN.encode(t, add_special_tokens=False).ids
    assert np.all(np.diff(own.known.astype(float)) > 0)
