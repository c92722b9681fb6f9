import random

import pytest

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickframe.llm import bpe
from tickframe.llm import token_counts as m
from tickframe.llm.common import materialize, utf8

from .cases import corpus, frame

PATH = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
CODER = bpe.load(PATH)
PIECES = st.sampled_from([*"ab 's\n\t1!é漢😀.'lve  ", "<|endoftext|>", "<|endo", "ftext|>"])
TEXT = st.lists(PIECES, max_size=200).map("".join)


def n_tokens(text):
    return len(PLAIN.encode(text, add_special_tokens=False).ids)


def check_tree(tree, text):
    assert tree.total == n_tokens(text)
    assert tree.sums[1, :2].tolist() == [len(text), len(text.encode())]
    assert np.array_equal(tree.sums[1 : tree.width], tree.sums[2::2] + tree.sums[3::2])
    at = 0
    for chars, size, tokens in tree.leaves.tolist():  # each leaf stands for itself
        assert tokens == 0 if not size else tokens > 0 and chars > 0
        at += size
    assert at == len(text.encode())


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 310), st.integers(0, 12), st.lists(PIECES, max_size=8).map("".join)), min_size=1, max_size=4))
def test_edits_equal_full_counts(text, edits):
    edits = [(a, a + n, t) for a, n, t in edits]
    trees = m.build(CODER, *utf8(pa.array([text])))
    check_tree(trees[0], text)
    texts = [bytearray(text.encode())]
    m.apply_edits(CODER, texts, [edits], trees)
    for a, b, t in edits:
        text = text[:a] + t + text[b:]
    assert texts[0].decode() == text
    check_tree(trees[0], text)


def test_only_the_region_is_read():
    """Also after many edits at one place, which would grow a leaf without bound if leaves never split."""
    rng = random.Random(2)
    text = " ".join(f"word{rng.randrange(9999)}" for _ in range(20000))
    trees, texts = m.build(CODER, *utf8(pa.array([text]))), [bytearray(text.encode())]
    again = m.apply_edits(CODER, texts, [[(5000, 5010, "new words"), (90000, 90000, "more")]], trees)
    check_tree(trees[0], texts[0].decode())
    assert again[0] < 1500
    for _ in range(40):
        again = m.apply_edits(CODER, texts, [[(5000, 5000, " and twenty more words that go in here, one after the other" * 3)]], trees)
        assert again[0] < 1500
    check_tree(trees[0], texts[0].decode())
    assert trees[0].leaves[:, m.TOKENS].max() < 10 * m.LEAF


def test_stored_trees_over_several_runs(spark):
    """Every run starts from what the last one left: texts, trees and counts agree with counting anew."""
    rng = random.Random(5)
    rows = [r for r in corpus(8) if r[0] is not None and r[0] != 5]
    texts = {r[0]: r[1] or "" for r in rows}
    trees = m.token_trees(frame(spark, rows), PATH)
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {d: n_tokens(t) for d, t in texts.items()}
    for _ in range(3):
        a, n, new = rng.randrange(300), rng.randrange(40), rng.choice(["", "it's <|endoftext|> new", "x" * 500])
        stored = materialize(trees, "trees")
        trees = m.edited(stored, F.array(F.struct(F.lit(a).alias("start"), F.lit(a + n).alias("end"), F.lit(new).alias("text"))), PATH)
        before, texts = texts, {d: t[:a] + new + t[a + n :] for d, t in texts.items()}
        got = trees.collect()
        assert {r.doc_id: (r.text, r.n_tokens, r.n_tokens_edited) for r in got} == {d: (t, n_tokens(before[d]), n_tokens(t)) for d, t in texts.items()}
        for r in got:
            check_tree(m.TokenTree.stored(np.array(r.tree)), r.text)


def test_frame(spark):
    rows = corpus(8)
    edits = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in ((3, 9, "it's"), (0, 0, None), (10**6, 10**6, " end"))))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_tokens_edited) for r in m.token_counts(frame(spark, rows), edits, PATH).collect())
    want = []
    for r in rows:
        t = r[1] or ""
        want.append((str(r[0]), n_tokens(t), n_tokens(t[:3] + "it's" + t[9:] + " end")))
    assert got == sorted(want)
    one = m.token_counts(frame(spark, rows), m.middle_edit(), PATH, keep=True).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    for r in one:
        t = texts[r.doc_id]
        n = len(t)
        new = t[: n // 3] + f" (edited: it's no. {'none' if r.doc_id is None else r.doc_id}) " + t[n // 3 + n // 50 :]
        assert r.text == new and r.n_tokens_edited == n_tokens(new) == r.tree[5] and r.n_bytes_edited == len(new.encode())
    assert m.token_counts(frame(spark, []), m.middle_edit(), PATH).count() == 0


def test_missing_trees_and_taken_names(spark):
    docs = frame(spark, corpus(8))
    trees = m.token_trees(docs, PATH).withColumn("tree", F.when(F.col("doc_id") % 2 == 0, F.col("tree")))
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("new").alias("text")))
    keep = lambda df: sorted(map(str, df.select("doc_id", "text", "n_tokens_edited", "tree").collect()))
    assert keep(m.edited(trees, edits, PATH)) == keep(m.edited(m.token_trees(docs, PATH), edits, PATH))
    for name in ("n_tokens", "Tree"):
        with pytest.raises(ValueError, match="rename"):
            m.token_trees(docs.withColumn(name, F.lit(1)), PATH)
