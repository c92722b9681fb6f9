import hashlib

import pytest

from tickframe.llm import fingerprints as m
from tickframe.llm import ordered

from .cases import corpus, frame, in_order


def brute(spark, rows):
    docs = in_order(spark, rows)
    out = []
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        c = m.canonical
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), m.digest(c(t)), m.digest(c(e)), float(c(t) == c(e)), float(c(t) == c(nxt))))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3_000, 40_000, 64 << 20])
def test_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "RANGE_BYTES", size)
    rows = corpus(3)
    assert sorted((tuple(r)[:7] for r in m.fingerprints(frame(spark, rows)).collect()), key=str) == brute(spark, rows)


def test_one_and_none(spark):
    row = [(7, "abcd", None, None, None, None, None, None)]
    assert sorted(tuple(r)[:7] for r in m.fingerprints(frame(spark, row)).collect()) == brute(spark, row)
    assert m.fingerprints(frame(spark, [])).count() == 0


def test_groups(spark):
    texts = {1: "Straße  A", 2: "STRASSE a\n", 3: "strasse b", 4: None, 5: " ", 6: "ﬁn", 7: "fin", 8: "strasse a", 9: "alone"}
    rows = [(k, v, None, None, None, None, None, None) for k, v in texts.items()] + [(3, "strasse b", *[None] * 6)]
    got = {r.doc_id: (r.group_id, r.n_copies) for r in m.fingerprints(frame(spark, rows)).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 8: (1, 3), 3: (3, 2), 4: (4, 2), 5: (4, 2), 6: (6, 2), 7: (6, 2), 9: (9, 1)}


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "abcd"), ("a", "wxyz"), (None, "wxyz")], "doc_id string, text string")
    got = {r.doc_id: (r.group_id, r.near_next) for r in m.fingerprints(docs).collect()}
    assert got == {None: ("a", 1.0), "a": ("a", 0.0), "b": ("b", 0.0)}
