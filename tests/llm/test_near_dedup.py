import hashlib
import random
import re

import numpy as np
import pytest

import tickframe.llm.near_dedup as m

from .cases import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), (c := least.get(find(i)) if s else r[0]), r[0] == c) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def family(seed, n, length=80):
    """Near copies of one text with 0 to 6 changed words: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        out.append((1000 * seed + i, " ".join(w), None, None, None, None, None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, m.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_large_family(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 24)
    rows = family(3, 120) + family(4, 50, 300) + family(5, 10)
    assert sorted(map(tuple, m.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def chain(seed, n, length=60, step=6):
    """Texts of which each shares most with the next and nothing with far ones: one long family, few links in it."""
    rng = random.Random(seed)
    long = [f"c{rng.randrange(10**6)}" for _ in range(length + n * step)]
    return [(5000 + i, " ".join(long[i * step : i * step + length]), *[None] * 6) for i in range(n)]


@pytest.mark.parametrize("step", [6, 9])
def test_chained_family(spark, monkeypatch, step):
    monkeypatch.setattr(m, "BLOCK", 16)
    compared = []
    real = m._against_neighbours

    def counted(*args):
        found = real(*args)
        compared.append(found)
        return found

    monkeypatch.setattr(m, "_against_neighbours", counted)
    rows = chain(6, 200, step=step) + family(8, 40)
    assert sorted(map(tuple, m.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert compared


def test_many_lists(spark, monkeypatch):
    monkeypatch.setattr(m, "LISTS", 1)
    monkeypatch.setattr(m, "BATCH_ROWS", 20)
    rows = corpus(9) + family(3, 60)
    assert sorted(map(tuple, m.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_colliding_sums(spark, monkeypatch):
    """Unlike sets of one sum are told apart by their digests."""
    signed = spark.createDataFrame([(1, 7, b"a"), (2, 7, b"b"), (3, 7, b"a"), (4, 9, b"c"), (5, 0, None)], "doc_id long, node long, digest binary").selectExpr("*", "if(digest is null, 0, 3) as n_shingles")
    got = {r.doc_id: r.node for r in m._told_apart(signed).collect()}
    assert got[1] == got[3] == 7 and got[2] not in (7, 9) and got[4] == 9 and got[5] == 0


def test_string_ids(spark):
    rows = [(f"d{r[0]:04d}" if r[0] is not None else None, r[1]) for r in corpus(2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, m.near_duplicates(docs).collect()), key=str) == brute(rows)


def brute_kept(rows):
    """Indices of rows that stay; of rows alike in id and text, any one."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        if sets[i]:
            key = (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest(), i)
            first[find(i)] = min(first.get(find(i), key), key)
    return sorted([i for i, s in enumerate(sets) if not s] + [k[3] for k in first.values()])


@pytest.mark.parametrize("seed", [1, 4])
def test_rows_that_stay(spark, seed):
    """One row a group stays, whatever ids and texts repeat; no other text under a dropped id goes."""
    rng = random.Random(seed)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, b), (None, "alone in null"), (None, "alone in null"), (9, None), (9, None), (9, ""), (2, a + " x"), (2, a + " y"), (1, b + " z")]
    rows = [(d, t, *[None] * 6) for d, t in rows] + corpus(seed)
    rng.shuffle(rows)
    docs = frame(spark, rows)
    got = m.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str(rows[i][:2]) for i in brute_kept(rows))
    assert m.without_near_duplicates(frame(spark, [])).count() == 0


def test_empty_and_null(spark):
    assert m.near_duplicates(frame(spark, [])).count() == 0
    got = m.near_duplicates(frame(spark, [(1, None, None, None, None, None, None, None)])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True)]


def test_links_in_blocks():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(40)]
    i, j = m.links(sets, sets, width=7, height=9)
    want = {(a, b) for a in range(40) for b in range(40) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want
