import random
import re

import pyarrow as pa
import pytest

import tickframe.llm.decontaminate as m
from tickframe.llm.common import utf8

from .cases import corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add("null" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, met = words(r[1]), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if who := wins.get(tuple(w[j : j + k])):
                    met |= who
                    hit |= set(range(j, j + k))
        out.append((r[0], len(w), len(hit), len(met), m.items_digest(met), bool(hit), sorted(met)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 10])
@pytest.mark.parametrize("size", [1 << 20, 300])
def test_brute_force(spark, window, size, monkeypatch):
    monkeypatch.setattr(m, "PASS_BYTES", size)
    rows, rng = corpus(5), random.Random(5)
    items = [(1, None), (2, ""), (3, "..."), (10, "two three"), (None, "w1 W2! w3, w4")]
    for i in range(20):
        t = rng.choice([r[1] for r in rows if r[1]]).split()
        a = rng.randrange(len(t))
        items.append((20 + i % 15, " ,".join(t[a : a + rng.randint(1, 30)]).upper()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = m.contamination(frame(spark, rows), bench, window).collect()
    assert sorted((tuple(r)[:6] + (r["items"],) for r in found), key=str) == brute(rows, items, window)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        if r.doc_id is not None and r.doc_id != 5:
            inside = [w for s in r.spans for w in words(texts[r.doc_id][s.start : s.end])]
            assert len(inside) == r.n_hit
    clean = m.without_contaminated(frame(spark, rows), bench, window)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(not b[5] for b in brute(rows, items, window))


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert m.contamination(frame(spark, []), none).count() == 0
    assert m.contamination(frame(spark), none).where("contaminated").count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_matcher_on_dense_repeats(seed, monkeypatch):
    """Few words, overlapping and nested windows, short items, pieces that cut runs anywhere."""
    rng = random.Random(seed)
    for _ in range(12):
        window, words_ = rng.choice([2, 3, 4, 10]), rng.choice([1, 2, 3, 6, 30])
        monkeypatch.setattr(m, "PIECE", rng.choice([1, 5, 64]))
        items = [(str(i), " ".join(f"w{rng.randrange(words_)}" for _ in range(rng.randint(0, 25)))) for i in range(rng.randint(1, 12))]
        rows = [(i, " ".join(f"w{rng.randrange(words_ + 1)}" for _ in range(rng.randint(0, 300)))) for i in range(6)]
        matcher = m.Matcher(m.build(items, window))
        hit, first, met = matcher.scan(*utf8(pa.array([r[1] for r in rows])))
        got = [(i, int(b - a), int(hit[a:b].sum()), sorted(matcher.a["names"][x] for x in met.get(i, ()))) for i, (a, b) in enumerate(zip(first[:-1], first[1:]))]
        assert got == [(b[0], b[1], b[2], b[6]) for b in brute(rows, items, window)]


def test_one_pass_for_a_large_benchmark(spark):
    """Size does not change the plan: a benchmark of megabytes is one automaton in one narrow pass."""
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(20000)}" for _ in range(60))) for i in range(8000)]
    docs = frame(spark, [(i, f"start {items[i * 7][1]} end", *[None] * 6) for i in range(50)])
    found = m.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert all((r.n_hit, r["items"]) == (60, [str(r.doc_id * 7)]) for r in found.collect())
