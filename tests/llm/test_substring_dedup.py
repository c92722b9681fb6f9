import hashlib
import re
from collections import Counter

import pytest

from tickframe.llm.substring_dedup import substring_dedup

from .cases import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [2, 5, 35])
@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, window, seed, monkeypatch):
    import tickframe.llm.substring_dedup as m

    monkeypatch.setattr(m, "CHUNK_BYTES", 30_000)
    monkeypatch.setattr(m, "BUCKET_BYTES", 50_000)
    rows = corpus(seed)
    got = sorted(map(tuple, substring_dedup(frame(spark, rows), window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty(spark):
    assert substring_dedup(frame(spark, [])).count() == 0


def test_all_null(spark):
    got = substring_dedup(frame(spark, [(1, None, None, None, None, None, None, None)]), keep_text=False).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]
