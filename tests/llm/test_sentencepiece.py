import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from tickframe.llm import sentencepiece_sampling as m
from tickframe.llm.common import U64, mix, utf8

from .cases import corpus, frame

PATH = P.path("piece_bpe_32k.model")
LATTICE = m.load(PATH)


def pieces_at(body, i, width):
    """(end, id, log weight) of the edges that leave byte i; width: bytes of the character there, 0 inside one."""
    out = []
    if width:
        known = TABLE
        for k in range(1, LATTICE.longest + 1):
            if i + k <= len(body) and body[i : i + k] in known:
                out.append((i + k, *known[body[i : i + k]]))
    return out


TABLE = {}
for where in range(len(LATTICE.keys)):
    if LATTICE.piece[where] >= 0:
        TABLE[LATTICE.bytes[LATTICE.piece[where]]] = (int(LATTICE.piece[where]), float(LATTICE.weight[where]))


def brute(text, key, seed):
    """Plain forward sums over the whole text and backward draws with the same numbers."""
    body = b" " + text.encode()
    edges = [[] for _ in range(len(body) + 1)]
    at = 0
    for c in " " + text:
        w = len(c.encode())
        for end, i, lw in pieces_at(body, at, w):
            edges[end].append((at, i, lw))
        if c.encode() not in TABLE:
            for k in range(w):
                edges[at + k + 1].append((at + k, int(LATTICE.byte_id[body[at + k]]), LATTICE.fallback))
        at += w
    total = [0.0] + [-math.inf] * len(body)
    for j in range(1, len(body) + 1):
        v = [total[a] + lw for a, _, lw in edges[j] if total[a] > -math.inf]
        total[j] = max(v) + math.log(sum(math.exp(x - max(v)) for x in v)) if v else -math.inf
    salt, out, j = mix(np.array([key], U64) ^ mix(np.array([seed], U64))), [], len(body)
    while j:
        draw = float((mix(salt + np.array([j], U64) * U64(0x9E3779B97F4A7C15)) >> U64(11))[0]) / (1 << 53)
        run, chosen = 0.0, None
        for a, i, lw in sorted(edges[j]):
            run += math.exp(total[a] + lw - total[j])
            chosen = (a, i)
            if draw < run:
                break
        out.append(chosen[1])
        j = chosen[0]
    return out[::-1]


TEXTS = ["", "the whole", "  two  blanks ", "a\nb\tc\r\n", "élan ñandú naïve", "漢字 and 😀!", "mark ▁ kept", "<s></s><unk> <0x41>", "\x00\x01", "x" * 400, "Entredeaux ouchement", "a" * 3 + " " * 40 + "b", "é̀ ẞ"]


@pytest.mark.parametrize("seed", [1, 9])
def test_brute_force(seed):
    data, offsets = utf8(pa.array(TEXTS))
    keys = np.arange(len(TEXTS)).astype(U64)
    ids, first = LATTICE.sample(data, offsets, keys, seed)
    for i, t in enumerate(TEXTS):
        own = ids[first[i] : first[i + 1]].tolist()
        assert LATTICE.decode(own) == t
        assert own == brute(t, i, seed), t


def test_distribution():
    n = 20000
    data, offsets = utf8(pa.array(["the"] * n))
    ids, first = LATTICE.sample(data, offsets, np.arange(n).astype(U64), 3)
    got = Counter(tuple(ids[first[i] : first[i + 1]].tolist()) for i in range(n))
    body, weight = b" the", {}

    def walk(i, path, lw):
        if i == len(body):
            weight[tuple(path)] = math.exp(lw)
            return
        for end, piece, w in pieces_at(body, i, 1):
            walk(end, [*path, piece], lw + w)

    walk(0, [], 0.0)
    total = sum(weight.values())
    for path, w in weight.items():
        assert abs(got[path] / n - w / total) < 4 * math.sqrt(w / total * (1 - w / total) / n) + 2e-3


def test_frame(spark, monkeypatch):
    rows = corpus(6)
    a = m.sample_pieces(frame(spark, rows), PATH)
    b = m.sample_pieces(frame(spark, rows).repartition(3), PATH)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.where("not lossless").count() == 0
    back = sorted(((str(r.doc_id), r.text) for r in m.decode_pieces(a, PATH).collect()))
    assert back == sorted((str(r[0]), r[1] or "") for r in rows)
    assert m.sample_pieces(frame(spark, []), PATH).count() == 0


def test_random_unicode():
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([32, 97, 101, 0xE9, 0x2581, rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(40)]
    data, offsets = utf8(pa.array(texts))
    ids, first = LATTICE.sample(data, offsets, np.arange(40).astype(U64), 1)
    for i, t in enumerate(texts):
        assert LATTICE.decode(ids[first[i] : first[i + 1]].tolist()) == t


def test_rows_without_a_text_id_have_keys_of_their_own(spark):
    text = "a longer text that has many ways to be cut, and then some more of it"
    docs = spark.createDataFrame([(None, text), (None, text + "!"), (None, text + "?"), ("k", text)], "doc_id string, text string")
    found = m.sample_pieces(docs, PATH).collect()
    assert len({tuple(r.ids[:12]) for r in found}) > 1 and all(r.lossless for r in found)
