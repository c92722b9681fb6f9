import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tickframe.llm import attention
from tickframe.llm.attention import PAD, Attention, Vocabulary, windows
from tickframe.llm.lm_scoring import Chunk, language_model_scores, packed, unpacked

from .cases import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_base(rows):
    """Columns but the model's score, a row each."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])) for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    ends = held.count(False)
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    score = lambda k: math.log10((k + 1) / (n + 1 * (v + 1)))
    return [(r[0], h, len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, sum(score(c[w]) for w in ws) + score(ends)) for r, ws, h in zip(rows, words, held)]


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = np.append(rng.integers(0, 50, 1999), 30.0)
    model = Attention(Vocabulary(counts.astype(float), rng.random(2000) < 0.4))
    for w in model.weights.values():
        w += rng.standard_normal(w.shape).astype(np.float32) * 0.2
    return model


def plain_log_prob(model, tokens, end):
    """One token after the other, each with the block before its own and its own so far."""
    w, v, b = model.weights, model.vocabulary, attention.BLOCK
    stream, out = [end, *tokens], 0.0
    for i, target in enumerate([*tokens, end]):
        keys = stream[max(0, i // b * b - b) : i + 1]
        e = w["embed"][v.inputs[keys].astype(int)].astype(float)
        s = (e @ w["key"]) @ (e[-1] @ w["query"]) / math.sqrt(attention.WIDTH) + w["distance"][[len(keys) - 1 - k for k in range(len(keys))]]
        p = np.exp(s - s.max())
        h = np.maximum(e[-1] @ w["own"] + p @ (e @ w["value"]) / p.sum(), 0)
        g, m = divmod(int(v.member[target]), attention.MEMBERS)
        for logits, k in ((h @ w["group"] + w["group_bias"], g), (h @ w["in_group"][g] + w["in_group_bias"][g], m)):
            out += logits[k] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
        out += float(v.inside[target])
    return out


def test_windows_score_each_token_once():
    model, rng, end = small_model(), np.random.default_rng(1), 1999
    sizes = [0, 1, 5, attention.BLOCK - 1, attention.BLOCK, 3 * attention.BLOCK + 2, 0, 200]
    first = np.append(0, np.cumsum(sizes))
    tokens = rng.integers(0, 2000, first[-1])
    got = model.scores(tokens, first, end)
    for i in range(len(sizes)):
        assert got[i] == pytest.approx(plain_log_prob(model, tokens[first[i] : first[i + 1]].tolist(), end), abs=2e-3)
    assert model.scores(tokens[:0], np.zeros(1, np.int64), end).tolist() == []


def test_every_next_token_has_a_share():
    model = small_model(2)
    before = [3, 14, 15, 92]
    first = np.arange(2001) * 5
    tokens = np.column_stack([np.tile(before, (2000, 1)), np.arange(2000)]).ravel()
    ahead = model.scores(np.array(before), np.array([0, 4]), 1999)[0]
    ends = np.array([plain_log_prob(model, [*before, t], 1999) for t in range(0, 2000, 100)])
    whole = model.scores(tokens, first, 1999)
    assert np.allclose(whole[::100], ends, atol=2e-3)
    # P(before, t) over all t: take each one's end step away again
    log_end = lambda t: plain_log_prob(model, [*before, t], 1999) - _without_end(model, [*before, t])
    total = sum(math.exp(whole[t] - log_end(t)) for t in range(2000))
    assert total == pytest.approx(math.exp(_without_end(model, before)), rel=2e-3) and ahead < 0


def _without_end(model, tokens):
    """Log probability of the tokens, whatever follows them: the end's step is taken away."""
    end = 1999
    stream_model = plain_log_prob(model, tokens, end)
    w, v, b = model.weights, model.vocabulary, attention.BLOCK
    i = len(tokens)
    keys = [end, *tokens][max(0, i // b * b - b) : i + 1]
    e = w["embed"][v.inputs[keys].astype(int)].astype(float)
    s = (e @ w["key"]) @ (e[-1] @ w["query"]) / math.sqrt(attention.WIDTH) + w["distance"][[len(keys) - 1 - k for k in range(len(keys))]]
    p = np.exp(s - s.max())
    h = np.maximum(e[-1] @ w["own"] + p @ (e @ w["value"]) / p.sum(), 0)
    g, m = divmod(int(v.member[end]), attention.MEMBERS)
    last = float(v.inside[end])
    for logits, k in ((h @ w["group"] + w["group_bias"], g), (h @ w["in_group"][g] + w["in_group_bias"][g], m)):
        last += logits[k] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
    return stream_model - last


def test_gradients_against_differences():
    model, rng, n, b = small_model(3), np.random.default_rng(4), 3, attention.BLOCK
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    x = rng.integers(0, model.vocabulary.n_inputs - 1, (n, 2 * b))
    x[0, :b] = model.vocabulary.n_inputs - 1
    y, real = rng.integers(0, attention.GROUPS * attention.MEMBERS, (n, b)), rng.random((n, b)) < 0.8
    _, g = model.gradients(x, y, real)
    for name, w in model.weights.items():
        spots = np.argsort(-np.abs(g[name]).ravel())[:4]
        for at in spots:
            old, eps = w.ravel()[at], 1e-5
            w.reshape(-1)[at] = old + eps
            up = model.gradients(x, y, real)[0]
            w.reshape(-1)[at] = old - eps
            down = model.gradients(x, y, real)[0]
            w.reshape(-1)[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[name].ravel()[at], rel=2e-2, abs=1e-5), name


def test_training_learns_and_windows_are_whole():
    rng, end = np.random.default_rng(5), 1999
    tokens = np.tile(rng.integers(0, 300, 7), 300)
    row, b = np.zeros(2100 // attention.BLOCK + 1, np.int64), attention.BLOCK
    found = windows(tokens, np.array([0, 2100]), end, row, np.arange(len(row)))
    stream = [PAD] * b + [end, *tokens.tolist(), end] + [PAD] * b
    assert all(w.tolist() == (stream[b * i : b * i + 2 * b + 1] + [PAD] * 2 * b)[: 2 * b + 1] for i, w in enumerate(found))
    model = Attention(Vocabulary(np.bincount(tokens, minlength=2000).astype(float), rng.random(2000) < 0.5))
    before = model.scores(tokens, np.array([0, 2100]), end)[0]
    losses = model.train(found, 30)
    assert losses[-1] < 0.5 * losses[0] and model.scores(tokens, np.array([0, 2100]), end)[0] > 0.5 * before


def test_chunk_numbers_words():
    from tickframe.llm.common import utf8
    import pyarrow as pa

    texts = ["B a b", None, "", "a\tÉ é", "b " * 9]
    chunk = Chunk(*utf8(pa.array(texts, pa.string())), np.array([True, True, True, False, True]))
    words = chunk.words().to_pylist()
    assert words == ["b", "a", "É", "é"] and chunk.counts.tolist() == [11, 1, 0, 0]
    assert [words[i] for i in chunk.local] == "b a b a É é b b b b b b b b b".split() and chunk.first.tolist() == [0, 3, 3, 3, 6, 15]
    assert unpacked(packed(np.array([0, 5, 1 << 31]))).tolist() == [0, 5, 1 << 31] and len(unpacked(packed(np.zeros(0)))) == 0


@pytest.mark.parametrize("chunk_bytes", [None, 1000])
def test_against_plain_counts(spark, monkeypatch, chunk_bytes):
    rows = corpus()
    docs = frame(spark, rows).repartition(3)
    if chunk_bytes:  # many chunks: set before workers start theirs
        from tickframe.llm import lm_scoring

        monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk_bytes)
    got = language_model_scores(docs, PATH).collect()
    shown = lambda t: tuple(repr(x) if not isinstance(x, float) else f"{x:.6f}" for x in t)
    assert sorted(shown(r[:6]) for r in got) == sorted(shown(t) for t in plain_base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    long = {r.doc_id: r for r in got}
    assert long[6].score / long[6].n_tokens > 3 * long[7].score  # prose of known words against one word of 50,000 letters


def test_every_training_window_is_learnt_from(spark, monkeypatch):
    """Tasks learn from as many windows as the training documents have, and a chunk's windows hold each target once."""
    from tickframe.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(lm_scoring, "WINDOWS_AT_ONCE", 5)
    rows = corpus()
    chunks, coder = lm_scoring.chunked(frame(spark, rows).repartition(3), PATH), lm_scoring.bpe.load(PATH)
    spelled = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    want, targets = 0, Counter()
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", spelled(r[1])) for i in coder.tokenizer.encode(" " + w, add_special_tokens=False).ids]
            want += -(-(len(ids) + 1) // attention.BLOCK)
            targets.update([*ids, coder.size])
    model = Attention(Vocabulary(np.ones(coder.size + 1), np.arange(coder.size + 1) % 2 == 0))
    assert sum(r.n for r in lm_scoring.refined(chunks, model, coder.size, 0).collect()) == want
    got, table = Counter(), chunks.where("n_windows > 0").select(lm_scoring.PARTS).toArrow().combine_chunks()
    for _, n, cut in lm_scoring._training(table.to_batches()[0], coder.size):
        last = cut(np.arange(n))[:, attention.BLOCK + 1 :]
        got.update(last[last != PAD].tolist())
        assert np.array_equal(cut(np.arange(1, n, 3)), cut(np.arange(n))[1::3])
    assert got == targets


def test_rows_are_learnt_as_their_windows():
    """Blocks laid out once give the same steps as windows cut one by one, rows without tokens and of a block's length among them."""
    rng, end, b = np.random.default_rng(6), 1999, attention.BLOCK
    sizes = np.array([0, 1, b - 1, b, 5 * b + 3, 0, 40 * b])
    first = np.append(0, np.cumsum(sizes))
    tokens, blocks = rng.integers(0, 2000, first[-1]), sizes // b + 1
    row = np.repeat(np.arange(len(sizes)), blocks)
    cut = windows(tokens, first, end, row, np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    one, other = small_model(8), small_model(8)
    assert one.learn_rows(tokens, first, end, 0.01, 3, 8) == len(cut) == blocks.sum()
    other.train(cut, 1, 0.01, 3, 8)
    assert all(np.allclose(w, other.weights[k], atol=1e-5) for k, w in one.weights.items())
    assert not np.array_equal(one.weights["query"], small_model(8).weights["query"])


def test_a_step_uses_the_arrays_of_the_one_before():
    """Fresh arrays of some 10 MB a step took as long as what is done with them."""
    model, rng, n, b = small_model(9), np.random.default_rng(10), 256, attention.BLOCK
    x, y = rng.integers(0, model.vocabulary.n_inputs - 1, (n, 2 * b)), rng.integers(0, attention.GROUPS * attention.MEMBERS, (n, b))
    room, real = attention.Room(), np.ones((n, b), bool)
    before = model.gradients(x, y, real, room)
    tracemalloc.start()
    after = model.gradients(x, y, real, room)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20
    assert before[0] == after[0] and all(np.array_equal(g, after[1][k]) for k, g in before[1].items())


def test_steps_stay_finite_where_every_share_is_tiny():
    model, rng, n, b = small_model(12), np.random.default_rng(13), 4, attention.BLOCK
    for name in ("distance", "group_bias", "in_group_bias"):
        model.weights[name] -= 500
    x, y = rng.integers(0, model.vocabulary.n_inputs - 1, (n, 2 * b)), rng.integers(0, attention.GROUPS * attention.MEMBERS, (n, b))
    loss, g = model.gradients(x, y, np.ones((n, b), bool))
    assert math.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())


def test_sums_by_id():
    rng = np.random.default_rng(11)
    places, d = np.minimum(rng.zipf(1.5, (50, 40)), 299).astype(np.uint16), rng.standard_normal((2000, 6))
    want = np.zeros((300, 6))
    np.add.at(want, places.ravel(), d)
    assert (np.bincount(places.ravel()) > attention.FREQUENT).any() and np.allclose(attention._by_id(places, d, 300, attention.Room()), want)


def test_edges(spark):
    assert language_model_scores(frame(spark, []), PATH).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = frame(spark, [(held, "nothing to learn from", None, None, None, None, 1, 1)])
    r = language_model_scores(only, PATH).first()
    assert r.held_out and (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (5, 0, 0, 0.0) and r.score < 0
    named = language_model_scores(only.selectExpr("'x' as doc_id", "cast(null as string) as text"), PATH).first()
    assert named.doc_id == "x" and named.n_tokens == 1
