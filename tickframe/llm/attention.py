"""A small causal self-attention model over subword ids, trained and applied in numpy.

A text is a stream: the end id, its subwords, the end id. Streams are cut into blocks of ``BLOCK`` places; each
block's queries see the keys of the block before and of their own up to themselves, so windows of 2 * BLOCK
places overlap by half and every token is scored once. One head, one layer: keys, queries and values depend
on a token's id alone and are looked up. The next token is predicted in two steps, its group and its member in
the group; rare ids share a member, and have their share of it by counts over the whole corpus. Every id has
a probability, seen or not.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

BLOCK, WIDTH = 16, 32
#: Groups of predicted members, and members of a group; the last one stands for the group's rarer ids.
GROUPS, MEMBERS = 32, 32
#: Ids that have an input vector of their own; others have their member's.
INPUTS = 1024
BATCH, RATE = 32, 0.016
#: Blocks, and tokens, that are scored at once: temporary arrays stay in the CPU's cache.
BLOCKS_AT_ONCE, TOKENS_AT_ONCE = 128, 4096
#: Windows whose gradients are made at once, for the same reason; places of a step from which an id counts as frequent.
WINDOWS_AT_ONCE, FREQUENT = 64, 32
PAD = np.iinfo(np.uint32).max
_NEVER = np.float32(-1e9)


class Vocabulary:
    """Members of ids, and the probability of each id in its member, from counts of all training subwords.

    ``heads`` tells which ids start a word: one half of the groups holds these, the other half the others, by falling
    count. The rarer ids of a side are dealt to its groups' last members in parts of about the same count.
    """

    def __init__(self, counts: np.ndarray, heads: np.ndarray):
        size, half, single = len(counts), GROUPS // 2, MEMBERS - 1
        order = np.lexsort((np.arange(size), -counts))
        self.member = np.zeros(size, np.int64)
        for side in (0, 1):
            mine = order[heads[order] == bool(side)]
            own, rest = mine[: half * single], mine[half * single :]
            at = np.arange(len(own))
            self.member[own] = (side * half + at // single) * MEMBERS + at % single
            if len(rest):
                mass = counts[rest] + 1.0
                part = np.minimum((np.cumsum(mass) - mass) * half // mass.sum(), half - 1).astype(np.int64)
                self.member[rest] = (side * half + part) * MEMBERS + single
        mass = np.bincount(self.member, counts + 1.0, GROUPS * MEMBERS)
        self.inside = np.log((counts + 1.0) / mass[self.member]).astype(np.float32)
        mass = np.maximum(mass, 1e-9).reshape(GROUPS, MEMBERS)
        self.group_log = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        self.member_log = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        self.inputs = INPUTS + self.member
        self.inputs[order[:INPUTS]] = np.arange(min(INPUTS, size))
        self.n_inputs = INPUTS + GROUPS * MEMBERS + 1  # the last one is no token
        self.member, self.inputs = self.member.astype(np.uint16), self.inputs.astype(np.uint16)


def _powers(x: np.ndarray) -> None:
    """Powers of e in place, each row's highest 1: no row's sum is 0 or infinite, whatever steps have made of the weights."""
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)


def _exp(x: np.ndarray) -> np.ndarray:
    """Powers of e in place, scaled a row where one would overflow."""
    top = x.max()
    if top > 60:
        x -= x.max(-1, keepdims=True)
    return np.exp(x, out=x)


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of each row's softmax at one place."""
    own = logits[np.arange(len(logits)), at]
    top = logits.max()
    if top > 60:
        own -= (highest := logits.max(1))
        logits -= highest[:, None]
    return own - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))


def _causal() -> np.ndarray:
    """0 where a query may see a key of its window, else never."""
    q, k = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
    return np.where(k <= q, np.float32(0), _NEVER)


#: Distance of a query to a key; those that it may not see have distance 0.
_DISTANCE = np.maximum(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :], 0)
_CAUSAL = _causal()


class Room(dict):
    """Arrays by name that are used again from step to step: fresh ones of this size cost more than what is done with them."""

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size:
            self[name] = np.empty(size, kind)
        return self[name][:size].reshape(shape)


def _by_id(places: np.ndarray, d: np.ndarray, n: int, room: Room) -> np.ndarray:
    """Sums (n, columns) of the rows of ``d`` by number. Frequent numbers are added up one by one, the others side by side."""
    order, sizes = np.argsort(places.ravel(), kind="stable"), np.bincount(places.ravel(), minlength=n)
    first, ranked, out = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable"), np.zeros((n, d.shape[1]), d.dtype)
    frequent, there = np.searchsorted(-sizes[ranked], [-FREQUENT, 0])
    dealt, one = d.take(order, 0, room("dealt", d.dtype, *d.shape), "clip"), np.ones(int(sizes.max()), d.dtype)
    for i in ranked[:frequent].tolist():
        np.matmul(one[: sizes[i]], dealt[first[i] : first[i] + sizes[i]], out=out[i])
    rest = ranked[frequent:there]
    if len(rest):
        at, left = first[rest], -sizes[rest]
        mine = dealt.take(at, 0)
        for k, m in enumerate(np.searchsorted(left, -np.arange(1, -left[0])).tolist(), 1):
            mine[:m] += dealt.take(at[:m] + k, 0)
        out[rest] = mine
    return out


class Attention:
    """Weights by name. All start small, predictions at the frequencies in the corpus."""

    def __init__(self, vocabulary: Vocabulary, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        self.vocabulary = vocabulary
        rng, d = np.random.default_rng(seed), WIDTH
        near = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = weights or {
            "embed": (0.5 * rng.standard_normal((vocabulary.n_inputs, d))).astype(np.float32), "query": near(d, d), "key": near(d, d), "value": near(d, d), "own": near(d, d), "distance": np.zeros(2 * BLOCK, np.float32),
            "group": np.zeros((d, GROUPS), np.float32), "group_bias": vocabulary.group_log.copy(), "in_group": np.zeros((GROUPS, d, MEMBERS), np.float32), "in_group_bias": vocabulary.member_log.copy(),
        }

    # ----------------------------------------------------------------- training
    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradients. x: (n, 2 * BLOCK) inputs, the first BLOCK all tokens or none; y: (n, BLOCK) members, counted where ``real``."""
        w, none, n, d = self.weights, self.vocabulary.n_inputs - 1, len(x), WIDTH
        kind, scale, room = w["embed"].dtype, np.float32(1 / np.sqrt(WIDTH)), Room() if room is None else room
        # Keys, queries and values depend on ids alone: they are made, and their gradients added up, once for each id.
        seen = np.bincount(x.ravel(), minlength=none + 1)
        ids = np.flatnonzero(seen)
        rank = np.zeros(none + 1, np.uint16)
        rank[ids] = np.arange(len(ids))
        at, e = rank[x], w["embed"][ids]
        late, fresh = at[:, BLOCK:], x[:, 0] == none
        key_value, query_own = e @ np.hstack([w["key"], w["value"]]), e @ np.hstack([w["query"] * scale, w["own"]])
        bias = w["distance"][_DISTANCE] + _CAUSAL
        kv, q, p = room("kv", kind, n, 2 * BLOCK, 2 * d), room("q", kind, n, BLOCK, 2 * d), room("p", kind, n, BLOCK, 2 * BLOCK)
        att, share, h = room("att", kind, n, BLOCK, d), room("share", kind, n, BLOCK, 1), room("h", kind, n, BLOCK, d)
        parts = [slice(a, a + WINDOWS_AT_ONCE) for a in range(0, n, WINDOWS_AT_ONCE)]
        for here in parts:
            key_value.take(at[here], 0, kv[here], "clip")
            query_own.take(late[here], 0, q[here], "clip")
            np.matmul(q[here, :, :d], kv[here, :, :d].transpose(0, 2, 1), out=p[here])
            p[here] += bias
            p[here][fresh[here], :, :BLOCK] = _NEVER
            _powers(p[here])
            np.divide(1, (p[here].reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, kind)).reshape(-1, BLOCK, 1), out=share[here])
            z = np.matmul(p[here], kv[here, :, d:], out=att[here])
            z *= share[here]
            np.add(z, q[here, :, d:], out=h[here])
            np.maximum(h[here], 0, out=h[here])
        loss, d_z, g = self._predicted_gradients(h.reshape(-1, d), y.ravel(), real.ravel(), room)
        d_z, d_kv, d_qo, d_bias = d_z.reshape(h.shape), room("d_kv", kind, n, 2 * BLOCK, 2 * d), room("d_qo", kind, n, BLOCK, 2 * d), np.zeros(bias.shape, kind)
        d_z *= h > 0
        d_qo[..., d:] = d_z
        d_z *= share
        for here in parts:
            own, d_s = d_z[here], room("d_s", kind, len(at[here]), BLOCK, 2 * BLOCK)
            np.matmul(p[here].transpose(0, 2, 1), own, out=d_kv[here, :, d:])
            np.matmul(own, kv[here, :, d:].transpose(0, 2, 1), out=d_s)
            d_s -= np.einsum("abc,abc->ab", own, att[here])[..., None]
            d_s *= p[here]
            np.matmul(d_s, kv[here, :, :d], out=d_qo[here, :, :d])
            np.matmul(d_s.transpose(0, 2, 1), q[here, :, :d], out=d_kv[here, :, :d])
            d_bias += d_s.sum(0)
        g["distance"] = np.bincount(_DISTANCE.ravel(), (d_bias * (_CAUSAL == 0)).ravel(), 2 * BLOCK).astype(kind)
        by_key, by_query = _by_id(at, d_kv.reshape(-1, 2 * d), len(ids), room), _by_id(late, d_qo.reshape(-1, 2 * d), len(ids), room)
        by_query[:, :d] *= scale
        for made, (one, other) in ((by_key, ("key", "value")), (by_query, ("query", "own"))):
            both = e.T @ made
            g[one], g[other] = both[:, :d], both[:, d:]
        g["embed"] = np.zeros_like(w["embed"])
        g["embed"][ids] = by_key @ np.vstack([w["key"].T, w["value"].T]) + by_query @ np.vstack([w["query"].T, w["own"].T])
        return loss, g

    def _predicted_gradients(self, h: np.ndarray, y: np.ndarray, real: np.ndarray, room: Room) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean loss of the members y that follow the states h, the gradient of the states, and of the weights of predictions."""
        w, kind, used = self.weights, h.dtype, np.flatnonzero(real)
        group = (y[used] // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        used, group = used[order], group[order]  # a group's states stand together
        own = h.take(used, 0, room("own", kind, len(used), WIDTH), "clip")
        cuts, count = np.append(0, np.cumsum(np.bincount(group, minlength=GROUPS))), max(1, len(used))
        groups = [(i, slice(cuts[i], cuts[i + 1])) for i in np.flatnonzero(np.diff(cuts)).tolist()]
        g = {k: np.zeros_like(w[k]) for k in ("in_group", "in_group_bias")}
        d_own, one, other, loss = room("d_own", kind, *own.shape), room("one", kind, len(used), GROUPS), room("other", kind, len(used), MEMBERS), 0.0
        np.matmul(own, w["group"], out=one)
        one += w["group_bias"]
        for i, here in groups:
            np.matmul(own[here], w["in_group"][i], out=other[here])
            other[here] += w["in_group_bias"][i]
        for prob, right in ((one, group), (other, y[used] % MEMBERS)):
            _powers(prob)
            prob *= (1 / (prob @ np.ones(prob.shape[1], kind)))[:, None]
            place = np.arange(0, prob.size, prob.shape[1]) + right
            flat = prob.reshape(-1)
            loss -= float(np.log(np.maximum(flat[place], 1e-30)).sum())
            flat[place] -= 1
            prob *= kind.type(1 / count)
        g["group"], g["group_bias"] = own.T @ one, one.sum(0)
        for i, here in groups:
            np.matmul(other[here], w["in_group"][i].T, out=d_own[here])
            np.matmul(own[here].T, other[here], out=g["in_group"][i])
            np.add.reduce(other[here], 0, out=g["in_group_bias"][i])
        d_own += one @ w["group"].T
        d_h = room("d_h", kind, *h.shape)
        d_h.fill(0)
        d_h[used] = d_own
        return loss / count, d_h, g

    def train(self, windows: np.ndarray, epochs: int = 1, rate: float = RATE, seed: int = 1, batch: int = BATCH) -> list[float]:
        """Adam over windows (n, 2 * BLOCK + 1) of ids, ``PAD`` where there is none; the loss of each batch."""
        there = windows != PAD
        ids = np.where(there, windows, 0)
        x = np.where(there, self.vocabulary.inputs[ids], self.vocabulary.inputs.dtype.type(self.vocabulary.n_inputs - 1))[:, :-1]
        late = slice(BLOCK + 1, None)
        return self.learn(lambda i: (x[i], self.vocabulary.member[ids[i, late]], there[i, late]), len(windows), epochs, rate, seed, batch)

    def learn(self, cut: Callable[[np.ndarray], tuple[np.ndarray, ...]], n: int, epochs: int, rate: float, seed: int, batch: int) -> list[float]:
        """Adam over n windows; ``cut`` gives the inputs, members and real places of those asked for. The loss of each batch."""
        rng, room, losses = np.random.default_rng(seed), Room(), []
        flat = np.concatenate([w.ravel() for w in self.weights.values()])
        ends = np.cumsum([w.size for w in self.weights.values()])
        self.weights = {k: part.reshape(w.shape) for (k, w), part in zip(self.weights.items(), np.split(flat, ends[:-1]))}  # views of one array
        mean, square, g, more, step = *(np.zeros_like(flat) for _ in range(4)), 0
        total = epochs * -(-n // batch)
        for _ in range(epochs):
            shuffled = rng.permutation(n)
            for i in range(0, n, batch):
                loss, found = self.gradients(*cut(shuffled[i : i + batch]), room)
                np.concatenate([found[k].ravel() for k in self.weights], out=g)
                losses.append(loss)
                step += 1
                now = rate * (1 - (step - 1) / total)
                np.subtract(g, mean, out=more)
                more *= 0.1
                mean += more
                np.multiply(g, g, out=g)
                g -= square
                g *= 0.01
                square += g
                np.multiply(square, 1 / (1 - 0.99**step), out=g)
                np.sqrt(g, out=g)
                g += 1e-8
                np.divide(mean, g, out=more)
                more *= now / (1 - 0.9**step)
                flat -= more
        return losses

    # ----------------------------------------------------------------- scoring
    def _tables(self) -> tuple[np.ndarray, ...]:
        w = self.weights
        e = w["embed"]
        return e @ w["query"] * np.float32(1 / np.sqrt(WIDTH)), e @ w["key"], e @ w["value"], e @ w["own"]

    def scores(self, tokens: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
        """Natural log probability of each row's stream: ``tokens[first[i]:first[i + 1]]``, then the end id."""
        rows, v = len(first) - 1, self.vocabulary
        if not rows:
            return np.zeros(0)
        place, block, x, member = self._laid(tokens, first, end)
        starts, inside = first[:-1] + np.arange(rows), np.empty(len(place), np.float32)
        inside[np.arange(len(tokens)) + np.repeat(np.arange(rows), np.diff(first))] = v.inside[tokens]
        inside[first[1:] + np.arange(rows)] = v.inside[end]
        fresh = np.zeros(len(x), bool)
        fresh[block[:-1]] = True
        logs = self._predicted(self._hidden(x, fresh)[place], member)
        return np.add.reduceat((logs + inside).astype(float), starts)

    def _laid(self, tokens: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
        """(place of each target, first block of each row, inputs (blocks, BLOCK), members of the targets)."""
        rows, v = len(first) - 1, self.vocabulary
        place, block = places(first)
        at = np.arange(len(tokens)) + np.repeat(np.arange(rows), np.diff(first))  # of tokens among all targets
        before, member = np.empty(len(place), v.inputs.dtype), np.empty(len(place), v.member.dtype)
        before[at + 1] = v.inputs[tokens]
        before[first[:-1] + np.arange(rows)] = v.inputs[end]
        member[at], member[first[1:] + np.arange(rows)] = v.member[tokens], v.member[end]
        x = np.full(int(block[-1]) * BLOCK, v.n_inputs - 1, v.inputs.dtype)
        x[place] = before
        return place, block, x.reshape(-1, BLOCK), member

    def learn_rows(self, tokens: np.ndarray, first: np.ndarray, end: int, rate: float, seed: int, batch: int) -> int:
        """One pass over all windows of all rows, as ``scores`` and ``windows`` cut them; how many these are."""
        place, block, x, member = self._laid(tokens, first, end)
        n = len(x)
        y, real = np.zeros(n * BLOCK, member.dtype), np.zeros(n * BLOCK, bool)
        y[place], real[place] = member, True
        y, real, before = y.reshape(-1, BLOCK), real.reshape(-1, BLOCK), np.arange(n)
        x = np.vstack([np.full((1, BLOCK), self.vocabulary.n_inputs - 1, x.dtype), x])
        before[block[:-1]] = 0  # none
        self.learn(lambda i: (np.hstack([x[before[i]], x[i + 1]]), y[i], real[i]), n, 1, rate, seed, batch)
        return n

    def _hidden(self, x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The state after every place; a fresh block sees none before it."""
        query, key, value, own = self._tables()
        seen, none = self.weights["distance"][_DISTANCE] + _CAUSAL, self.vocabulary.n_inputs - 1
        before = np.vstack([np.full((1, BLOCK), none, x.dtype), x[:-1]])
        before[fresh] = none
        window, out = np.hstack([before, x]), np.empty((*x.shape, WIDTH), np.float32)
        for a in range(0, len(x), BLOCKS_AT_ONCE):
            here = slice(a, a + BLOCKS_AT_ONCE)
            s = query.take(x[here], 0) @ key.take(window[here], 0).transpose(0, 2, 1)
            s += seen
            s[fresh[here], :, :BLOCK] = _NEVER
            att = _exp(s) @ value.take(window[here], 0)
            att /= (s.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, np.float32)).reshape(*x[here].shape, 1)
            att += own.take(x[here], 0)
            np.maximum(att, 0, out=out[here])
        return out.reshape(-1, WIDTH)

    def _predicted(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log probability of the member y that follows each state: of its group, then of it in the group."""
        w, group, inner, out = self.weights, (y // MEMBERS).astype(np.uint8), (y % MEMBERS).astype(np.int64), np.empty(len(y), np.float32)
        for a in range(0, len(h), TOKENS_AT_ONCE):
            here = slice(a, a + TOKENS_AT_ONCE)
            out[here] = _log_share(h[here] @ w["group"] + w["group_bias"], group[here])
        order = np.argsort(group, kind="stable")
        cuts, inner = np.searchsorted(group[order], np.arange(GROUPS + 1)), inner[order]
        for i in range(GROUPS):
            for a in range(cuts[i], cuts[i + 1], TOKENS_AT_ONCE):
                b = min(a + TOKENS_AT_ONCE, cuts[i + 1])
                out[order[a:b]] += _log_share(h.take(order[a:b], 0) @ w["in_group"][i] + w["in_group_bias"][i], inner[a:b])
        return out


def places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each target in blocks, first block of each row): a row has one target more than tokens."""
    sizes = np.diff(first) + 1
    blocks = np.append(0, np.cumsum(-(-sizes // BLOCK)))
    begin = np.append(0, np.cumsum(sizes))[:-1]
    return np.arange(int(sizes.sum())) + np.repeat(blocks[:-1] * BLOCK - begin, sizes), blocks


def windows(tokens: np.ndarray, first: np.ndarray, end: int, row: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Windows (n, 2 * BLOCK + 1) of ids: the ``block``-th block of each ``row`` with the one before it and the last target."""
    at = (block * BLOCK)[:, None] + np.arange(-BLOCK, BLOCK + 1)[None, :]  # places in the stream that starts with the end id
    size = (first[row + 1] - first[row])[:, None]
    inside = (at >= 1) & (at <= size)
    ids = np.full(at.shape, PAD, np.uint32)
    ids[(at == 0) | (at == size + 1)] = end
    ids[inside] = tokens[(first[row][:, None] + at - 1)[inside]]
    return ids
