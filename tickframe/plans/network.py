"""The network that the score queries use, and the same arithmetic as SQL text."""

from __future__ import annotations

import numpy as np


def example_network() -> dict:
    """Two blocks, 2 to 8 to 8 channels, with weights of a seeded generator."""
    rng = np.random.default_rng(3)
    block = lambda i, o: {"w1": rng.normal(0, 0.1, (o, i, 2)), "b1": np.zeros(o), "w2": rng.normal(0, 0.1, (o, o, 2)), "b2": np.zeros(o), "down": rng.normal(0, 0.1, (o, i, 1)) if i != o else None, "down_b": np.zeros(o)}
    return {"blocks": [block(2, 8), block(8, 8)], "head": rng.normal(0, 0.1, (3, 8)), "head_b": np.zeros(3)}


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _number(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def network_sql(model: dict, source: str, keys: str, place: str, channels: list[str]) -> list[str]:
    """CTEs from ``source`` (keys, place in the window, channels) to ``probs`` (keys and the three probabilities)."""
    over = f"OVER (PARTITION BY {keys} ORDER BY {place})"
    parts, at, x = [], source, channels
    for i, b in enumerate(model["blocks"]):
        d = model.get("base", 2) ** i
        for step, (w, bias) in enumerate((("w1", "b1"), ("w2", "b2"))):
            inner = x if step == 0 else [f"a{i}_{o}" for o in range(len(b["w1"]))]
            back = lambda c, k, w=b[w]: c if k == w.shape[2] - 1 else f"coalesce(lag({c}, {(w.shape[2] - 1 - k) * d}) {over}, 0.0)"
            lags = [f"{back(c, k)} AS l{j}_{k}" for j, c in enumerate(inner) for k in range(b[w].shape[2])]
            parts.append(f"lag{i}_{step} AS (SELECT *, {', '.join(lags)} FROM {at})")
            name = "ab"[step]
            made = [f"greatest(0.0, {_sum([_number(b[bias][o]), *(f'{_number(b[w][o, j, k])} * l{j}_{k}' for j in range(len(inner)) for k in range(b[w].shape[2]))])}) AS {name}{i}_{o}" for o in range(len(b[w]))]
            kept = x if step == 0 else [*x]
            parts.append(f"conv{i}_{step} AS (SELECT {keys}, {place}, {', '.join([*kept, *made])} FROM lag{i}_{step})")
            at = f"conv{i}_{step}"
        down = b.get("down")
        rest = lambda o: x[o] if down is None else _sum([_number(b["down_b"][o]), *(f"{_number(down[o, j, 0])} * {c}" for j, c in enumerate(x))])
        outs = [f"greatest(0.0, b{i}_{o} + {rest(o)}) AS y{i}_{o}" for o in range(len(b["w2"]))]
        parts.append(f"block{i} AS (SELECT {keys}, {place}, {', '.join(outs)} FROM {at})")
        at, x = f"block{i}", [f"y{i}_{o}" for o in range(len(b["w2"]))]
    pooled = [f"0.7 * arg_max({c}, {place}) + 0.3 * avg({c}) AS p{o}" for o, c in enumerate(x)]
    logits = [f"exp({_sum([_number(model['head_b'][k]), *(f'{_number(model["head"][k, o])} * p{o}' for o in range(len(x)))])}) AS z{k}" for k in range(3)]
    parts += [f"pooled AS (SELECT {keys}, {', '.join(pooled)} FROM {at} GROUP BY {keys})", f"heads AS (SELECT {keys}, {', '.join(logits)} FROM pooled)"]
    return [*parts, f"probs AS (SELECT {keys}, " + ", ".join(f"z{k} / (z0 + z1 + z2) AS {n}" for k, n in enumerate(("down_prob", "flat_prob", "up_prob"))) + " FROM heads)"]
