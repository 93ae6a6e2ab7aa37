"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy on windows of fixed length."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
DIRECTIONS = ("f", "b")


def start(symbols: int, tags: int, hidden: int, rng: np.random.Generator) -> Params:
    p: Params = {}
    for d in DIRECTIONS:
        p[f"x{d}"] = rng.normal(0, 0.1, (symbols, 4 * hidden))
        p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)) * 0.5
        p[f"c{d}"] = np.zeros(4 * hidden)
        p[f"c{d}"][hidden : 2 * hidden] = 1.0
    p["out"] = rng.normal(0, 0.1, (2 * hidden, tags))
    p["bias"], p["first"], p["last"], p["move"] = np.zeros(tags), np.zeros(tags), np.zeros(tags), np.zeros((tags, tags))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(p: Params, d: str, steps: np.ndarray, keep: bool):
    """Hidden states (length, windows, hidden) for symbols (length, windows), in the direction's own order."""
    length, n = steps.shape
    hidden = p["h" + d].shape[0]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    states, kept = np.empty((length, n, hidden), np.float32), []
    inputs = p["x" + d] + p["c" + d]
    for t in range(length):
        z = inputs[steps[t]] + h @ p["h" + d]
        gates, g = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, g, squashed))
        h = o * squashed
        states[t] = h
    return states, kept


def scores(p: Params, windows: np.ndarray, keep: bool = False):
    """Emission scores (length, windows, tags) of symbol windows (windows, length)."""
    steps = np.ascontiguousarray(windows.T)
    forward, kept_f = _run(p, "f", steps, keep)
    backward, kept_b = _run(p, "b", steps[::-1], keep)
    both = np.concatenate([forward, backward[::-1]], axis=2)
    return both @ p["out"] + p["bias"], both, steps, (kept_f, kept_b)


def best_tags(p: Params, windows: np.ndarray) -> np.ndarray:
    """The best tag path of each window, (windows, length)."""
    emitted = scores(p, windows)[0]
    length, n, tags = emitted.shape
    at, back = emitted[0] + p["first"], np.empty((length, n, tags), np.int8)
    for t in range(1, length):
        ways = at[:, :, None] + p["move"]
        back[t] = ways.argmax(axis=1)
        at = ways.max(axis=1) + emitted[t]
    out = np.empty((n, length), np.int8)
    out[:, -1] = (at + p["last"]).argmax(axis=1)
    rows = np.arange(n)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t][rows, out[:, t]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def gradients(p: Params, windows: np.ndarray, truth: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood of the true paths, and its gradients."""
    emitted, both, steps, kept = scores(p, windows, keep=True)
    length, n, tags = emitted.shape
    labels, rows = truth.T, np.arange(n)
    ahead, behind = np.empty_like(emitted), np.empty_like(emitted)
    ahead[0] = emitted[0] + p["first"]
    for t in range(1, length):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + p["move"], 1) + emitted[t]
    behind[-1] = p["last"]
    for t in range(length - 2, -1, -1):
        behind[t] = _log_sum(p["move"] + (emitted[t + 1] + behind[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1] + p["last"], 1)
    said = p["first"][labels[0]] + p["last"][labels[-1]] + sum(emitted[t, rows, labels[t]] for t in range(length))
    said = said + sum(p["move"][labels[t - 1], labels[t]] for t in range(1, length))
    slope = np.exp(ahead + behind - total[None, :, None])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, length):
        ways = ahead[t - 1][:, :, None] + p["move"] + (emitted[t] + behind[t])[:, None, :] - total[:, None, None]
        g["move"] += np.exp(ways).sum(axis=0)
        np.subtract.at(g["move"], (labels[t - 1], labels[t]), 1)
    g["first"] += slope[0].sum(axis=0) - np.bincount(labels[0], minlength=tags)
    g["last"] += slope[-1].sum(axis=0) - np.bincount(labels[-1], minlength=tags)
    for t in range(length):
        slope[t, rows, labels[t]] -= 1
    g["out"] += np.einsum("lnh,lnt->ht", both, slope, optimize=True)
    g["bias"] += slope.sum(axis=(0, 1))
    inner = slope @ p["out"].T
    hidden = inner.shape[2] // 2
    _back(p, g, "f", steps, inner[:, :, :hidden], kept[0])
    _back(p, g, "b", steps[::-1], inner[::-1, :, hidden:], kept[1])
    return float((total - said).mean()), {k: v / n for k, v in g.items()}


def _back(p: Params, g: Params, d: str, steps: np.ndarray, slope: np.ndarray, kept: list) -> None:
    dh = dc = np.zeros_like(slope[0])
    for t in range(len(steps) - 1, -1, -1):
        before_h, before_c, i, f, o, new, squashed = kept[t]
        dh = dh + slope[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * new * i * (1 - i), dc * before_c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
        np.add.at(g["x" + d], steps[t], dz)
        g["h" + d] += before_h.T @ dz
        g["c" + d] += dz.sum(axis=0)
        dh, dc = dz @ p["h" + d].T, dc * f


def train(windows: np.ndarray, truth: np.ndarray, symbols: int, tags: int, hidden: int = 24, epochs: int = 10, batch: int = 96, rate: float = 0.02, seed: int = 11) -> Params:
    """Parameters fitted by Adam; the same windows give the same parameters."""
    rng = np.random.default_rng(seed)
    p = start(symbols, tags, hidden, rng)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, steps = 0, max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, g = gradients(p, windows[some], truth[some])
            step += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            pace = rate * (1 - 0.9 * step / steps)
            shrink = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
            for k in p:
                g[k] *= shrink
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p
