"""A bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own vector beside the mean of what its characters say: each stands for the trigram
around it and for the word's beginning up to it. Both directions read a window of words, a softmax over the words' states pools them, and one output scores the window. Arrays
have the windows last, so that every step works on whole rows.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
#: Input to the update gate where a window has no word: the gate stays shut and the state as it was.
SHUT = 60.0


def start(words: int, grams: int, stems: int, wide: int, hidden: int, rng: np.random.Generator) -> Params:
    """Vectors of words (0: unknown), trigrams and beginnings (0: none), and weights of both directions, gates z, r, n."""
    p = {
        "word": rng.normal(0, 0.1, (words, wide)),
        "gram": rng.normal(0, 0.1, (grams, wide)),
        "stem": rng.normal(0, 0.1, (stems, wide)),
        "in": rng.normal(0, 1 / np.sqrt(2 * wide), (2, 3 * hidden, 2 * wide)),
        "state": rng.normal(0, 0.5 / np.sqrt(hidden), (2, 3 * hidden, hidden)),
        "gate": np.zeros((2, 3 * hidden, 1)),
        "look": rng.normal(0, 0.3, (1, 2 * hidden)),
        "out": rng.normal(0, 0.3, 2 * hidden),
        "bias": np.zeros(1),
    }
    p["word"][0] = p["stem"][0] = 0
    return {k: v.astype(np.float32) for k, v in p.items()}


def spelled(p: Params, grams: np.ndarray, stems: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean vector of each word's characters; the words' characters stand one after another from `starts` on."""
    if not len(starts):
        return np.zeros((0, p["gram"].shape[1]), np.float32)
    sizes = np.diff(np.r_[starts, len(grams)])
    return np.add.reduceat(p["gram"][grams] + p["stem"][stems], starts, axis=0) / sizes[:, None].astype(np.float32)


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each number below n."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        firsts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        out[ordered[firsts]] = np.add.reduceat(rows[order], firsts, axis=0)
    return out


def inputs(p: Params, features: np.ndarray) -> np.ndarray:
    """What words with these features (words, 2 * wide) give to the gates of both directions, (words, 2 * 3 * hidden)."""
    w = p["in"].reshape(-1, p["in"].shape[2])
    return features @ w.T + p["gate"].reshape(-1)


def run(p: Params, x: np.ndarray, there: np.ndarray, keep: bool = False):
    """Scores of windows from their gates' inputs (length, 2, 3 * hidden, windows) and which words are there.

    The second direction's inputs come in reading order too and are read from the end.
    """
    length, _, rows, n = x.shape
    hidden = rows // 3
    h = np.zeros((2, hidden, n), np.float32)
    states, kept = np.empty((length, 2, hidden, n), np.float32), []
    g = np.empty((2, rows, n), np.float32)
    for t in range(length):
        g[0], g[1] = x[t, 0], x[length - 1 - t, 1]
        u = p["state"] @ h
        gates = 0.5 * np.tanh(0.5 * (g[:, : 2 * hidden] + u[:, : 2 * hidden])) + 0.5
        z, r = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh(g[:, 2 * hidden :] + r * u[:, 2 * hidden :])
        before, h = h, new + z * (h - new)
        if keep:
            kept.append((before, z, r, new, u[:, 2 * hidden :]))
        states[t, 0], states[length - 1 - t, 1] = h[0], h[1]
    both = states.reshape(length, 2 * hidden, n)
    looks = (p["look"] @ both)[:, 0] + np.where(there, 0, -1e9).astype(np.float32)
    share = np.exp(looks - looks.max(axis=0)) * there
    share /= share.sum(axis=0) + 1e-9
    pooled = np.einsum("tn,thn->hn", share, both, optimize=True)
    return p["out"] @ pooled + p["bias"], (both, share, pooled, kept)


def back(p: Params, slope: np.ndarray, memory) -> tuple[Params, np.ndarray]:
    """Gradients of the weights behind the input, and of the input, for the scores' slopes."""
    both, share, pooled, kept = memory
    length, width, n = both.shape
    hidden = width // 2
    g = {"out": pooled @ slope, "bias": np.array([slope.sum()])}
    pulled = p["out"][:, None] * slope
    by_word = np.einsum("hn,thn->tn", pulled, both, optimize=True)
    tilt = share * (by_word - (share * by_word).sum(axis=0))
    g["look"] = np.einsum("tn,thn->h", tilt, both, optimize=True)[None, :]
    inner = (share[:, None] * pulled + tilt[:, None] * p["look"].T).reshape(length, 2, hidden, n)
    out = np.empty((length, 2, 3 * hidden, n), np.float32)
    g["state"] = np.zeros_like(p["state"])
    carry = np.zeros((2, hidden, n), np.float32)
    backward = p["state"].transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        before, z, r, new, u = kept[t]
        carry[0] += inner[t, 0]
        carry[1] += inner[length - 1 - t, 1]
        dn = carry * (1 - z) * (1 - new * new)
        dz = carry * (before - new) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r], axis=1)
        g["state"] += du @ before.transpose(0, 2, 1)
        carry = carry * z + backward @ du
        given = np.concatenate([dz, dr, dn], axis=1)
        out[t, 0], out[length - 1 - t, 1] = given[0], given[1]
    return g, out


class Adam:
    """Steps whose pace falls to a tenth over the run; weights shrink by a share of the pace."""

    def __init__(self, p: Params, steps: int, rate: float, shrink: float = 0.0) -> None:
        self.p, self.steps, self.rate, self.shrink, self.step = p, max(1, steps), rate, shrink, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def move(self, g: Params) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        shrink, pace = np.float32(min(1.0, 5.0 / (norm + 1e-9))), self.rate * (1 - 0.9 * self.step / self.steps)
        for k, v in g.items():
            v = v * shrink
            self.mean[k] += 0.1 * (v - self.mean[k])
            self.square[k] += 0.01 * (v * v - self.square[k])
            scaled = self.mean[k] / (1 - 0.9**self.step) / (np.sqrt(self.square[k] / (1 - 0.99**self.step)) + 1e-6)
            self.p[k] -= (pace * (scaled + self.shrink * self.p[k])).astype(np.float32)
