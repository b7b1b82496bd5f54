"""Linear-chain conditional random fields with two states, over many chains at once in NumPy.

A chain's potential is exp(sum of unary[t] where state 1 + sum of trans[s(t-1), s(t)]). Forward and
backward messages of all chains run side by side: chains are cut into blocks, blocks are multiplied out
together, joined along each chain, and walked again from the right messages. Exact, without a step per word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Places of chains worked on together.
PLACES = 1 << 17


def _messages(e0: np.ndarray, e1: np.ndarray, a: np.ndarray, first: np.ndarray, block: int, enter: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward messages of chains ``first[c]:first[c+1]`` with emissions e and transitions ``a``.

    ``enter``: the first chain goes on from a place with this message.
    """
    n = len(e0)
    count = np.diff(first)
    blocks = -(-count // block)
    base = np.concatenate([[0], np.cumsum(blocks)])
    chain = np.repeat(np.arange(len(count)), count)
    nth = np.arange(n) - first[:-1][chain]
    col, row = base[:-1][chain] + nth // block, nth % block
    total = base[-1]
    x0, x1 = np.ones((block, total)), np.ones((block, total))
    x0[row, col], x1[row, col] = e0, e1
    opens = np.zeros(total, bool)
    opens[base[:-1][blocks > 0]] = True
    v0, v1 = np.ones(total), np.ones(total)
    if enter is not None:
        opens[0] = False
        v0[0], v1[0] = enter
    if blocks.max(initial=0) > 1:
        p00, p01, p10, p11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
        for s in range(block):
            q00, q01, q10, q11 = (p00 * a[0, 0] + p01 * a[1, 0]), (p00 * a[0, 1] + p01 * a[1, 1]), (p10 * a[0, 0] + p11 * a[1, 0]), (p10 * a[0, 1] + p11 * a[1, 1])
            if s == 0:
                q00, q01, q10, q11 = (np.where(opens, p, q) for p, q in ((p00, q00), (p01, q01), (p10, q10), (p11, q11)))
            p00, p01, p10, p11 = q00 * x0[s], q01 * x1[s], q10 * x0[s], q11 * x1[s]
            if s % 4 == 3:
                top = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
                p00, p01, p10, p11 = p00 / top, p01 / top, p10 / top, p11 / top
        order = np.argsort(-blocks, kind="stable")
        longest = -blocks[order]
        w0, w1 = np.ones(len(order)), np.ones(len(order))
        if enter is not None:
            w0[order == 0], w1[order == 0] = enter
        for j in range(int(blocks.max()) - 1):
            live = int(np.searchsorted(longest, -(j + 1), "left"))  # chains with a block after j
            at = base[:-1][order[:live]] + j
            w0, w1 = w0[:live] * p00[at] + w1[:live] * p10[at], w0[:live] * p01[at] + w1[:live] * p11[at]
            top = w0 + w1
            w0, w1 = w0 / top, w1 / top
            v0[at + 1], v1[at + 1] = w0, w1
    m0, m1 = np.empty((block, total)), np.empty((block, total))
    for s in range(block):
        u0, u1 = v0 * a[0, 0] + v1 * a[1, 0], v0 * a[0, 1] + v1 * a[1, 1]
        if s == 0:
            u0, u1 = np.where(opens, v0, u0), np.where(opens, v1, u1)
        v0, v1 = u0 * x0[s], u1 * x1[s]
        top = v0 + v1
        v0, v1 = v0 / top, v1 / top
        m0[s], m1[s] = v0, v1
    return m0[row, col], m1[row, col]


def _groups(first: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of whole chains of about ``limit`` places; a longer chain is a range of its own."""
    out, lo = [], 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + limit, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _long(e0: np.ndarray, e1: np.ndarray, a: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages of one chain, part after part."""
    n, enter = len(e0), None
    out = np.empty(n), np.empty(n)
    for lo in range(0, n, PLACES):
        hi = min(n, lo + PLACES)
        out[0][lo:hi], out[1][lo:hi] = _messages(e0[lo:hi], e1[lo:hi], a, np.array([0, hi - lo]), block, enter)
        enter = float(out[0][hi - 1]), float(out[1][hi - 1])
    return out


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every place, and the expected transitions (2 x 2) summed over all chains.

    Chains are worked on in groups of about ``PLACES`` places and a longer one in parts, which bounds what is held beside the result.
    """
    p, total = np.zeros(len(unary)), np.zeros((2, 2))
    a = np.exp(trans - trans.max())
    for lo, hi in _groups(first, PLACES):
        at, to = first[lo], first[hi]
        p[at:to], joint = _marginals(unary[at:to], a, first[lo : hi + 1] - at, block)
        total += joint
    return p, total


def _marginals(unary: np.ndarray, a: np.ndarray, first: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e1 = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
    e0 = 1 - e1
    if n > PLACES:
        f0, f1 = _long(e0, e1, a, block)
        b0, b1 = (x[::-1] for x in _long(e0[::-1], e1[::-1], a.T, block))
    else:
        f0, f1 = _messages(e0, e1, a, first, block)
        b0, b1 = (x[::-1] for x in _messages(e0[::-1], e1[::-1], a.T, n - first[::-1], block))
    p0, p1 = f0 * b0 / e0, f1 * b1 / e1
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    t = np.flatnonzero(inner)
    joint = np.zeros((2, 2))
    for lo in range(0, len(t), PLACES):
        u = t[lo : lo + PLACES]
        one = np.stack([f0[u - 1] * a[0, 0] * b0[u], f0[u - 1] * a[0, 1] * b1[u], f1[u - 1] * a[1, 0] * b0[u], f1[u - 1] * a[1, 1] * b1[u]])
        joint += (one / one.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return p1 / (p0 + p1), joint


@dataclass
class Adam:
    rate: float
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)
    t: int = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] += self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def train(score: Callable[[dict], np.ndarray], gradient: Callable[[np.ndarray], dict], params: dict, y: np.ndarray, first: np.ndarray, steps: int, rate: float, l2: float, block: int) -> None:
    """Ascend the likelihood of labels ``y``: ``score(params)`` gives unaries, ``gradient(y - p)`` their pull on the parameters."""
    inner = np.ones(len(y), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    t = np.flatnonzero(inner)
    seen = np.bincount(2 * y[t - 1].astype(int) + y[t].astype(int), minlength=4).reshape(2, 2).astype(float)
    adam, n = Adam(rate), max(1, len(y))
    for _ in range(steps):
        p, joint = marginals(score(params), params["trans"], first, block)
        grads = gradient((y - p) / n)
        grads["trans"] = (seen - joint) / n
        adam.step(params, {k: g - l2 * params[k] / n for k, g in grads.items()})


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge: weights of the columns of ``x`` and, last, the constant."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.05
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))
