"""Linear-chain conditional random fields over hashed token features, in batches of short chains.

State 0 is "outside". A token has a fixed number of hashed features; its score for a state is the sum of
their weights. Chains are given as (start, length) ranges of the token arrays and stepped together. A long
chain is stepped in segments at the same time: what one segment makes of any state before it is a small
matrix, and the matrices of a chain are multiplied one after the other, which gives what the whole chain gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from seamark.llm import textbytes as tb

DIM = 1 << 16
#: Tokens of a segment.
SEGMENT = 64


def hashed(*parts: np.ndarray | int) -> np.ndarray:
    """Feature numbers below DIM of tuples of integers."""
    total = np.full(1, 0x51ED27, np.uint64)
    for k, p in enumerate(parts):
        total = total + (np.atleast_1d(p).astype(np.uint64) + np.uint64(k + 1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) % (1 << 64) | 1)
    return (tb.splitmix(total) >> np.uint64(48)).astype(np.int64)


def chains(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of tokens between ``breaks`` (sorted first tokens of sentences); longest ranges first."""
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.diff(np.append(breaks, n))
    order = np.argsort(-length, kind="stable")
    return np.asarray(breaks, np.int64)[order], length[order]


class _Segments:
    """The segments of chains that come longest first."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.parts = -(-length // SEGMENT)
        self.at = np.cumsum(self.parts) - self.parts
        number = np.arange(int(self.parts.sum())) - np.repeat(self.at, self.parts)
        self.first = np.repeat(first, self.parts) + SEGMENT * number
        self.length = np.minimum(np.repeat(length, self.parts) - SEGMENT * number, SEGMENT)
        self.order = np.argsort(-self.length, kind="stable")
        #: Segments of chains of several.
        self.linked = np.arange(int(self.parts[: int((self.parts > 1).sum())].sum()))

    def before(self, k: int) -> np.ndarray:
        """Segments of number k that another one follows."""
        return self.at[: int(np.searchsorted(-self.parts, -k - 1, "left"))] + k

    def steps(self, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of a segment: the segments of ``which`` that have it, and their tokens there."""
        which = which[np.argsort(-self.length[which], kind="stable")]
        out = []
        for k in range(int(self.length[which].max(initial=0))):
            live = which[: int(np.searchsorted(-self.length[which], -k, "left"))]
            out.append((live, self.first[live] + k))
        return out


@dataclass
class Crf:
    weights: np.ndarray  # DIM x states, 0 for state 0
    moves: np.ndarray  # states x states

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), self.weights.shape[1]))
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: (state probabilities of each token, expected number of each move if the tokens have a ``weight``)."""
        n, s = scores.shape
        e = np.exp(np.clip(scores - scores.max(1, keepdims=True), -60, 0))
        t = np.exp(self.moves)
        even = lambda x: x / x.sum(-1, keepdims=True)
        seg = _Segments(first, length)
        # What comes into a segment from the tokens before it, and from those behind it.
        come, follow = np.ones((len(seg.first), s)), np.ones((len(seg.first), s))
        if len(seg.linked):
            block = np.zeros((len(seg.linked), s, s))
            for k, (live, at) in enumerate(seg.steps(seg.linked)):
                b = np.eye(s)[None] * e[at][:, None, :] if k == 0 else (block[live] @ t) * e[at][:, None, :]
                block[live] = b / b.max((1, 2), keepdims=True)
            numbers = range(int(seg.parts.max()) - 1)
            for k in numbers:
                at = seg.before(k)
                come[at + 1] = even((come[at][:, None, :] @ block[at])[:, 0] @ t)
            for k in reversed(numbers):
                at = seg.before(k)
                follow[at] = even((block[at + 1] @ follow[at + 1][:, :, None])[:, :, 0] @ t.T)
        fore, back = np.empty((n, s)), np.ones((n, s))
        steps = seg.steps(np.arange(len(seg.first)))
        for k, (live, at) in enumerate(steps):
            fore[at] = even((come[live] if k == 0 else fore[at - 1] @ t) * e[at])
        back[seg.first + seg.length - 1] = follow
        for _, at in reversed(steps[1:]):
            back[at - 1] = even((e[at] * back[at]) @ t.T)
        moved = np.zeros((s, s))
        if weight is not None:
            inner = np.ones(n, bool)
            inner[first] = False
            inner = np.flatnonzero(inner)
            for k in range(0, len(inner), 1 << 18):
                at = inner[k : k + (1 << 18)]
                pair = fore[at - 1][:, :, None] * t[None] * (e[at] * back[at])[:, None, :]
                moved += (pair * (weight[at] / pair.sum((1, 2)))[:, None, None]).sum(0)
        return even(fore * back), moved

    def viterbi(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The likeliest state of each token, chain by chain."""
        n, s = scores.shape
        best, came, state = np.array(scores), np.zeros((n, s), np.int8), np.zeros(n, np.int8)
        seg = _Segments(first, length)
        come = np.zeros((len(seg.first), s))
        numbers = range(int(seg.parts.max(initial=1)) - 1)
        if len(seg.linked):
            block = np.zeros((len(seg.linked), s, s))
            for k, (live, at) in enumerate(seg.steps(seg.linked)):
                if k == 0:
                    block[live] = np.where(np.eye(s, dtype=bool), scores[at][:, None, :], -np.inf)
                else:
                    block[live] = (block[live][:, :, :, None] + self.moves).max(2) + scores[at][:, None, :]
            for k in numbers:
                at = seg.before(k)
                last = (come[at][:, :, None] + block[at]).max(1)
                come[at + 1] = (last[:, :, None] + self.moves).max(1)
        steps = seg.steps(np.arange(len(seg.first)))
        for k, (live, at) in enumerate(steps):
            if k == 0:
                best[at] += come[live]
                continue
            step = best[at - 1][:, :, None] + self.moves
            came[at] = step.argmax(1)
            best[at] += step.max(1)
        ends = seg.first + seg.length - 1
        last = best[ends].argmax(1)
        if len(seg.linked):
            # Where each state at the end of a segment came from at its first token.
            begun = np.repeat(np.arange(s)[None], len(seg.linked), 0)
            for live, at in reversed(seg.steps(seg.linked)[1:]):
                begun[live] = np.take_along_axis(came[at], begun[live], 1)
            for k in reversed(numbers):
                at = seg.before(k)
                to = begun[at + 1, last[at + 1]]
                last[at] = (best[ends[at]] + self.moves[:, to].T).argmax(1)
        state[ends] = last
        for _, at in reversed(steps[1:]):
            state[at - 1] = came[at, state[at]]
        return state

    def all_outside(self, scores: np.ndarray) -> np.ndarray:
        """Tokens that can't be inside any likeliest path that starts or ends there: proof against the best moves."""
        gain = scores[:, 1:].max(1) - scores[:, 0]
        return gain + 2 * max(0.0, float((self.moves - self.moves[0, 0]).max())) < 0


def fit(features: np.ndarray, states: np.ndarray, first: np.ndarray, length: np.ndarray, n_states: int, rounds: int = 40, ridge: float = 1e-6, weight: np.ndarray | None = None) -> Crf:
    """Maximum likelihood by Adam over all chains at once; weight: of each token, the same for those of a chain."""
    model = Crf(np.zeros((DIM, n_states)), np.zeros((n_states, n_states)))
    weight = np.ones(len(states)) if weight is None else weight
    n = max(1.0, float(weight.sum()))
    seen = np.zeros((n_states, n_states))
    ends = np.zeros(len(states) + 1, bool)
    ends[first] = True
    inner = np.flatnonzero(~ends[:-1]) if len(states) else np.zeros(0, np.int64)
    np.add.at(seen, (states[inner - 1], states[inner]), weight[inner])
    m_w, v_w, m_t, v_t = np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(model.moves), np.zeros_like(model.moves)
    one = np.eye(n_states)[states]
    flat = features.ravel()
    for step in range(1, rounds + 1):
        p, moved = model.marginals(model.scores(features), first, length, weight)
        g_w = np.zeros_like(model.weights)
        for s in range(1, n_states):
            g_w[:, s] = np.bincount(flat, np.repeat((p[:, s] - one[:, s]) * weight, features.shape[1]), DIM)
        g_w, g_t = g_w / n + ridge * model.weights, (moved - seen) / n
        for x, g, m, v in ((model.weights, g_w, m_w, v_w), (model.moves, g_t, m_t, v_t)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model
