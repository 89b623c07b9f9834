"""Suffix arrays by induced sorting, and permuted common prefixes, for the shards of a task."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; s ends with a unique smallest symbol."""
    n = len(s)
    up = np.ones(n, bool)
    if n > 1:
        diff = s[:-1] != s[1:]
        where = np.flatnonzero(diff)
        rise = s[where] < s[where + 1]
        up[:-1] = rise[np.searchsorted(where, np.arange(n - 1))]
    return up


def _edges(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(s, minlength=k)
    ends = np.cumsum(count)
    return ends - count, ends


def _put(sa: np.ndarray, at: np.ndarray, sym: np.ndarray, head: np.ndarray, step: int) -> None:
    """Append ``at`` to the buckets of ``sym`` in order, upwards or downwards."""
    order = np.argsort(sym, kind="stable")
    sym = sym[order]
    first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    n = np.diff(np.append(first, len(sym)))
    rank = np.arange(len(sym)) - np.repeat(first, n)
    sa[head[sym] + step * rank] = at[order]
    head[sym[first]] += step * n


def _induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes, given the leftmost-smaller ones in theirs. Few symbols: a bucket at a time."""
    sa = np.full(len(s), -1, np.int64)
    low = np.searchsorted(s[lms], np.arange(len(starts) + 1))
    head = starts.copy()
    for c in np.flatnonzero(ends > starts):
        done = starts[c]
        while done < head[c]:  # what a bucket induces into itself makes another wave
            part, done = sa[done : head[c]], head[c]
            part = part[part > 0] - 1
            part = part[~up[part]]
            if len(part):
                _put(sa, part, s[part], head, 1)
        own = lms[low[c] : low[c + 1]]
        own = own[own > 0] - 1
        if len(own):
            _put(sa, own, s[own], head, 1)
    tail = ends - 1
    for c in np.flatnonzero(ends > starts)[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            part, done = sa[tail[c] + 1 : done + 1][::-1], tail[c]
            part = part[part > 0] - 1
            part = part[up[part]]
            if len(part):
                _put(sa, part, s[part], tail, -1)
        part = sa[starts[c] : head[c]][::-1]
        part = part[part > 0] - 1
        part = part[up[part]]
        if len(part):
            _put(sa, part, s[part], tail, -1)
    sa[0] = len(s) - 1
    return sa


def _induce_many(s: np.ndarray, up: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same over many symbols, a suffix at a time."""
    n = len(s)
    text, kind = s.tolist(), up.tolist()
    sa = [-1] * n
    tail = (ends - 1).tolist()
    for p in reversed(lms.tolist()):
        sa[tail[text[p]]] = p
        tail[text[p]] -= 1
    head = starts.tolist()
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not kind[p]:
            c = text[p]
            sa[head[c]] = p
            head[c] += 1
    tail = (ends - 1).tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and kind[p]:
            c = text[p]
            sa[tail[c]] = p
            tail[c] -= 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of s over symbols below k; s ends with a 0 that occurs nowhere else."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].astype(np.int64)
    up = _types(s)
    starts, ends = _edges(s, k)
    induce = _induce if k <= 1024 else _induce_many
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    sa = induce(s, up, lms[np.argsort(s[lms], kind="stable")], starts, ends)

    # Leftmost-smaller substrings in their order; equal neighbours get one name.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    size = length[order]
    new = np.ones(len(order), bool)
    same = np.flatnonzero(size[1:] == size[:-1])
    if len(same):
        a, b, m = order[same], order[same + 1], size[same + 1]
        first = np.cumsum(m) - m
        at = np.arange(m.sum()) - np.repeat(first, m)
        x, y = np.repeat(a, m) + at, np.repeat(b, m) + at
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        new[same + 1] = np.logical_or.reduceat(s[x] != s[y], first)
    name = np.cumsum(new) - 1
    names = np.zeros(n, np.int64)
    names[order] = name
    short = names[lms]
    if name[-1] + 1 == len(lms):
        by_name = np.zeros(len(lms), np.int64)
        by_name[short] = np.arange(len(lms))
    else:
        by_name = suffix_array(short, int(name[-1]) + 1)
    return induce(s, up, lms[by_name], starts, ends)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the common prefix with its predecessor in the suffix array.

    Only where the preceding symbols differ are symbols compared; elsewhere it is one less than before.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    known = before >= 0
    left, left_of = np.where(at > 0, s[at - 1], -1), np.where(before > 0, s[before - 1], -2)
    own = np.flatnonzero(known & (left != left_of) | ~known)
    out = np.zeros(n, np.int64)
    live = own[known[own]]
    lcp = np.zeros(len(live), np.int64)
    go = np.arange(len(live))
    pad = np.concatenate([s, np.full(64, -1, s.dtype)])
    step = np.arange(64)
    while len(go):
        x, y = live[go] + lcp[go], before[live[go]] + lcp[go]
        parts = []
        for k in range(0, len(go), 1 << 12):
            # The unique last symbol ends any match, so none runs beyond the text.
            eq = pad[np.minimum(x[k : k + (1 << 12), None] + step, n + 63)] == pad[np.minimum(y[k : k + (1 << 12), None] + step, n + 63)]
            parts.append(np.where(eq.all(1), 64, (~eq).argmax(1)))
        more = np.concatenate(parts)
        lcp[go] += more
        go = go[more == 64]
    out[live] = lcp
    last = np.maximum.accumulate(np.where(np.isin(at, own, assume_unique=True), at, 0))
    return np.maximum(out[last] - (at - last), 0)
