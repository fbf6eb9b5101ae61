"""Suffix arrays by induced sorting, and permuted common prefixes, over one shard held as a numpy array."""

from __future__ import annotations

import numpy as np

#: Below this many symbols a bucket on average, whole buckets are too small to be worth a numpy call.
LOOP_BELOW = 48


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last is the only 0.

    Suffixes are classified as smaller (S) or larger (L) than the next one; the leftmost-S substrings are sorted by
    inducing, named, and where names repeat the string of names is sorted by doubling; from the sorted leftmost-S
    suffixes two scans induce the rest.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    size = int(s.max()) + 1
    if size <= 1 << 16:
        s = s.astype(np.uint16)  # sorted by radix, and read from less memory
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce if n >= LOOP_BELOW * size else _induce_loop
    first = induce(s, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names, distinct = _names(s, lms, order)
    if distinct < len(lms):
        order = lms[_doubled(names)]
    return induce(s, small, order, size)


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of names from 0 without gaps: ranks by 1, 2, 4, ... names, until all differ."""
    rank, n, reach = names, len(names), 1
    while True:
        pair = rank * (n + 1)
        pair[: n - reach] += rank[reach:] + 1
        order = np.argsort(pair)
        pair = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(pair[1:] != pair[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        reach *= 2


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next; the last one counts as smaller."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    to = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(s[:-1] < s[1:], True)[to]


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-S substrings in text order, from 0, equal for equal substrings; and how many differ."""
    length = np.zeros(len(s), np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_] + k, b[open_] + k
        equal = s[x] == s[y]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal & (length[a[open_]] > k)]
    name = np.concatenate(([0], np.cumsum(~same)))
    by_position = np.zeros(len(s), np.int64)
    by_position[order] = name
    return by_position[lms], int(name[-1]) + 1


def _put(to: np.ndarray, head: np.ndarray, symbols: np.ndarray, p: np.ndarray) -> None:
    """Appends the suffixes p to the buckets of their symbols, in order."""
    c = symbols[p]
    by = np.argsort(c, kind="stable")
    c, p = c[by], p[by]
    starts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
    counts = np.diff(np.append(starts, len(c)))
    which = c[starts]
    to[np.repeat(head[which] - starts, counts) + np.arange(len(c))] = p
    head[which] += counts


def _induce(s: np.ndarray, small: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """The two inducing scans, bucket by bucket; a bucket that feeds itself is taken in waves."""
    n_large, n_small = np.bincount(s[~small], minlength=size), np.bincount(s[small], minlength=size)
    at_large, at_small = np.cumsum(n_large) - n_large, np.cumsum(n_small) - n_small
    order = order[np.argsort(s[order], kind="stable")]
    order_at = np.searchsorted(s[order], np.arange(size + 1))
    large, head = np.empty(int(n_large.sum()), np.int64), at_large.copy()
    for c in range(size):
        done = at_large[c]
        while done < head[c]:
            wave = large[done : head[c]]
            done = int(head[c])
            p = wave[wave > 0] - 1
            p = p[~small[p]]
            if len(p):
                _put(large, head, s, p)
        wave = order[order_at[c] : order_at[c + 1]]
        wave = wave[wave > 0]
        if len(wave):
            _put(large, head, s, wave - 1)
    # the second scan runs from the largest down, so each bucket is filled in falling order
    falling, head = np.empty(int(n_small.sum()), np.int64), at_small.copy()
    falling[at_small[0]] = len(s) - 1
    for c in range(size - 1, -1, -1):
        done = at_small[c]
        if c == 0:
            break
        while done < head[c]:
            wave = falling[done : head[c]]
            done = int(head[c])
            p = wave[wave > 0] - 1
            p = p[small[p]]
            if len(p):
                _put(falling, head, s, p)
        wave = large[at_large[c] : at_large[c] + n_large[c]][::-1]
        p = wave[wave > 0] - 1
        p = p[small[p]]
        if len(p):
            _put(falling, head, s, p)
    out = np.empty(len(s), np.int64)
    start = np.cumsum(n_large + n_small) - (n_large + n_small)
    out[np.arange(len(large)) + np.repeat(start - at_large, n_large)] = large
    # turn each bucket's falling order round
    k = np.arange(len(falling))
    turned = np.repeat(start + n_large + n_small - 1 + at_small, n_small) - k
    out[turned] = falling
    return out


def _induce_loop(s: np.ndarray, small: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """The same two scans one suffix at a time, for strings of very many symbols."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    text, is_small, sa = s.tolist(), small.tolist(), [-1] * len(s)
    tail = ends.tolist()
    for p in order[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = (ends - counts).tolist()
    for p in sa:
        if p > 0 and not is_small[p - 1]:
            c = text[p - 1]
            sa[head[c]] = p - 1
            head[c] += 1
    tail = ends.tolist()
    for k in range(len(sa) - 1, -1, -1):
        p = sa[k]
        if p > 0 and is_small[p - 1]:
            c = text[p - 1]
            tail[c] -= 1
            sa[tail[c]] = p - 1
    sa[0] = len(s) - 1
    return np.array(sa, np.int64)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, before): before[i] is the suffix that stands before i in the array, plcp[i] what they have in common.

    No more than left[i] symbols count.  Where the symbols before both suffixes agree, the value is one less than at
    i - 1; the others, and places where ``left`` starts anew, are compared eight symbols at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = np.zeros(n, bool)
    prior = before[1:] - 1
    reducible[1:] = (before[1:] > 0) & (s[:-1] == s[np.maximum(prior, 0)]) & (before[:-1] == prior) & (left[1:] == left[:-1] - 1)
    at = np.flatnonzero(~reducible)
    padded = np.concatenate((s.astype(np.uint64), np.zeros(8, np.uint64)))
    value = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero((before[at] >= 0) & (left[at] > 0))
    if s.max() < 256:
        words = sum(padded[k : k + n] << np.uint64(8 * k) for k in range(8))
        while len(open_):
            x, y = at[open_] + value[open_], before[at[open_]] + value[open_]
            ok = (x < n) & (y < n)
            ok[ok] = words[x[ok]] == words[y[ok]]
            ok &= value[open_] + 8 <= left[at[open_]]
            open_ = open_[ok]
            value[open_] += 8
        open_ = np.flatnonzero((before[at] >= 0) & (left[at] > 0))
    while len(open_):
        x, y = at[open_] + value[open_], before[at[open_]] + value[open_]
        ok = (x < n) & (y < n) & (value[open_] < left[at[open_]])
        ok[ok] = s[x[ok]] == s[y[ok]]
        open_ = open_[ok]
        value[open_] += 1
    full = np.zeros(n, np.int64)
    full[at] = value + at
    last = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.maximum(full[last] - i, 0), before
