"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller ones are sorted by
their substrings, which one pass of inducing orders; where substrings are equal, the string of their ranks is
sorted recursively (a rank alphabet has nearly as many letters as the string, so the recursion sorts it by
doubled prefixes instead of bucket by bucket); a second pass then induces the whole array. Inducing walks the
buckets in order and moves whole runs of a bucket at a time.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last letter is the unique smallest."""
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(s), bool)
    out[:-1] = np.append(step, 1)[nxt] > 0
    return out


def induce(s: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array induced by the order of lms: first larger suffixes from left to right, then smaller ones back."""
    n, k = len(s), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    letters = s[lms]
    order = np.argsort(letters, kind="stable")
    lms, letters = lms[order], letters[order]
    seeds = np.searchsorted(letters, np.arange(k + 1))
    head = starts[:-1].copy()
    for c in range(k):
        a = starts[c]
        while True:  # what the bucket induces into itself goes on to the next round
            run = sa[a : head[c]]
            a = head[c]
            if not len(run):
                break
            _place(s, small, sa, head, run, False)
        if seeds[c + 1] > seeds[c]:
            _place(s, small, sa, head, lms[seeds[c] : seeds[c + 1]], False)
    tail = starts[1:].copy()
    for c in range(k - 1, -1, -1):
        b = starts[c + 1]
        while True:
            run = sa[tail[c] : b][::-1]
            b = tail[c]
            if not len(run):
                break
            _place(s, small, sa, tail, run, True)
        run = sa[starts[c] : head[c]][::-1]
        if len(run):
            _place(s, small, sa, tail, run, True)
    sa[0] = n - 1
    return sa


def _place(s: np.ndarray, small: np.ndarray, sa: np.ndarray, edge: np.ndarray, run: np.ndarray, smaller: bool) -> None:
    """Puts the predecessors of run that have the wanted class at the edges of their buckets, in the order of run."""
    j = run[run > 0] - 1
    j = j[small[j] == smaller]
    if not len(j):
        return
    c = s[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.r_[first, len(c)])
    nth = np.arange(len(c)) - np.repeat(first, size)
    if smaller:
        sa[edge[c] - 1 - nth] = j
        edge[c[first]] -= size
    else:
        sa[edge[c] + nth] = j
        edge[c[first]] += size


def doubled(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string over a large alphabet, by sorting prefixes of doubling length.

    A rank is the place of the first suffix of its prefix; only suffixes that share theirs are sorted on.
    """
    n, h = len(s), 1
    sa = np.argsort(s)
    k = s[sa]
    new = np.r_[True, k[1:] != k[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    places = np.flatnonzero(~(new & np.r_[new[1:], True]))  # in the array, those that aren't settled
    while len(places) and h < 2 * n:
        live = sa[places]
        own = rank[live]
        after = np.zeros(len(live), np.int64)
        inside = live + h < n
        after[inside] = rank[live[inside] + h] + 1
        key = own * (n + 2) + after
        order = np.argsort(key)
        live, key = live[order], key[order]
        sa[places] = live
        new = np.r_[True, key[1:] != key[:-1]]
        rank[live] = np.maximum.accumulate(np.where(new, places, 0))
        places = places[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of text, an array of small integers from 0; without the empty suffix."""
    if not len(text):
        return np.zeros(0, np.int64)
    s = np.append(text.astype(np.int32) + 1, 0).astype(np.uint16)
    n = len(s)
    starts = np.r_[0, np.cumsum(np.bincount(s))]
    small = classify(s)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        sa = induce(s, small, starts, lms)
        order = sa[is_lms[sa]]
        names = _names(s, small, is_lms, lms, order)
        reduced = names[lms]
        lms = lms[doubled(reduced)] if reduced.max() + 1 < len(lms) else order
    return induce(s, small, starts, lms)[1:] if n > 1 else np.zeros(0, np.int64)


def _names(s: np.ndarray, small: np.ndarray, is_lms: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, equal ones alike, at their positions."""
    n = len(s)
    end = np.full(n, n - 1)
    end[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    length = end[a] - a
    same = length == end[b] - b
    live = np.flatnonzero(same)
    d = 0
    while len(live):  # letter by letter, over the pairs that still agree
        eq = (s[a[live] + d] == s[b[live] + d]) & (small[a[live] + d] == small[b[live] + d])
        same[live[~eq]] = False
        live = live[eq]
        live = live[length[live] > d]
        d += 1
    same &= (a != n - 1) & (b != n - 1)
    out = np.zeros(n, np.int64)
    out[order] = np.cumsum(np.r_[0, ~same])
    return out


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefixes of each suffix, in text order, with its predecessor in the array.

    A value falls by one at most from a position to the next; only where the letters before the two suffixes
    differ is it found by comparison.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = (phi <= 0) | (i == 0) | (text[i - 1] != text[np.maximum(phi, 1) - 1])
    at = i[fresh & (phi >= 0)]
    out = np.zeros(n, np.int64)
    x, y = at, phi[at]
    most = n - np.maximum(x, y)
    padded = np.zeros(n + 4, np.uint16)
    padded[:n] = text
    four = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 1, 8), (2, 1))
    words = np.ascontiguousarray(four).view(np.uint64).reshape(-1)  # four letters from each place on
    got, live, d = most.copy(), np.arange(len(at)), 0
    while len(live):
        differ = words[x[live] + d] ^ words[y[live] + d]
        stop = differ != 0
        ended = live[stop]
        low = differ[stop]
        got[ended] = np.minimum(most[ended], d + (np.bitwise_count((low & -low) - np.uint64(1)).astype(np.int64) >> 4))
        d += 4
        live = live[~stop]
        live = live[most[live] > d]
    out[at] = got
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.maximum(0, out[last] - (i - last))
