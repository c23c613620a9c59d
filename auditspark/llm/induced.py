"""Suffix arrays by induced sorting, and permuted common prefixes.

At the byte level whole buckets are induced at once: the suffixes placed in a bucket
decide, in order, where the suffixes one byte to their left go, so a bucket is read as
a growing front and scattered with a stable sort. The reduced string of the names of
leftmost-smaller substrings has a large alphabet, over which buckets cannot be handled
whole; it is not sorted by recursion but by doubling what is compared while ties last.
"""

from __future__ import annotations

import numpy as np

from .bytetext import ByteHash


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of the reduced string, by doubling the compared length of what is still tied."""
    n = len(names)
    # As many names as 63 bits hold are compared at first.
    base = int(names.max()) + 2
    step = max(1, 63 // base.bit_length())
    key = np.zeros(n + step - 1, np.int64)
    key[:n] = names
    key[:n] += 1
    first_names = key[:n].copy()
    for k in range(1, step):
        first_names *= base
        first_names += key[k : k + n]
    order = np.argsort(first_names)
    # A rank is the first place of its group, so that groups can be split by themselves.
    ordered = first_names[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied):
        p = order[tied]
        after = np.where(p + step < n, rank[np.minimum(p + step, n - 1)] + 1, 0)
        group = place[tied]
        sort = np.argsort(group * (n + 1) + after)
        p, after = p[sort], after[sort]
        order[tied] = p
        new = np.concatenate(([True], (after[1:] != after[:-1]) | (group[1:] != group[:-1])))
        place[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[p] = place[tied]
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class _Buckets:
    def __init__(self, text: np.ndarray, sigma: int):
        self.text, self.sigma = text, sigma
        self.count = np.bincount(text, minlength=sigma)
        self.tail = np.cumsum(self.count)
        self.head = self.tail - self.count
        self.used = np.flatnonzero(self.count).tolist()
        #: Of positions.
        self.kind = np.int32 if len(text) < 1 << 31 else np.int64

    def _scatter(self, sa: np.ndarray, p: np.ndarray, c: np.ndarray, at: np.ndarray, sign: int) -> None:
        """Puts p, of symbols c, in order at the moving heads (sign 1) or tails (sign -1) of their buckets."""
        if len(p) < 2:
            if len(p):
                sa[at[c[0]] if sign > 0 else at[c[0]] - 1] = p[0]
                at[c[0]] += sign
            return
        # Symbols have 16 bits: these are sorted by their digits.
        order = np.argsort(c, kind="stable")
        many = np.bincount(c, minlength=self.sigma)
        before = np.cumsum(many) - many
        to, place = np.repeat(at - before if sign > 0 else at - 1 + before, many), np.arange(len(p))
        sa[to + place if sign > 0 else to - place] = p[order]
        at += sign * many

    def induce(self, ordered: np.ndarray) -> np.ndarray:
        # Position -1, before the text's first, is the text's end: no symbol, neither large nor small.
        text, below = self.text, self.text.copy()
        below[-1] = np.iinfo(below.dtype).max
        sa = np.full(len(text), -1, self.kind)
        tail = self.tail.copy()
        self._scatter(sa, ordered[::-1], text[ordered[::-1]], tail, -1)
        first_lms, head = tail, self.head.copy()
        for c in self.used:
            at = self.head[c]
            while at < head[c]:
                # Left of a large one stands a large one if its symbol is not smaller.
                p = sa[at : head[c]] - 1
                at = head[c]
                s = text[p]
                go = np.flatnonzero(s >= c)
                self._scatter(sa, p[go], s[go], head, 1)
            # Left of a leftmost small one stands always a large one.
            p = sa[first_lms[c] : self.tail[c]] - 1
            self._scatter(sa, p, text[p], head, 1)
        last_large, tail = head, self.tail.copy()
        for c in reversed(self.used):
            at = self.tail[c]
            while at > tail[c]:
                p = sa[tail[c] : at][::-1] - 1
                at = tail[c]
                s = below[p]
                go = np.flatnonzero(s <= c)
                self._scatter(sa, p[go], s[go], tail, -1)
            p = sa[self.head[c] : last_large[c]][::-1] - 1
            s = below[p]
            go = np.flatnonzero(s < c)
            self._scatter(sa, p[go], s[go], tail, -1)
        return sa


def suffix_array(data: np.ndarray, apart: np.ndarray = ()) -> np.ndarray:
    """Suffix array of a byte array; a suffix sorts before those it is a prefix of.

    At the positions ``apart`` stands a symbol below all 256 bytes, whatever ``data`` has
    there. Suffixes alike up to such a symbol may be in any order.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int32)
    text = np.zeros(n + 1, np.uint16)
    text[:n] = data
    text[:n] += 2
    text[np.asarray(apart, np.int64)] = 1
    differs = np.flatnonzero(text[1:] != text[:-1])
    small = np.ones(n + 1, bool)
    small[:n] = np.repeat(text[differs] < text[differs + 1], np.diff(differs, prepend=-1))
    is_lms = np.concatenate(([False], small[1:] & ~small[:-1]))
    buckets = _Buckets(text, 258)
    lms = np.flatnonzero(is_lms).astype(buckets.kind)
    if len(lms) > 1:
        sa = buckets.induce(lms)
        ordered = sa[is_lms[sa]]
        size = np.zeros(n + 1, buckets.kind)
        size[lms] = np.diff(np.append(lms, n)) + 1
        a, b = ordered[:-1], ordered[1:]
        # Separators are told apart, so that ties end there.
        same = (size[a] == size[b]) & (text[a] != 1)
        k, open_ = 0, np.flatnonzero(same)
        a, b, left = a[open_], b[open_], size[a[open_]]
        while len(open_):
            alike = text[a + k] == text[b + k]
            same[open_[~alike]] = False
            k += 1
            go = np.flatnonzero(alike & (left > k))
            open_, a, b, left = open_[go], a[go], b[go], left[go]
        name = np.empty(n + 1, buckets.kind)
        name[ordered] = np.concatenate(([0], np.cumsum(~same)))
        names = name[lms]
        if names.max() + 1 < len(lms):
            lms = lms[_order_of_names(names)]
        else:
            lms = lms[np.argsort(names)]
    return buckets.induce(lms)[1:]


def permuted_lcp(data: np.ndarray, sa: np.ndarray, end: np.ndarray, at: np.ndarray, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For the positions ``at``: the suffix just before each in ``sa``, and their common prefix.

    Prefixes end at ``end`` of their position (segments don't run together) and are
    counted up to ``most``; those under ``least`` count as 0. Lengths are found by
    doubling over range hashes, after one comparison of the least length.
    """
    before = np.full(len(data), -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    phi = before[at]
    there = phi >= 0
    other = np.where(there, phi, at)
    room = np.where(there, np.minimum(np.minimum(end[at] - at, end[other] - other), most), 0)
    h = ByteHash(data)
    length = np.zeros(len(at), np.int64)
    go = np.flatnonzero(room >= least)
    if least and len(go):
        start = np.arange(len(data) - least + 1)
        prefix = h.raw(start, start + least)
        go = go[prefix[at[go]] == prefix[other[go]]]
        length[go] = least
    at, other, room = at[go], other[go], room[go]
    step = 1 << max(0, (most - least).bit_length() - 1)
    while step and most > least:
        can = np.flatnonzero(length[go] + step <= room)
        p, q = at[can] + length[go[can]], other[can] + length[go[can]]
        length[go[can[h.raw(p, p + step) == h.raw(q, q + step)]]] += step
        step //= 2
    return phi, length
