"""Suffix arrays by induced sorting, a character bucket at a time in numpy, and longest common prefixes in text order."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last character stands before an end smaller than all."""
    step = np.sign(np.diff(t.astype(np.int64), append=-1))
    at = np.where(step != 0, np.arange(len(t)), len(t) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


class _Inducer:
    def __init__(self, t: np.ndarray):
        self.t, self.small = t, _types(t)
        self.size = np.bincount(t, minlength=256)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.used = np.flatnonzero(self.size)

    def sort(self, leftmost: np.ndarray) -> np.ndarray:
        """All suffixes from the leftmost-smaller ones, given in their order."""
        t, small, n = self.t, self.small, len(self.t)
        sa = np.full(n, -1, np.int64)
        of = t[leftmost]
        seeds = np.bincount(of, minlength=256)
        seed_end = np.cumsum(seeds)
        order = np.argsort(of, kind="stable")
        leftmost = leftmost[order]
        head = self.begin.copy()
        if not small[n - 1]:  # the suffix before the end comes first in its bucket
            sa[head[t[n - 1]]] = n - 1
            head[t[n - 1]] += 1
        for c in self.used:
            done = self.begin[c]
            while done < head[c]:  # runs of one character come in waves
                wave, done = sa[done : head[c]], head[c]
                self._put(sa, head, wave, False)
            self._put(sa, head, leftmost[seed_end[c] - seeds[c] : seed_end[c]], False)
        tail = self.end.copy()
        for c in self.used[::-1]:
            done = self.end[c]
            while done > tail[c]:
                wave, done = sa[tail[c] : done][::-1], tail[c]
                self._put(sa, tail, wave, True)
            self._put(sa, tail, sa[self.begin[c] : head[c]][::-1], True)
        return sa

    def _put(self, sa: np.ndarray, edge: np.ndarray, wave: np.ndarray, small: bool) -> None:
        """The predecessors of a wave, in its order, at the edges of their buckets."""
        before = wave[wave > 0] - 1
        before = before[self.small[before] == small]
        if not len(before):
            return
        chars = self.t[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        counts = np.bincount(chars, minlength=256)
        rank = np.arange(len(chars)) - (np.cumsum(counts) - counts)[chars]
        if small:
            sa[edge[chars] - 1 - rank] = before
            edge -= counts
        else:
            sa[edge[chars] + rank] = before
            edge += counts


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros past the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(t) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(t) + 1] << np.uint64(8 * k)
    return out


def common(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``most``."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    most = np.minimum(most, np.minimum(n - a, n - b))
    while len(live):
        x = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        low = x & (~x + np.uint64(1))
        out[live] += np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        live = live[(x == 0) & (out[live] < most[live])]
    return np.minimum(out, most)


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: pairs get names, then pairs of pairs, until all differ."""
    rank, h, n = names.astype(np.int64), 1, len(names)
    while True:
        key = rank * (n + 2)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of bytes: classify, sort leftmost-smaller substrings, name them, order the names, induce the rest."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    run = _Inducer(t)
    left = np.flatnonzero(run.small[1:] & ~run.small[:-1]) + 1
    if len(left) > 1:
        sa = run.sort(left)
        mark = np.zeros(n, bool)
        mark[left] = True
        inner = sa[mark[sa]]
        place = np.empty(n, np.int64)
        place[left] = np.arange(len(left))
        length = np.diff(left, append=n - 1) + 1
        size = length[place[inner]]
        a, b = inner[:-1], inner[1:]
        same = size[:-1] == size[1:]
        same[same] = common(_words(t), n, a[same], b[same], size[1:][same]) == size[1:][same]
        # The last one ends at the text's end, which no other does.
        same &= (a != left[-1]) & (b != left[-1])
        name = np.empty(len(left), np.int64)
        name[place[inner]] = np.concatenate([[0], np.cumsum(~same)])
        left = left[_rank_names(name)]
    return run.sort(left)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text position: the prefix shared with the suffix before it in the array, up to ``most``. ``sa`` may leave suffixes out."""
    out = np.zeros(len(t), np.int64)
    if len(sa) > 1:
        out[sa[1:]] = common(_words(t), len(t), sa[1:], sa[:-1], np.full(len(sa) - 1, most))
    return out
