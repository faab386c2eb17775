"""Two-stage suffix sorting of many short strings at once.

Suffixes smaller than their successor are sorted directly, all others are induced: a scan
over the buckets of first characters, in order, places the predecessor of each suffix it
meets behind those already placed in its own bucket.  Whole buckets are handled as arrays.
"""

from __future__ import annotations

import numpy as np


def _words(t: np.ndarray) -> np.ndarray:
    """The eight characters from each position as one big-endian number."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(t), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(t)]
    return out


def _direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` characters; only runs that are still tied are compared further."""
    order = at[np.argsort(words[at], kind="stable")]
    group = np.concatenate(([0], np.cumsum(words[order][1:] != words[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    last = len(words) - 1
    for d in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key = words[np.minimum(order[where] + d, last)]
        again = np.lexsort((key, group[where]))
        order[where], key = order[where][again], key[again]
        g = group[where]
        step = np.zeros(len(order), np.int64)
        step[where[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        fresh = np.concatenate(([0], group[1:] != group[:-1])).astype(np.int64) if len(order) else step
        group = np.cumsum(fresh | step)
    return order


def sort_suffixes(t: np.ndarray, ends: np.ndarray, want: np.ndarray, depth: int) -> np.ndarray:
    """The positions flagged in ``want``, ordered by their next ``depth`` characters.

    ``t`` holds strings without character 0, each followed by one 0 at the places ``ends``.
    """
    n = len(t)
    up = np.empty(n, bool)  # smaller than its successor
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    up[:-1] = t[:-1] < t[1:]
    up[-1] = True
    nearest = np.where(differs, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    up = up[nearest]
    up[ends] = True
    # a suffix that is induced needs its successor, up to one that is sorted directly
    seed = np.where(up, np.arange(n), n - 1)
    seed = np.minimum.accumulate(seed[::-1])[::-1]
    reach = np.zeros(n + 1, np.int64)
    wanted = np.flatnonzero(want)
    np.add.at(reach, wanted, 1)
    np.add.at(reach, seed[wanted] + 1, -1)
    inside = np.cumsum(reach[:-1]) > 0

    words = _words(t)
    direct = _direct(np.flatnonzero(inside & up), words, depth)
    bounds = np.searchsorted(t[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(batch: np.ndarray, c: int) -> np.ndarray:
        """Sends induced predecessors to their buckets; returns those of this very bucket."""
        p = batch[batch > 0] - 1
        p = p[inside[p] & ~up[p]]
        first = t[p]
        later = p[first > c]
        if len(later):
            f = t[later]
            order = np.argsort(f, kind="stable")
            later, f = later[order], f[order]
            cut = np.flatnonzero(f[1:] != f[:-1]) + 1
            for part in np.split(later, cut):
                pending[t[part[0]]].append(part)
        return p[first == c]

    for c in range(256):
        if pending[c]:
            wave = np.concatenate(pending[c])
            while len(wave):
                out.append(wave)
                wave = induce(wave, c)
        own = direct[bounds[c] : bounds[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[want[order]]


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each position in ``order`` with the one before it, in steps of eight characters up to ``depth``; 0 for the first."""
    words = _words(t)
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    last = len(t) - 1
    for d in range(0, depth, 8):
        if not len(live):
            break
        live = live[words[np.minimum(order[live] + d, last)] == words[np.minimum(order[live - 1] + d, last)]]
        lcp[live] = d + 8
    return lcp
