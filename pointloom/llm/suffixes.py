"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classed as larger (L) or smaller (S) than the one that starts a
byte later; an S after an L is leftmost-smaller (LMS).  The LMS substrings are
sorted by inducing from any order of them, named by rank, and where names repeat
the string of names is sorted by the same method, one level down.  From the
sorted LMS suffixes all others are induced, L forwards and S backwards, each in
one scan.

Over bytes a scan takes a bucket at a time in numpy; runs of one byte take as many
rounds as they are long, so texts should be cut into segments.  The strings of
names have large alphabets and are scanned name by name.
"""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``codes`` (0 to 32,000), in order; the end is below every code."""
    n = len(codes)
    if n < 2:
        return np.arange(n)
    # one more code at the end, 0, below all others
    text = np.zeros(n + 1, np.int64)
    text[:n] = codes
    text[:n] += 1
    size = int(text.max()) + 1
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=size))
    found = _induced(text, smaller, ends, lms, size)
    order = found[_is_in(found, lms, n + 1)]
    names, count = _named(text, lms, order)
    if count < len(lms):
        order = lms[_sorted_names(names, count)]
    return _induced(text, smaller, ends, order, size)[1:]


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a code later; the last one is."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    # the first place at or after i where two neighbours differ decides for i
    nearest = differs[np.searchsorted(differs, np.arange(n - 1))]
    out = np.ones(n, bool)
    out[:-1] = text[nearest] < text[nearest + 1]
    return out


def _is_in(found: np.ndarray, lms: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n, bool)
    mark[lms] = True
    return mark[found]


def _dealt(places: np.ndarray, text: np.ndarray, free: np.ndarray, found: np.ndarray, step: int) -> None:
    """Puts ``places`` into their buckets from ``free`` on, in their order, upwards or downwards."""
    codes = text[places].astype(np.int16)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    counts = np.bincount(codes, minlength=len(free))
    starts = np.cumsum(counts) - counts
    found[free[codes] + step * (np.arange(len(codes)) - starts[codes])] = places[order]
    free += step * counts


def _induced(text: np.ndarray, smaller: np.ndarray, ends: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, from the LMS suffixes ``lms`` in order."""
    n = len(text)
    starts = np.concatenate([[0], ends[:-1]])
    found = np.full(n, -1)
    by_code = np.argsort(text[lms].astype(np.int16), kind="stable")
    placed = lms[by_code]
    cuts = np.searchsorted(text[placed], np.arange(size + 1))
    head = starts.copy()
    used = np.flatnonzero(ends > starts)

    def before(places: np.ndarray, wanted: bool) -> np.ndarray:
        places = places[places > 0] - 1
        return places[smaller[places] == wanted]

    for c in used:  # forwards: what is larger than its successor
        at = starts[c]
        while at < head[c]:
            block, at = found[at : head[c]], head[c]
            _dealt(before(block, False), text, head, found, 1)
        _dealt(before(placed[cuts[c] : cuts[c + 1]], False), text, head, found, 1)
    tail = ends - 1
    for c in used[::-1]:  # backwards: what is smaller
        at = ends[c] - 1
        while at > tail[c]:
            block, at = found[tail[c] + 1 : at + 1][::-1], tail[c]
            _dealt(before(block, True), text, tail, found, -1)
        _dealt(before(found[starts[c] : head[c]][::-1], True), text, tail, found, -1)
    found[0] = n - 1  # the end has no smaller one before it to induce it
    return found


def _named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings in text order, equal ones sharing one, and how many there are."""
    n = len(text)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        x, y = a[open_] + step, b[open_] + step
        equal = text[x] == text[y]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal & (length[a[open_]] > step)]
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names[lms], int(names[order[-1]]) + 1


def _sorted_names(text: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of a string of names below ``size`` whose last one, 0, occurs once."""
    n = len(text)
    if size == n:
        return np.argsort(text)
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=size))
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    codes = text.tolist()
    # the name before i if it is larger, or smaller, than its successor, else -1; also for -1, an empty place
    before = np.concatenate([[-1], text[:-1], [-1]])
    kind = np.concatenate([[True], smaller[:-1], [True]])
    larger_before = np.where(kind, -1, before).tolist()
    smaller_before = np.where(kind, before, -1).tolist()

    def induce(known: list[int]) -> list[int]:
        found = [-1] * n
        tail = ends[:]
        for i in reversed(known):
            c = codes[i]
            found[tail[c]] = i
            tail[c] -= 1
        head = starts[:]
        for i in found:  # also what this loop puts there
            c = larger_before[i]
            if c >= 0:
                k = head[c]
                found[k] = i - 1
                head[c] = k + 1
        tail = ends[:]
        for k in range(n - 1, -1, -1):
            i = found[k]
            c = smaller_before[i]
            if c >= 0:
                k = tail[c]
                found[k] = i - 1
                tail[c] = k - 1
        return found

    found = np.array(induce(lms.tolist()))
    order = found[_is_in(found, lms, n)]
    names, count = _named(text, lms, order)
    if count < len(lms):
        order = lms[_sorted_names(names, count)]
    return np.array(induce(order.tolist()))


def permuted_prefixes(codes: np.ndarray, order: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each start, in text order: how many codes its suffix shares with the one before it in ``order``.

    At most ``limit`` of either start, how far its segment reaches.  Codes are
    compared eight at a time, for all starts that still agree.
    """
    n = len(codes)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([codes.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").reshape(-1)
    most = np.where(before < 0, 0, np.minimum(limit, limit[before]))
    shared = np.zeros(n, np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        here = shared[open_]
        x = words[open_ + here] ^ words[before[open_] + here]
        equal = np.full(len(x), 8)
        apart = np.flatnonzero(x)
        low = x[apart]
        low &= ~low + np.uint64(1)  # the lowest bit that differs
        equal[apart] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        shared[open_] = np.minimum(here + equal, most[open_])
        open_ = open_[(equal == 8) & (shared[open_] < most[open_])]
    return shared
