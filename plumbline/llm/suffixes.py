"""Suffix arrays by induced sorting and permuted longest common prefixes, on arrays in memory."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (type S); the last position, a unique least sign, is S."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    nxt = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n))]
    small = np.ones(n, bool)
    inside = nxt < n - 1
    small[inside] = t[nxt[inside]] < t[nxt[inside] + 1]
    return small


class _Buckets:
    """Positions by first sign, in order of arrival."""

    def __init__(self, signs: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(signs)]

    def deal(self, at: np.ndarray, signs: np.ndarray) -> None:
        order = np.argsort(signs, kind="stable")
        at, signs = at[order], signs[order]
        cuts = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1], [True]])) if len(at) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            self.parts[signs[a]].append(at[a:b])


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, signs: int) -> np.ndarray:
    """The order of all suffixes induced from leftmost-small ones, given in order within each first sign.

    Larger suffixes are dealt out by a pass upwards, then smaller ones by a pass downwards; a bucket is one array
    operation, repeated only along runs of its own sign.
    """
    seed = _Buckets(signs)
    seed.deal(seeds, t[seeds])

    def run(kind: bool, order: range, other: list[list[np.ndarray]], flip: bool) -> list[list[np.ndarray]]:
        made = _Buckets(signs)
        for c in order:
            done = 0
            while done < len(made.parts[c]):  # grows along runs of c
                new = made.parts[c][done:]
                done = len(made.parts[c])
                before = np.concatenate(new) - 1
                before = before[before >= 0]
                before = before[small[before] == kind]
                made.deal(before, t[before])
            if other[c]:
                whole = np.concatenate(other[c])
                before = (whole[::-1] if flip else whole) - 1
                before = before[before >= 0]
                before = before[small[before] == kind]
                made.deal(before, t[before])
        return made.parts

    large = run(False, range(signs), seed.parts, False)
    little = run(True, range(signs - 1, -1, -1), large, True)
    little[t[-1]].append(np.array([len(t) - 1], np.int64))
    out = []
    for c in range(signs):
        out += large[c]
        if little[c]:
            out.append(np.concatenate(little[c])[::-1])
    return np.concatenate(out)


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the leftmost-small substrings, equal ones alike, by text position; and how many there are."""
    end = np.zeros(len(t), np.int64)
    end[lms[:-1]] = lms[1:]
    end[lms[-1]] = lms[-1]
    a, b = ordered[:-1], ordered[1:]
    size = end[a] - a
    same = size == end[b] - b
    active, k = np.flatnonzero(same), 0
    while len(active):
        good = t[a[active] + k] == t[b[active] + k]
        same[active[~good]] = False
        active = active[good]
        active = active[size[active] > k]
        k += 1
    number = np.zeros(len(t), np.int64)
    number[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return number[lms], int((~same).sum()) + 1


def _sort_names(names: np.ndarray, deep: int | None) -> np.ndarray:
    """The order of the suffixes of a text of names: substrings are sorted and named again at twice the length,
    recursively, until all names differ (or, with ``deep``, until substrings of that many names are sorted)."""
    n, span = len(names), 1
    while True:
        following = np.zeros(n, np.int64)
        following[:n - span] = names[span:] + 1
        key = names << np.int64(32) | following
        order = np.argsort(key)
        key = key[order]
        fresh = np.concatenate([[False], key[1:] != key[:-1]])
        number = np.cumsum(fresh)
        names = np.empty(n, np.int64)
        names[order] = number
        span *= 2
        if number[-1] == n - 1 or (deep is not None and span >= deep):
            return order


def suffix_array(t: np.ndarray, signs: int, deep: int | None = None) -> np.ndarray:
    """Positions of ``t`` (numbers below ``signs``, the last one a unique least) in the order of their suffixes.

    Suffixes are classified; substrings between leftmost-small positions are sorted by inducing, named, and the text of
    names is sorted recursively; a last pass induces all suffixes from them. With ``deep``, suffixes that agree in so
    many signs may stand in any order.
    """
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _induce(t, small, lms, signs)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = order[is_lms[order]]
    if len(lms) < 2:
        return order
    names, number = _names(t, lms, ordered)
    if number < len(lms):
        ordered = lms[_sort_names(names, None if deep is None else deep // 2 + 1)]  # a substring has two signs at least
    return _induce(t, small, ordered, signs)


def permuted_lcp(raw: np.ndarray, room: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position the common prefix with its predecessor in the array, in text order, and that predecessor.

    ``room`` is the distance to the end of each position's piece, where a prefix ends. Values fall by one along
    a chain of neighbours; only where a chain begins are bytes compared, eight at a time.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    starts = np.ones(n, bool)
    starts[1:] = (before[1:] != before[:-1] + 1) | (room[:-1] == 0) | (before[1:] <= 0)
    chain = np.flatnonzero(starts & (before >= 0) & (room > 0))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), np.dtype("<u8"), buffer=padded.data, strides=(1,))
    a, b = chain, before[chain]
    most = np.minimum(room[a], room[b])
    length = np.zeros(len(chain), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        x = words[a[active] + length[active]] ^ words[b[active] + length[active]]
        equal = x == 0
        step = np.where(equal, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        length[active] += step
        active = active[equal & (length[active] < most[active])]
    length = np.minimum(length, most)
    value, owner = np.zeros(n, np.int64), np.arange(n)
    value[chain] = length
    owner[~starts] = 0
    owner = np.maximum.accumulate(owner)
    return np.maximum(value[owner] - (np.arange(n) - owner), 0), before


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its ``length``-byte strings (by start) also start anywhere else in the pieces."""
    size = np.array([len(p) + 1 for p in pieces], np.int64)
    first = np.cumsum(size) - size
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    ends = first + size - 1
    t = raw.astype(np.int16) + 2
    t[ends] = 1
    sa = suffix_array(np.append(t, np.int16(0)), 258, int(size.max(initial=1)))[1:]
    room = np.repeat(ends, size) - np.arange(len(raw))
    lcp, before = permuted_lcp(raw, room, sa)
    deep = np.flatnonzero(lcp >= length)
    found = np.zeros(len(raw), bool)
    found[deep] = True
    found[before[deep]] = True
    return [found[a:a + max(0, n - length)] for a, n in zip(first.tolist(), size.tolist())]
