"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the next one; the leftmost S of each run of S is a leftmost-smaller suffix.
Their substrings are sorted by inducing, named, and, if names repeat, sorted as a string of names by recursion; two
passes then induce the order of all suffixes. Over bytes a pass goes through the buckets of first symbols in order, in linear time; it takes as
many buckets at once as don't put anything into one another, so each step is a few array operations. Over names, whose buckets hold an
item or two each, that would be a step for every few items; there a pass ranks all items together, by runs that end at a seed.
"""

from __future__ import annotations

import numpy as np


def _induce(codes: np.ndarray, n_codes: int, seeds: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """One pass over buckets in ascending order. A bucket's items are those put into it so far, then its seeds (which are in order); each
    puts its predecessor, if that is allowed, at the end of the predecessor's bucket. Returns what was put, in order."""
    sizes = np.bincount(codes[allowed], minlength=n_codes)
    start = np.zeros(n_codes + 1, np.int64)
    np.cumsum(sizes, out=start[1:])
    head = start[:-1].copy()
    out = np.empty(int(start[-1]), np.int32)
    seed_start = np.searchsorted(codes[seeds], np.arange(n_codes + 1))

    def put(items: np.ndarray) -> None:
        items = items[items > 0] - 1
        items = items[allowed[items]]
        if not len(items):
            return
        to = codes[items]
        order = np.argsort(to, kind="stable")
        to = to[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        counts = np.diff(np.append(first, len(to)))
        rank = np.arange(len(to)) - np.repeat(first, counts)
        out[head[to] + rank] = items[order]
        head[to[first]] += counts

    c, step = 0, 64
    while c < n_codes:
        stop = min(n_codes, c + step)
        slots = np.arange(start[c], start[stop])
        slots = slots[slots < np.repeat(head[c:stop], sizes[c:stop])]
        put_before, own = out[slots], seeds[seed_start[c] : seed_start[stop]]
        items = np.concatenate([put_before, own])
        of = codes[items]
        if stop > c + 1 and len(own) and len(put_before):
            order = np.argsort(of, kind="stable")
            items, of = items[order], of[order]
        before = items[items > 0] - 1
        to = codes[before[allowed[before]]]
        low = int(to.min(initial=n_codes))
        if low >= stop:
            put(items)
            c, step = stop, min(2 * step, 1 << 16)
        elif low > c:
            put(items[: np.searchsorted(of, low)])
            step = max(2, low - c)
            c = low
        else:  # the bucket puts items into itself: in rounds
            at = start[c]
            while at < head[c]:
                fresh = out[at : head[c]].copy()
                at = head[c]
                put(fresh)
            put(seeds[seed_start[c] : seed_start[c + 1]])
            c, step = c + 1, max(2, step // 2)
    return out


def _induce_runs(codes: np.ndarray, n_codes: int, seeds: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """What ``_induce`` returns. Right of an item is another item or a seed, so each begins a run that ends at a seed. Items are ranked by
    first symbol (before its seeds); then ranks are joined with those of what follows them in the run, of one, two, four, ... symbols,
    until no two are equal. Seeds have ranks of their own from the start."""
    items = np.flatnonzero(allowed)
    n_items, n_seeds = (np.bincount(codes[x], minlength=n_codes) for x in (items, seeds))
    upto = np.cumsum(n_items)
    rank = np.zeros(len(codes) + 1, np.int64)
    rank[items] = (upto - n_items + np.cumsum(n_seeds) - n_seeds)[codes[items]]
    rank[seeds] = np.arange(len(seeds)) + upto[codes[seeds]]
    next_of = np.arange(1, len(codes) + 2)
    left = items
    while len(left):
        pair = rank[left] << 32 | rank[next_of[left]]
        order = np.argsort(pair)
        pair, left = pair[order], left[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        old = pair >> 32
        group = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(left))
        first, group_first = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new, group))
        rank[left] = old + first - group_first
        left = left[~(new & np.append(new[1:], True))]
        next_of[left] = next_of[next_of[left]]
    out = np.full(len(items) + len(seeds), -1, np.int32)
    out[rank[items]] = items
    return out[out >= 0]


def _smaller_types(s: np.ndarray) -> np.ndarray:
    n = len(s)
    turn = np.where(s[:-1] != s[1:], np.arange(n - 1), n - 1)
    turn = np.append(np.minimum.accumulate(turn[::-1])[::-1], n - 1)
    return (turn == n - 1) | (s[turn] < s[np.minimum(turn + 1, n - 1)])


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings by position, equal ones alike, and how many there are."""
    n = len(s)
    length = np.zeros(n, np.int32)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    d = 0
    while len(left):
        equal = s[a[left] + d] == s[b[left] + d]
        same[left[~equal]] = False
        left = left[equal]
        d += 1
        left = left[length[a[left]] > d]
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(n, np.int32)
    names[ordered] = rank
    return names[lms], int(rank[-1]) + 1


def suffix_array(s: np.ndarray, n_codes: int, induce=_induce) -> np.ndarray:
    """The suffix array of codes 0 to n_codes - 1, of which the last is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _smaller_types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    larger = ~small
    put_small = small.copy()
    put_small[n - 1] = False

    def passes(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large = induce(s, n_codes, seeds, larger)
        smaller = induce(n_codes - 1 - s, n_codes, large[::-1], put_small)
        return large, np.append(smaller, np.int32(n - 1))[::-1]

    _, smaller = passes(lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = smaller[is_lms[smaller]]
    names, n_names = _names(s, lms, ordered)
    if n_names < len(lms):
        ordered = lms[suffix_array(names, n_names, _induce_runs)]
    large, smaller = passes(ordered)
    before_s = np.concatenate([[0], np.cumsum(np.bincount(s[smaller], minlength=n_codes))])
    before_l = np.concatenate([[0], np.cumsum(np.bincount(s[large], minlength=n_codes))])
    out = np.empty(n, np.int32)
    out[np.arange(len(large)) + before_s[s[large]]] = large
    out[np.arange(len(smaller)) + before_l[s[smaller] + 1]] = smaller
    return out


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length of the prefix that its suffix shares with the one before it in the array. Only irreducible ones
    (where the symbols before differ) are compared; each other is one less than its left neighbour's."""
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    irreducible = np.ones(n, bool)
    irreducible[1:] = (before[1:] <= 0) | (s[:-1] != s[np.maximum(before[1:], 1) - 1])
    out = np.zeros(n, np.int64)
    left = np.flatnonzero(irreducible & (before >= 0))
    length = 0
    while len(left):
        equal = s[np.minimum(left + length, n - 1)] == s[np.minimum(before[left] + length, n - 1)]
        equal &= (left + length < n) & (before[left] + length < n)
        out[left[~equal]] = length
        left = left[equal]
        length += 1
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.where(irreducible, out, out[last] - (at - last))
