"""Recursive induced sorting of texts of names: suffixes in order with their common prefixes.

A text of names is a level of the recursion: its own smaller-type suffixes are named, their text is sorted in turn, and
two sweeps induce all other suffixes from them. A sweep reads blocks of names in order. Suffixes wait in a queue for the
block they begin in, in the order they were put, each with the prefix it shares with the one before it of its name.
"""

from __future__ import annotations

import numpy as np

#: Suffixes that a block of names has, about.
BLOCK_ROWS = 4096


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last name is smaller than all others."""
    n = len(text)
    out = np.ones(n, bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if len(differs):
        at = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
        out[:-1] = text[at] < text[at + 1]
    return out


def minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) for each pair, hi > lo."""
    out, size, level, k = np.empty(len(lo), x.dtype), hi - lo, x, 0
    longest = int(size.max(initial=0))
    while (1 << k) <= longest:
        use = np.flatnonzero((size >> k) == 1)
        out[use] = np.minimum(level[lo[use]], level[hi[use] - (1 << k)])
        if (2 << k) <= longest:
            level = np.minimum(level[: -(1 << k)], level[1 << k :])
        k += 1
    return out


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Names that the suffixes a and b have in common, up to most."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(most):
        live = live[(np.maximum(a[live], b[live]) + k < len(text))]
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
        out[live] += 1
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    return np.append(True, x[1:] != x[:-1])[: len(x)]


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks by keys, the first one first; equal keys have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new |= _starts(k[order])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def induced(text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, common: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted suffixes in order, with the prefix each shares with the one before it of its name, from the sorted seeds
    that they lead to: a wanted suffix is the one before a seed, or before another wanted one, whose name isn't larger.
    Of one name wanted suffixes come before seeds."""
    names = int(text.max()) + 1
    cut = np.searchsorted(np.cumsum(np.bincount(text, minlength=names)), np.arange(BLOCK_ROWS, len(text) + BLOCK_ROWS, BLOCK_ROWS))
    bounds = np.unique(np.append(np.append(0, np.minimum(cut + 1, names)), names))
    waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in bounds]
    seed_cut = np.searchsorted(text[seeds], bounds)
    begun = np.zeros(names, bool)
    order, prefix = [], []
    for b, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        first = np.concatenate([np.empty(0, np.int64), *[s for s, _ in waiting[b]]])
        carried = np.concatenate([np.empty(0, np.int64), *[c for _, c in waiting[b]]])
        waiting[b] = []
        by = np.argsort(text[first], kind="stable")
        first, carried = first[by], carried[by]
        own = slice(int(seed_cut[b]), int(seed_cut[b + 1]))
        item = np.concatenate([first, seeds[own]])
        kind = np.repeat([0, 2], [len(first), own.stop - own.start])
        given = np.append(carried, common[own])
        place = np.append(np.arange(len(first)), np.arange(own.stop - own.start))
        follows = np.arange(len(item))  # the item each one was induced from, itself if from elsewhere
        fresh = np.arange(len(item))
        while len(fresh):  # those before an item that begin in this block too
            before = item[fresh] - 1
            use = before >= 0
            use[use] = wanted[before[use]] & (text[before[use]] < hi)
            grown = before[use]
            follows = np.append(follows, fresh[use])
            fresh = np.arange(len(item), len(item) + len(grown))
            item, kind = np.append(item, grown), np.append(kind, np.ones(len(grown), np.int64))
            given, place = np.append(given, np.zeros(len(grown), np.int64)), np.append(place, np.zeros(len(grown), np.int64))
        if not len(item):
            continue
        name = text[item]
        rank = _dense(name, kind, place)
        jump = follows.copy()
        reach = 1
        while reach < most and (kind[jump] == 1).any():  # where several follow from items of one rank, theirs decide
            rank = _dense(rank, rank[jump])
            jump = jump[jump]
            reach *= 2
        rank = _dense(rank, np.where(kind == 1, rank[jump], rank))
        at = np.argsort(rank, kind="stable")
        where = np.empty(len(at), np.int64)
        where[at] = np.arange(len(at))
        x, y = at[:-1], at[1:]
        lcp = np.zeros(len(at), np.int64)
        lcp[1:] = _between(text, item, kind, given, place, follows, name, x, y, len(first), most)
        keep = kind[at] != 2
        order.append(item[at][keep])
        # the one before it may be a seed, which isn't kept; names begin with what is wanted
        prefix.append(np.where(_starts(name[at]), 0, lcp)[keep])
        _pass_on(text, wanted, item[at], np.where(_starts(name[at]), 0, lcp), hi, bounds, waiting, begun, most)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *order]), np.concatenate([none, *prefix])


def _between(text, item, kind, given, place, follows, name, x, y, n_first, most) -> np.ndarray:
    """Common prefixes of neighbours x, y of a block: down both chains while names agree, then what is known of their ends."""
    out = np.zeros(len(x), np.int64)
    a, b, live = x.copy(), y.copy(), np.arange(len(x))
    steps = 0
    while len(live) and steps < most:
        live = live[name[a[live]] == name[b[live]]]
        both = (kind[a[live]] == 1) & (kind[b[live]] == 1)
        ended = live[~both]
        i, j = a[ended], b[ended]
        same = np.flatnonzero((kind[i] == kind[j]) & (i != j))
        if len(same):  # two that came from elsewhere, or two seeds: the least that lies between them
            e = ended[same]
            p, q = np.minimum(place[i[same]], place[j[same]]), np.maximum(place[i[same]], place[j[same]])
            shift = np.where(kind[i[same]] == 0, 0, n_first)
            out[e] = steps + minima(given, p + 1 + shift, q + 1 + shift)
        out[ended[i == j]] = most
        other = np.flatnonzero(kind[i] != kind[j])
        if len(other):
            e = ended[other]
            out[e] = steps + shared(text, item[a[e]], item[b[e]], most - steps)
        live = live[both]
        a[live], b[live] = follows[a[live]], follows[b[live]]
        steps += 1
        out[live] = steps
    return np.minimum(out, most)


def _pass_on(text, wanted, item, lcp, hi, bounds, waiting, begun, most) -> None:
    """Puts what comes before the items of a block into the queues of later blocks. Items of different blocks have different
    names, so a name's first one of a block shares its name alone with the one put before."""
    before = item - 1
    use = before >= 0
    use[use] = wanted[before[use]] & (text[before[use]] >= hi)
    use = np.flatnonzero(use)
    if not len(use):
        return
    target = text[before[use]]
    by = np.argsort(target, kind="stable")
    use, target = use[by], target[by]
    head = np.flatnonzero(_starts(target))
    previous = np.append(-1, use[:-1])
    least = np.zeros(len(use), np.int64)
    inner = np.ones(len(use), bool)
    inner[head] = False
    least[inner] = minima(lcp, previous[inner] + 1, use[inner] + 1)
    share = np.minimum(least + 1, most)
    share[head] = np.where(begun[target[head]], np.minimum(1, most), 0)
    begun[target[head]] = True
    block = np.searchsorted(bounds, target, "right") - 1
    cut = np.flatnonzero(_starts(block))
    for s, e in zip(cut, np.append(cut[1:], len(use)), strict=True):
        # in the order they were read, so that a name's queue stays in order
        part = np.arange(s, e)
        waiting[int(block[s])].append((before[use[part]], share[part]))


def sorted_names(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a text whose last name is 0 and the only 0, in order, and the names each shares with the one before
    it, up to most. Order beyond most names isn't kept apart."""
    n = len(text)
    if most <= 1 or n == 1:
        order = np.argsort(text, kind="stable")
        return order, np.where(_starts(text[order]), 0, min(1, most))
    small = types(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds):
        name = _named(text, seeds, most)
        if name.max() + 1 < len(seeds):
            by, agree = sorted_names(name, most // 2 + 1)
        else:
            by, agree = np.argsort(name, kind="stable"), np.zeros(len(seeds), np.int64)
        seeds, common = in_order(text, seeds, by, agree, most)
    else:
        common = seeds
    larger, one = induced(text, ~small, seeds, common, most)
    # the other way round smaller-type suffixes are to larger-type ones what those were to the seeds
    top = int(text.max())
    back = np.append(np.zeros(min(1, len(larger)), np.int64), one[1:][::-1])
    smaller, two = induced(top - text, small & (np.arange(n) < n - 1), larger[::-1], back, most)
    smaller, two = smaller[::-1], np.append(np.zeros(min(1, len(smaller)), np.int64), two[1:][::-1])
    # a name's larger-type suffixes come first; equal names keep that by a stable sort
    both, known = np.concatenate([[n - 1], larger, smaller]), np.concatenate([[0], one, two])
    kind = np.repeat([0, 1], [1 + len(larger), len(smaller)])
    at = np.argsort(text[both], kind="stable")
    both, known, kind = both[at], known[at], kind[at]
    head = _starts(text[both])
    known = np.where(head, 0, known)
    seam = np.flatnonzero(~head & (kind != np.append(0, kind[:-1])))
    known[seam] = shared(text, both[seam - 1], both[seam], most)
    return both, known


def in_order(text: np.ndarray, seeds: np.ndarray, by: np.ndarray, agree: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds in the order of their names' suffixes, and what each shares with the one before it: the length of the names that
    the two have in common, and of what the first different ones do."""
    ends = np.append(seeds, len(text))
    a, b = by[:-1], by[1:]
    known = ends[np.minimum(a + agree[1:], len(seeds))] - seeds[a]
    open_ = np.flatnonzero(known < most)
    known[open_] += shared(text, seeds[a][open_] + known[open_], seeds[b][open_] + known[open_], most)
    return seeds[by], np.append(np.zeros(min(1, len(by)), np.int64), np.minimum(known, most))


def _named(text: np.ndarray, seeds: np.ndarray, most: int) -> np.ndarray:
    """Ranks of the strings of names from each seed to the next one, a name at a time and up to most; a string that ends where
    another goes on, with smaller names, is the larger one. Meanwhile a rank is how many strings come before."""
    ends, top = np.append(seeds[1:], len(text) - 1), int(text.max()) + 1
    _, at, counts = np.unique(text[seeds], return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[at]
    live, k = np.flatnonzero(counts[at] > 1), 1
    while len(live) and k <= most:
        inside = seeds[live] + k <= ends[live]
        key = rank[live] * (top + 1) + np.where(inside, text[np.minimum(seeds[live] + k, len(text) - 1)], top)
        by = np.argsort(key, kind="stable")
        live, key, inside = live[by], key[by], inside[by]
        group, run = np.flatnonzero(_starts(key // (top + 1))), np.flatnonzero(_starts(key))
        size = np.diff(np.append(run, len(key)))
        rank[live] += np.repeat(run - group[np.searchsorted(group, run, "right") - 1], size)
        live, k = live[(np.repeat(size, size) > 1) & inside], k + 1
    return np.unique(rank, return_inverse=True)[1]
