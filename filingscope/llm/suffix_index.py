"""A small suffix order in memory and threshold-bounded interval expansion over its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and the place of each start. No two suffixes are equal."""
    n, base = len(symbols), int(symbols.max()) + 2
    known = max(1, int(62 / np.log2(base)))  # symbols that one number holds
    padded = np.concatenate([symbols + 1, np.zeros(known, np.int64)])
    key = padded[:n].copy()
    for k in range(1, known):
        key *= base
        key += padded[k : n + k]
    order = np.argsort(key)
    first = np.r_[True, key[order][1:] != key[order][:-1]]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    while True:
        alone = first & np.r_[first[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order, rank
        sub = order[tied]
        behind = sub + known
        further = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[sub] << 32 | further
        by = np.argsort(key)
        sub, key = sub[by], key[by]
        order[tied] = sub
        new = np.r_[True, key[1:] != key[:-1]]
        first[tied] = new
        rank[sub] = np.maximum.accumulate(np.where(new, tied, 0))
        known *= 2


def classes(symbols: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and the class of each place in it: suffixes share a class if they agree in `threshold` symbols.

    Intervals of equal prefixes are expanded breadth first, one symbol to the left at a time. The first interval that ends
    at a place, at length k + 1, shows a common prefix of k with the next suffix. Each place is met once; expansion stops at
    the threshold, and places not met until then lie inside a class.
    """
    n = len(symbols)
    order, rank = suffix_order(symbols)
    to_left = rank[order - 1]  # the place of the suffix one symbol longer; the first one wraps to the last separator
    head = symbols[order]
    met = np.zeros(n + 1, bool)
    met[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(threshold):
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        place = to_left[inside]
        by = np.argsort(place)
        place, owner = place[by], owner[by]
        first = np.r_[True, (np.diff(place) != 1) | (np.diff(owner) != 0) | (np.diff(head[place]) != 0)]
        low = place[first]
        high = place[np.r_[first[1:], True]] + 1
        new = ~met[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        met[high] = True
    return order, np.cumsum(np.r_[0, met[1:n]])


def shared_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each text, whether the string of `length` bytes at each start also starts elsewhere in these texts."""
    separators = len(texts)
    parts = []
    for i, text in enumerate(texts):
        parts.append(np.frombuffer(text, np.uint8).astype(np.int64) + separators)
        parts.append(np.array([i], np.int64))
    symbols = np.concatenate(parts)
    order, groups = classes(symbols, length)
    whole = np.zeros(len(symbols), bool)
    at = 0
    for text in texts:
        whole[at : at + max(0, len(text) - length + 1)] = True
        at += len(text) + 1
    counted = whole[order]
    size = np.bincount(groups[counted], minlength=int(groups[-1]) + 1)
    again = np.zeros(len(symbols), bool)
    again[order] = counted & (size[groups] > 1)
    out, at = [], 0
    for text in texts:
        out.append(again[at : at + max(0, len(text) - length + 1)])
        at += len(text) + 1
    return out
