"""Runs (maximal periodic stretches) of the words of a text, by enumeration of maximal pairs.

Two places i < j of a text with exactly l equal words from there on, and different words before them, are a maximal pair. If
their distance j - i is at most l, the words from i to j + l have that distance as a period and no neighbouring word keeps it: a run. All
runs come from such pairs, so nothing has to be extended. A pair whose distance is a multiple of the smallest period
covers the same words as the pair with that period, which is kept.

The pairs come from the LCP-interval tree of the suffix order, bottom up. An interval holds the places that share its l words, in order, and one
list for each word on the left. Where two intervals meet, each place of the smaller one looks within distance l of it in the larger
one for places with another left word. Places within that distance of each other that share l words lie in few arithmetic progressions, in
which only the first has another left word, so a look-up through the left-word lists finds few places. Intervals below half the least
length cannot hold a run; texts without so long a repeat are passed over.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import map_batches

LEAST_WORDS = 12

FACTOR = np.uint64(0x9E3779B97F4A7C15)

RUN = "struct<start: long, length: long, period: long>"


def _numbers(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones equal."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _repeats(symbols: np.ndarray, width: int) -> bool:
    """Whether some `width` neighbouring symbols may occur twice; if not, they surely do not."""
    n = len(symbols) - width + 1
    if n < 2:
        return False
    value = np.zeros(n, np.uint64)
    mixed = (symbols.astype(np.uint64) + np.uint64(1)) * FACTOR
    mixed ^= mixed >> np.uint64(29)
    for i in range(width):
        value = value * FACTOR + mixed[i : i + n]
    value.sort()
    return bool((value[1:] == value[:-1]).any())


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and the common prefix length of each with the one before it (0 for the first)."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank.astype(np.int32)], 1
    while int(rank.max()) < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank.astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    # Two places agree in 2 ** k words if their ranks of that width are equal; shorter suffixes never are.
    common, a, b = np.zeros(n, np.int64), order[:-1], order[1:]
    for k in reversed(range(len(ranks))):
        x, y = a + common[1:], b + common[1:]
        inside = (x < n) & (y < n)
        common[1:][inside] += (ranks[k][x[inside]] == ranks[k][y[inside]]) * (1 << k)
    return order, common


class _Interval:
    """The places below a node of the tree, in order, and the same by the word on their left."""

    __slots__ = ("places", "left")

    def __init__(self, place: int, left: int) -> None:
        self.places, self.left = [place], {left: [place]}


def _meet(one: _Interval, two: _Interval, common: int, least: int, left: list[int], found: dict[tuple[int, int], int]) -> _Interval:
    """Both intervals as one, after noting the maximal pairs between them: they agree in exactly `common` words."""
    if len(one.places) < len(two.places):
        one, two = two, one
    places, classes = one.places, one.left
    nearest = max(1, least - common)
    for x in two.places:
        own = left[x]
        lo, hi = bisect_left(places, x - common), bisect_right(places, x + common)
        if lo == hi:
            continue
        if hi - lo <= len(classes):
            others = [y for y in places[lo:hi] if left[y] != own]
        else:
            others = [y for word, of in classes.items() if word != own for y in of[bisect_left(of, x - common) : bisect_right(of, x + common)]]
        for y in others:
            first, period = (x, y - x) if x < y else (y, x - y)
            if period >= nearest:
                stretch = (first, first + period + common)
                if found.get(stretch, period) >= period:
                    found[stretch] = period
    for x in two.places:
        insort(places, x)
        own = classes.get(left[x])
        if own is None:
            classes[left[x]] = [x]
        else:
            insort(own, x)
    return one


def runs(words: list[bytes], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run of at least `least` words and two periods, by start, then period."""
    symbols, shortest = _numbers(words), -(-least // 2)
    if not _repeats(symbols, shortest):
        return []
    order, common = suffix_order(symbols)
    left = [-1, *symbols[:-1].tolist()]  # nothing is left of the first word, which differs from every word
    found: dict[tuple[int, int], int] = {}
    waiting: list[tuple[_Interval, int]] = []  # intervals still open, with the words each shares with what follows, increasing
    following = [*common[1:].tolist(), 0]
    for place, shared in zip(order.tolist(), following):
        if shared < shortest and not waiting:
            continue
        node = _Interval(place, left[place])
        while waiting and waiting[-1][1] >= shared:
            before, words_shared = waiting.pop()
            node = _meet(before, node, words_shared, least, left, found)
        if shared >= shortest:
            waiting.append((node, shared))
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], of: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not of:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in of:
        depth[start + period] += 1
        depth[start + length] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, runs (by start, then period; empty if none) and collapsed (the text's words without repeated periods) of every row.

    Words are what space and the control characters 9 to 13 part. A null or empty text has no run and an empty collapsed text. A
    run is counted once, with its smallest period. Repeated rows give repeated rows; a null doc_id stays null. A text is
    handled whole by one task, in memory proportional to its words times the logarithm of its longest repeat. Other columns are not read.
    """
    parts = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def run(batches):
        for batch in batches:
            flat, ends, texts = [], [0], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                of = runs(words, least)
                flat += of
                ends.append(len(flat))
                texts.append(collapsed(words, of))
            columns = [pa.array([r[i] for r in flat], kind) for i, (_, kind) in enumerate(parts)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [name for name, _ in parts]))
            whole = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, whole], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, f"doc_id long, runs array<{RUN}>, collapsed string")
