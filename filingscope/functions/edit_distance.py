"""Unit-cost edit distance and set difference of two token sequences.

Spark's built-in `levenshtein` fills the whole table cell by cell, and needs tokens re-encoded as
characters first, which bounds the vocabulary. The Arrow UDF below processes one table column per
step on a machine integer as wide as the pattern (the bit-vector method of Myers, 1999, and Hyyro,
2003), so one step costs len/64 word operations instead of len cell updates. Similar texts need a band around
the diagonal only: its width starts from what the tokens alone show to differ and doubles until the distance lies within it.
Where one walk over both texts needs no more edits than that, it is the distance and no column is computed.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter
from itertools import filterfalse

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the helper with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Match masks kept in memory per pair; masks beyond it are rebuilt when needed.
MASK_BUDGET_BYTES = 256 << 20
# Edits that the narrowest band allows for, and columns that share a window at least.
LEAST_BAND = 64
BLOCK = 512
# Tokens of the longer and the shorter side that a walk over both may leave unmatched between two equal ones.
GAPS = ((1, 0), (1, 1), (2, 1), (2, 0), (2, 2), (3, 2), (3, 1), (3, 0), (3, 3))


def _mask(positions: list[int], width: int) -> int:
    bits = bytearray((width >> 3) + 1)
    for p in positions:
        bits[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(bits, "little")


def token_distance(left: list[str], right: list[str]) -> int:
    """Edit distance of two token lists with unit costs."""
    if left == right:
        return 0
    # A common prefix and suffix never changes the distance.
    lo, hi = 0, min(len(left), len(right))
    while lo < hi and left[lo] == right[lo]:
        lo += 1
    end = 0
    while end < hi - lo and left[-1 - end] == right[-1 - end]:
        end += 1
    left, right = left[lo : len(left) - end], right[lo : len(right) - end]
    if not left or not right:
        return len(left) + len(right)

    shorter, longer = sorted((left, right), key=len)
    # Every edit removes at most one token from what the sides do not share, so this many edits are needed.
    least = len(longer) - sum((Counter(shorter) & Counter(longer)).values())
    if 2 * least < len(longer) and _walked(longer, shorter, least) == least:
        return least
    limit = max(LEAST_BAND, least + least // 4)
    places: dict[str, list[int]] = {}
    wanted = set(longer)
    for i, token in enumerate(shorter):
        if token in wanted:
            places.setdefault(token, []).append(i)
    # A band that is not much narrower than the whole would only be paid for in addition.
    while 8 * limit + BLOCK < len(shorter):
        found = _banded(places, len(shorter), longer, limit)
        if found <= limit:
            return found
        limit *= 4
    return _whole(places, len(shorter), longer)


def _walked(longer: list[str], shorter: list[str], limit: int) -> int:
    """The edits of one walk over both sides, never fewer than the distance; it stops beyond `limit`.

    No gap leaves more tokens of the shorter side than of the longer one: with such a gap the edits would exceed what the
    tokens alone show to differ, which is the limit.
    """
    m, n = len(longer), len(shorter)
    # Two different ends, so that a look beyond the last token finds nothing equal.
    longer, shorter = [*longer, 0, 0, 0], [*shorter, 1, 1, 1]
    i = j = edits = 0
    while i < m and j < n:
        if longer[i] == shorter[j]:
            i += 1
            j += 1
            continue
        for p, q in GAPS:
            if longer[i + p] == shorter[j + q]:
                break
        else:
            p = q = 1
        i += p
        j += q
        edits += p
        if edits > limit:
            return edits
    return edits + max(m - i, n - j)


def _whole(places: dict[str, list[int]], width: int, columns: list[str]) -> int:
    """The distance from whole columns."""
    full = (1 << width) - 1
    keep = MASK_BUDGET_BYTES // ((width >> 3) + 1)
    masks: dict[str, int] = {}
    up, down = full, 0
    for token in columns:
        match = masks.get(token, 0)
        if not match and token in places:
            match = _mask(places[token], width)
            if len(masks) < keep:
                masks[token] = match
        # Vertical differences of the next column: up has +1 rows, down has -1 rows.
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        rise = ((down | (full ^ (diagonal | up))) << 1) | 1
        up, down = ((diagonal & up) << 1 & full) | (full ^ ((diagonal | rise) & full)), rise & diagonal
    return len(columns) + up.bit_count() - down.bit_count()


def _banded(places: dict[str, list[int]], width: int, columns: list[str], limit: int) -> int:
    """The distance from the rows within `limit` of the diagonal: exact if at most `limit`, otherwise more than it.

    Columns are taken in blocks; in a block the rows that any of its columns may need form a window. Above the
    window each column is taken to cost one more, and rows that enter below it too: both are the cost of some
    edits, so no value is too low, and the path of a distance within the limit never leaves the window.
    """
    up, down, base, low, high = 0, 0, 0, 0, 0
    step = max(limit, BLOCK)
    for start in range(0, len(columns), step):
        block = columns[start : start + step]
        new_low, new_high = max(0, start - limit), min(width, start + len(block) + limit)
        if new_low > low:
            gone = (1 << min(new_low, high) - low) - 1
            # Rows that the window skips altogether would enter and leave at once; each costs one.
            base += (up & gone).bit_count() - (down & gone).bit_count() + max(0, new_low - high)
            up, down = up >> new_low - low, down >> new_low - low
            low, high = new_low, max(high, new_low)
        if new_high > high:
            up |= ((1 << new_high - high) - 1) << high - low
            high = new_high
        size = high - low
        full = (1 << size) - 1
        masks: dict[str, int] = {}
        for token in block:
            match = masks.get(token)
            if match is None:
                of = places.get(token, ())
                match = _mask([p - low for p in of[bisect_left(of, low) : bisect_left(of, high)]], size) if of else 0
                masks[token] = match
            diagonal = ((((match & up) + up) ^ up) | match | down) & full
            rise = ((down | (full ^ (diagonal | up))) << 1) | 1
            up, down = ((diagonal & up) << 1 & full) | (full ^ ((diagonal | rise) & full)), rise & diagonal
        base += len(block)
    if high < width:
        return limit + 1
    return base + up.bit_count() - down.bit_count()


@F.pandas_udf(T.IntegerType())
def token_line_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance of texts given as tokens joined by single blanks."""
    return pd.Series(
        [
            None if a is None or b is None else token_distance(a.split(), b.split())
            for a, b in zip(left, right)
        ],
        dtype="Int32",
    )


@F.pandas_udf(T.LongType())
def token_line_shared(left: pd.Series, right: pd.Series) -> pd.Series:
    """How many tokens both texts have, repeats counted."""
    return pd.Series(
        [
            None if a is None or b is None else sum((Counter(a.split()) & Counter(b.split())).values())
            for a, b in zip(left, right)
        ],
        dtype="Int64",
    )


@F.pandas_udf(T.StringType())
def token_line_difference(left: pd.Series, right: pd.Series) -> pd.Series:
    """The tokens of the left text that the right one lacks, repeats kept, in order."""
    return pd.Series(
        [
            None if a is None or b is None else " ".join(filterfalse(set(b.split()).__contains__, a.split()))
            for a, b in zip(left, right)
        ],
        dtype="object",
    )


def _measures(swap_when_shorter: bool):
    def measure(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(left, right):
            if a is None or b is None:
                rows.append((None, None, None, None))
                continue
            a, b = a.split(), b.split()
            here, there = (b, a) if swap_when_shorter and len(b) > len(a) else (a, b)
            new = " ".join(filterfalse(set(there).__contains__, here))
            rows.append((token_distance(a, b), len(a), len(b), new))
        out = pd.DataFrame(rows, columns=["distance", "len_a", "len_b", "new_words"], dtype="object")
        return out.astype({name: "Int32" for name in ("distance", "len_a", "len_b")})

    fields = [T.StructField(name, T.IntegerType()) for name in ("distance", "len_a", "len_b")]
    return F.pandas_udf(measure, T.StructType([*fields, T.StructField("new_words", T.StringType())]))


# Distance, both lengths and the tokens that only one side has, in one pass over both texts: the side with
# more tokens (the left on ties), or always the left.
line_measures_longer = _measures(True)
line_measures_left = _measures(False)
