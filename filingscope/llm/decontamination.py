"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other parameters has the same template. Windows of
template words are hash-joined between documents and benchmark items. Windows that follow each other on both sides form a run; along
a run the slot values must map one to one, or the run is cut there. Runs that are long enough mark the document.
Every window is also compared by its exact words in lower case, which finds copies in other letter case.
What a run says is weighed as a whole, not window by window: a word says more than a number in its place, a number more than a name. So
a question dense in numbers is found with others, and a row of capitalised words is none. A window of placeholders alone is only
looked up next to one that matches, as far as the benchmark has such windows in a row.

Documents are first held against a bitmap of fixed size with the benchmark's hashes, whatever the size of the benchmark;
only windows that pass it are joined.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import bitmap, free_names, in_bitmap, map_batches, saved, shared

WINDOW = 8
MIN_RUN = 13  # words that mark a document; shorter items must match as a whole
MIN_WEIGHT = 6.5  # of the words of runs with other slot values that mark it; exact words need none
WEIGHTS = {None: 1.0, "<number>": 0.5, "<number><unit>": 0.5, "<unit>": 0.5, "<name>": 0.2}

BITMAP_BITS = 24  # 2 MB
REMEMBERED_WORDS = 200_000
NO_ID = -(1 << 63)

# Units of measure and number words.
UNITS = frozenset(
    """mm cm dm km meter meters metre metres inch inches foot feet yard yards mile miles mg kg gram grams kilogram kilograms
    ton tons tonne tonnes pound pounds ounce ounces ml liter liters litre litres gallon gallons second seconds minute minutes
    hour hours day days week weeks month months year years mph kmh kph percent dollar dollars euro euros cent cents usd eur gbp
    degree degrees celsius fahrenheit watt watts volt volts joule joules hz khz mhz ghz kb mb gb tb""".split()
)
NUMBER_WORDS = frozenset(
    """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
    twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
)

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER = re.compile(r"\d[\d.,:/-]*(st|nd|rd|th|s)?")
QUANTITY = re.compile(r"\d[\d.,]*([^\W\d_]+|%)")


def slot_kind(word: str) -> str | None:
    """The placeholder of a word without punctuation at its edges, None for a literal."""
    if word[0].isdigit():
        if NUMBER.fullmatch(word):
            return "<number>"
        if QUANTITY.fullmatch(word):
            return "<number><unit>"
    lower = word.lower()
    if lower in NUMBER_WORDS:
        return "<number>"
    if lower in UNITS:
        return "<unit>"
    return "<name>" if word[0].isupper() else None


class Words:
    """What a worker knows of words: their numbers, and by number the template code, exact code, whether literal, the word."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.core: list[str] = []
        self.template: list[int] = []
        self.exact: list[int] = []
        self.literal: list[bool] = []
        self.weight: list[float] = []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > REMEMBERED_WORDS:
            self.__init__()
        for word in set(words).difference(self.number):
            core = EDGES.sub("", word.decode("utf-8", "replace"))
            kind = slot_kind(core) if core else None
            self.number[word] = len(self.core) if core else -1
            if core:
                lower = core.lower()
                self.core.append(lower)
                self.exact.append(xxhash.xxh64_intdigest(lower))
                self.template.append(xxhash.xxh64_intdigest(kind) if kind else self.exact[-1])
                self.literal.append(kind is None)
                self.weight.append(WEIGHTS[kind])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def _window_hash(codes: np.ndarray, size: int) -> np.ndarray:
    value = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for k in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(value)]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ value >> np.uint64(29)


_WORKER = Words()


def _forget() -> None:
    """At the end of a task: the worker lives on, and what it knew of words would stay in its memory."""
    _WORKER.__init__()


def _windows(texts: list[str | None], sizes: list[int], keep=None, reach: int | None = None):
    """(row, position, size, hash, slots, number of words in the text, weight of the text up to the window, up to its end) of the windows.

    `keep` filters by hash. Windows of placeholders alone are kept up to `reach` places from one that has a word and is kept.
    """
    split = [(t or "").encode().split() for t in texts]
    ids = _WORKER.numbers(list(chain.from_iterable(split)))
    row = np.repeat(np.arange(len(texts)), [len(w) for w in split])
    row, ids = row[ids >= 0], ids[ids >= 0]
    count = np.bincount(row, minlength=len(texts))
    begin = np.cumsum(count) - count
    literal = np.array(_WORKER.literal, bool)[ids]
    weight = np.r_[0.0, np.cumsum(np.array(_WORKER.weight, float)[ids])]
    template, exact = (np.array(v, np.uint64)[ids] for v in (_WORKER.template, _WORKER.exact))
    literals = np.r_[0, np.cumsum(literal)]
    for size in sizes:
        n = max(0, len(ids) - size + 1)
        bare = literals[size:][:n] == literals[:n]
        whole = row[:n] == row[size - 1 :][:n]
        for hashes, placed in ((_window_hash(template, size), True), (~_window_hash(exact, size), False)):
            usable = whole & keep(hashes) if keep else whole
            if placed and reach is not None:
                usable &= ~bare | _near(usable & ~bare, usable & bare, reach)
            for at in np.flatnonzero(usable):
                r = int(row[at])
                slots = [_WORKER.core[i] for i, l in zip(ids[at : at + size], literal[at : at + size]) if not l] if placed else []
                yield r, int(at - begin[r]), size, int(hashes[at].view(np.int64)), slots, int(count[r]), *(float(weight[i] - weight[begin[r]]) for i in (at, at + size))


def _near(seen: np.ndarray, asked: np.ndarray, reach: int) -> np.ndarray:
    """Which places that are asked for are at most `reach` from one that is seen, with only asked ones between."""
    at, n = np.arange(len(seen)), len(seen)
    out = np.zeros(n, bool)
    for flip in (slice(None), slice(None, None, -1)):
        s, a = seen[flip], asked[flip]
        last = np.maximum.accumulate(np.where(s, at, -n - reach))
        broken = np.maximum.accumulate(np.where(s | a, -1, at))
        out |= (a & (at - last <= reach) & (broken < last))[flip]
    return out


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, item_pos, size, hash, item_slots, item_words, since and upto (weight of the item before the window and to its end) of every window. Items shorter than a window are one window."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for text_id, text in zip(ids, batch.column(1).to_pylist()):
                n = sum(1 for w in (text or "").encode().split() if EDGES.sub("", w.decode("utf-8", "replace")))
                if n:
                    out += [(text_id, pos, *rest) for _, pos, *rest in _windows([text], [min(n, WINDOW)])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), *[pa.float64()] * 2]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "item_pos", "size", "hash", "item_slots", "item_words", "since", "upto"])

    schema = "item_id long, item_pos long, size long, hash long, item_slots array<string>, item_words long, since double, upto double"
    return map_batches(items.select(F.col("item_id").cast("long"), "text"), run, schema)


def _runs(windows: list[dict]) -> list[tuple[int, int, bool, float]]:
    """Runs of windows that follow each other on one line: first word, end, whether a slot value differs, and the words' weight.

    Along a run the slot values of item and document map one to one. Where that breaks, a new run begins.
    """
    out: list[tuple[int, int, bool, float]] = []
    there, back, previous, since = {}, {}, None, 0.0
    for w in sorted(windows, key=lambda w: (w["item_pos"], len(w["item_slots"]))):  # the exact window first
        if previous is not None and w["item_pos"] == previous:
            continue
        pairs = list(zip(w["item_slots"], w["doc_slots"]))
        if dict(pairs) != {a: b for a, b in reversed(pairs)} or len(set(pairs)) != len({b for _, b in pairs}):
            previous = None  # no one-to-one map within the window
            continue
        follows = previous is not None and w["item_pos"] == previous + 1
        if not follows or any(there.get(a, b) != b or back.get(b, a) != a for a, b in pairs):
            there, back, since = {}, {}, w["since"]
            out.append((w["item_pos"], 0, False, 0.0))
        there.update(pairs)
        back.update((b, a) for a, b in pairs)
        first, _, changed, _ = out[-1]
        out[-1] = (first, w["item_pos"] + w["size"], changed or any(a != b for a, b in pairs), w["upto"] - since)
        previous = w["item_pos"]
    return out


def _judge(windows: list[dict], item_words: int) -> tuple[int, bool] | None:
    """Words of the item that the document holds, and whether a slot value differs; None if they are too few or say too little.

    One run of MIN_RUN words is enough, or the whole of a shorter item. So are runs that together cover half of the item and
    MIN_RUN words, which finds passages with single words changed. A run of exact words needs no weight.
    """
    lines: dict[int, list[dict]] = {}
    for w in windows:
        lines.setdefault(w["line"], []).append(w)
    runs = [run for own in lines.values() for run in _runs(own)]
    told = [r for r in runs if not r[2] or r[3] >= MIN_WEIGHT - 1e-9]
    covered: set[int] = set()
    for first, end, _, _ in runs:
        covered.update(range(first, end))
    longest = max((end - first for first, end, _, _ in told), default=0)
    together = len(covered) >= max(MIN_RUN, item_words / 2) and (told or sum(r[3] for r in runs) >= MIN_WEIGHT)
    if longest >= min(MIN_RUN, item_words) or together:
        return len(covered), any(changed for _, _, changed, _ in runs)
    return None


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, k1 (hash of the text), item_id, n_words (words of the item found), reparameterised, once for each pair.

    Null and empty texts on either side match nothing; a null item_id or doc_id is carried along. Repeated rows give one pair.
    """
    windows = saved(benchmark_windows(items))
    sizes = sorted(row["size"] for row in windows.select("size").distinct().collect())  # at most WINDOW numbers
    cells = shared(docs.sparkSession, bitmap(windows, "hash", BITMAP_BITS))
    reach = windows.where(F.size("item_slots") == F.col("size")).groupBy("item_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    def keep(hashes: np.ndarray) -> np.ndarray:
        return in_bitmap(cells.value, hashes)

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            keys = batch.column(2).to_pylist()
            for r, pos, size, h, slots, *_ in _windows(batch.column(1).to_pylist(), sizes, keep, reach):
                out.append((ids[r], keys[r], pos, size, h, slots))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.string())]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "doc_pos", "size", "hash", "doc_slots"])
        _forget()

    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = map_batches(
        docs.select(F.col("doc_id").cast("long"), "text", key.alias("k1")), run,
        "doc_id long, k1 long, doc_pos long, size long, hash long, doc_slots array<string>",
    )
    joined = found.join(windows, ["size", "hash"])
    line = (F.col("doc_pos") - F.col("item_pos")).alias("line")
    runs = joined.groupBy("doc_id", "k1", "item_id").agg(
        F.max("item_words").alias("item_words"),
        F.collect_set(F.struct(line, "item_pos", "size", "item_slots", "doc_slots", "since", "upto")).alias("windows"),
    )

    def judged(batches):
        for batch in batches:
            out = []
            for doc_id, k1, item_id, words, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (best := _judge(own, words)) is not None:
                    out.append((doc_id, k1, item_id, *best))
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "item_id", "n_words", "reparameterised"])

    marked = map_batches(runs.select("doc_id", "k1", "item_id", "item_words", "windows"), judged, "doc_id long, k1 long, item_id long, n_words long, reparameterised boolean")
    return marked


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that match no item."""
    d, k = free_names(docs, "d", "k1")
    found = contaminated(docs, items).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(d), F.col("k1").alias(k)).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), k: text_hash})
    return own.join(found, [d, k], "left_anti").select(*docs.columns)
