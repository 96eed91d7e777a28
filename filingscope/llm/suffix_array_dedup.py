"""Exact removal of byte strings that occur more than once, by suffix order with threshold-bounded interval expansion.

A string of `length` bytes is repeated if it also starts elsewhere in the corpus. One suffix order of a whole corpus fits no
machine, so the corpus is cut into small pieces that never part two equal strings:

1. Every window of `length` bytes is named by the smallest hash among its 32-byte grams (leftmost among equals). Equal windows have
   the same gram at the same offset. Windows next to each other mostly share it, so a text becomes a few dozen runs of windows.
2. Only grams that name runs in two places can hold repeats. Their runs, with the bytes their windows cover, are gathered by gram.
   Equal runs are counted before they are gathered: two equal runs are repeated as a whole.
3. Different runs of one gram are put into one suffix order. Breadth-first backward extension over its Burrows-Wheeler transform
   gives common prefixes in increasing order and stops at `length`; windows that it has not parted by then are equal.
4. A gram with very many different runs is divided by offset and by the bytes that all windows of an offset range share, until each
   part is small. Nothing is left out: in the last round a range has one offset, and the shared bytes are the window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import free_names, map_batches, written
from filingscope.llm.suffix_index import shared_starts

LENGTH = 400
GRAM = 32

# Different runs of one gram that share a suffix order; more are divided first.
GROUP_RUNS = 512

# Bytes put into one suffix order, a group at least.
ORDER_BYTES = 250_000

# Parts of an offset range in one round of division.
DIVISION = 4

FACTOR = 0x9E3779B97F4A7C15
NO_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each place."""
    value, width, power = data.astype(np.uint64), 1, FACTOR
    while width < GRAM:
        value = value[:-width] * np.uint64(power) + value[width:]
        width, power = 2 * width, power * power % (1 << 64)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, first start, last start and gram place of each run of windows named by the same gram."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    span = length - GRAM + 1
    key = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(key) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max)
    grid[: len(key)] = key
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    place = (np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], count] - 1
    return hashes[place[first]].view(np.int64), first, last, place[first]


def _run_table(rows: DataFrame, length: int) -> DataFrame:
    """Each row's runs without their bytes."""

    def run(batches):
        for batch in batches:
            names, firsts, lasts, places, ends = [], [], [], [], [0]
            for text in batch.column(2).to_pylist():
                name, first, last, place = runs(text.encode(), length)
                names.append(name)
                firsts.append(first)
                lasts.append(last)
                places.append(place)
                ends.append(ends[-1] + len(name))
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (names, firsts, lasts, places)], ["h", "s0", "s1", "p"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), lists], ["d", "k1", "k2", "runs"])

    return map_batches(rows.select("d", "k1", "text", "k2"), run, "d long, k1 long, k2 long, runs array<struct<h: long, s0: long, s1: long, p: long>>")


def _covered(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs with the bytes their windows cover."""

    def run(batches):
        for batch in batches:
            out = []
            for d, k1, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                out += [(d, k1, r["s0"], r["h"], r["p"] - r["s0"], data[r["s0"] : r["s1"] + length]) for r in own]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["d", "k1", "s0", "h", "off", "data"])

    joined = rows.select("d", "k1", "text").join(wanted, ["d", "k1"])
    found = map_batches(joined.select("d", "k1", "text", "own"), run, "d long, k1 long, s0 long, h long, off long, data binary")
    return found.withColumns({"c1": F.xxhash64("data"), "c2": F.xxhash64("data", F.lit(1))})


def _divided(runs_left: DataFrame, length: int) -> DataFrame:
    """Each run cut by ranges of offset, named by range and by the bytes that all windows of the range share."""

    def run(batches):
        for batch in batches:
            out = []
            for h, c1, c2, at, g, lo, hi, off, data in zip(*(batch.column(i).to_pylist() for i in range(9))):
                width, windows = -(-(hi - lo) // DIVISION), len(data) - length + 1
                for x in range(lo, hi, width):
                    y = min(x + width, hi)
                    a, b = max(0, off - (y - 1)), min(windows - 1, off - x)
                    if a > b:
                        continue
                    core = data[off - x : off + length - y + 1]
                    name = xxhash.xxh64_intdigest(core, seed=xxhash.xxh64_intdigest(f"{g},{x},{y}"))
                    out.append((h, c1, c2, at + a, name - (1 << 63), x, y, off - a, data[a : b + length]))
            kinds = [pa.int64()] * 8 + [pa.binary()]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, PART)

    return map_batches(runs_left.select(*PART), run, ", ".join(f"{name} long" for name in PART[:-1]) + ", data binary")


PART = ["h", "c1", "c2", "at", "g", "lo", "hi", "off", "data"]


def _repeats_in_groups(parts: DataFrame, length: int) -> DataFrame:
    """h, c1, c2, a, b: ranges of repeated windows within the runs, found in suffix orders of whole groups."""

    def solve(rows):
        out = []
        for (h, c1, c2, at, _, _), flags in zip(rows, shared_starts([row[5] for row in rows], length)):
            edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
            out += [(h, c1, c2, at + int(a), at + int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], pa.int64()) for i in range(5)], ["h", "c1", "c2", "a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size > ORDER_BYTES and row[4] != held[-1][4]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    grouped = parts.select("h", "c1", "c2", "at", "g", "data").repartition("g").sortWithinPartitions("g")
    return map_batches(grouped, run, "h long, c1 long, c2 long, a long, b long")


def _repeated_windows(covered: DataFrame, length: int) -> DataFrame:
    """h, c1, c2, a, b: ranges of repeated windows of every different run, counted from the run's first window."""
    last = F.length("data") - length
    different = written(covered.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.first("data").alias("data"), F.first("off").alias("off")))
    ranges = [different.where("n > 1").select("h", "c1", "c2", F.lit(0).cast("long").alias("a"), last.cast("long").alias("b"))]
    zero = F.lit(0).cast("long")
    left = different.select("h", "c1", "c2", zero.alias("at"), F.col("h").alias("g"), zero.alias("lo"), F.lit(length - GRAM + 1).cast("long").alias("hi"), "off", "data")
    small = []
    while True:
        sizes = written(left.groupBy("g").agg(F.count("*").alias("runs")).where("runs > 1"))
        sized = written(left.join(sizes, "g"))
        small.append(sized.where(F.col("runs") <= GROUP_RUNS).select(*PART))
        large = sized.where(F.col("runs") > GROUP_RUNS)
        if large.limit(1).count() == 0:
            break
        cut = written(_divided(large, length).withColumns({"p1": F.xxhash64("data"), "p2": F.xxhash64("data", F.lit(1))}))
        equal = written(cut.groupBy("g", "p1", "p2").agg(F.count("*").alias("n"), F.min(F.struct("h", "c1", "c2", "at")).alias("one")))
        twice = cut.join(equal.where("n > 1").select("g", "p1", "p2"), ["g", "p1", "p2"], "left_semi")
        ranges.append(twice.select("h", "c1", "c2", F.col("at").alias("a"), (F.col("at") + last).cast("long").alias("b")))
        one = equal.select("g", "p1", "p2", "one.*")
        left = cut.join(one, ["g", "p1", "p2", "h", "c1", "c2", "at"], "left_semi").select(*PART)
    parts = small[0]
    for more in small[1:]:
        parts = parts.unionByName(more)
    ranges.append(_repeats_in_groups(parts, length))
    out = ranges[0]
    for more in ranges[1:]:
        out = out.unionByName(more)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(text, F.lit(1)).alias("k2"),
        text.alias("text"),
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """d (doc_id, or the smallest long for null), k1 (hash of the text), spans: the byte ranges to remove, for rows that have any.

    Spans are maximal, ordered and half open. Rows of equal text have equal spans: each text that several rows have is
    repeated as a whole if it has `length` bytes.
    """
    rows = _keyed(docs)
    found = written(_run_table(rows, length))
    long_enough = found.where(F.size("runs") > 0).withColumn("bytes", F.get("runs", F.size("runs") - 1)["s1"] + length)
    texts = written(long_enough.groupBy("k1", "k2").agg(F.min("d").alias("d"), F.count("*").alias("copies"), F.max("bytes").alias("bytes")))
    # Of each text one row stands for all; a text that several rows have is repeated as a whole.
    standing = found.where(F.size("runs") > 0).join(texts.select("d", "k1", "k2"), ["d", "k1", "k2"], "left_semi").dropDuplicates(["d", "k1", "k2"])
    each = standing.select("d", "k1", F.explode("runs").alias("r")).select("d", "k1", "r.*")
    each = written(each)
    # Written, so that the join shuffles both sides itself and Spark can divide a gram with very many places.
    twice = written(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    wanted = each.join(twice, "h", "left_semi").groupBy("d", "k1").agg(F.collect_list(F.struct("h", "s0", "s1", "p")).alias("own"))
    covered = written(_covered(rows, wanted, length))
    ranges = _repeated_windows(covered.select("h", "c1", "c2", "off", "data"), length)
    places = covered.select("d", "k1", "h", "c1", "c2", "s0").join(ranges, ["h", "c1", "c2"])
    spans = places.select("d", "k1", (F.col("s0") + F.col("a")).alias("start"), (F.col("s0") + F.col("b") + length).alias("end"))
    whole = texts.where("copies > 1").select("d", "k1", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("end"))
    listed = spans.unionByName(whole).groupBy("d", "k1").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    merged = listed.join(texts.select("d", "k1", "k2"), ["d", "k1"]).select("k1", "k2", _merged("spans").alias("spans"))
    every_row = found.where(F.size("runs") > 0).select("d", "k1", "k2").distinct()
    return every_row.join(merged, ["k1", "k2"]).select("d", "k1", "spans")


def _merged(spans: str):
    """Overlapping and touching spans joined, in order."""
    return F.aggregate(
        F.sort_array(spans),
        F.struct(F.array().cast("array<struct<start: bigint, end: bigint>>").alias("out"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")),
        lambda s, x: F.when(x["start"] <= s["end"], F.struct(s["out"].alias("out"), s["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end"))).otherwise(
            F.struct(
                F.when(s["end"] < 0, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).alias("out"),
                x["start"].alias("start"),
                x["end"].alias("end"),
            )
        ),
        lambda s: F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))),
    )


NAMES = ("spans", "kept", "n_bytes")


def cut(docs: DataFrame, spans: DataFrame, least_words: int = 0, names: Sequence[str] = NAMES) -> DataFrame:
    """All columns of `docs`, and under `names` the spans (empty if none), the remaining bytes and the number of bytes there were.

    Spans with fewer than `least_words` words, words cut at an end included, stay in the text. Columns of `docs` with one of the names are
    replaced. A null text counts as empty.
    """
    taken, kept, n_bytes = names
    d, k1, own_spans = free_names(docs, "d", "k1", "own_spans")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))]
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = spans.select(F.col("d").alias(d), F.col("k1").alias(k1), F.col("spans").alias(own_spans))
    marked = docs.drop(*names).withColumns({d: key[0], k1: key[1]}).join(found, [d, k1], "left").drop(d, k1)
    listed = F.coalesce(F.col(own_spans), F.array().cast("array<struct<start: bigint, end: bigint>>"))
    if least_words:
        listed = F.filter(listed, lambda s: _words_in(data, s) >= least_words)
    marked = marked.withColumns({taken: listed, n_bytes: F.length(data).cast("long")}).drop(own_spans)
    return marked.withColumn(kept, F.when(F.size(taken) == 0, data).otherwise(_pieces(data, F.col(taken), F.col(n_bytes))))


def _words_in(data: Column, span: Column) -> Column:
    inside = F.substring(data, span["start"].cast("int") + 1, (span["end"] - span["start"]).cast("int"))
    return F.size(F.filter(F.split(F.make_valid_utf8(inside.cast("string")), "[\\x20\\x09-\\x0D]+"), lambda word: word != ""))


def _pieces(data: Column, spans: Column, n_bytes: Column) -> Column:
    """The bytes between the spans, joined."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(n_bytes))
    between = F.transform(F.arrays_zip(starts.alias("x"), ends.alias("y")), lambda z: F.hex(F.substring(data, z["x"].cast("int") + 1, (z["y"] - z["x"]).cast("int"))))
    return F.unhex(F.array_join(between, ""))


def remove_repeats(docs: DataFrame, length: int = LENGTH, least_words: int = 0, names: Sequence[str] = NAMES) -> DataFrame:
    """All columns of `docs`, and what `cut` adds, with every repeated byte string of `length` removed."""
    return cut(docs, repeated_spans(docs, length), least_words, names)


def readable(kept: Column) -> Column:
    """Remaining bytes as text; bytes of a character that was cut through go, and so do replacement characters."""
    return F.translate(F.make_valid_utf8(kept.cast("string")), "\ufffd", "")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left) of every row; null and empty texts have zeros
    and the hash of no bytes.

    Repeated rows are occurrences of their own, so each removes the other if it has `length` bytes. A very long text is cut into runs like any
    other, but its own bytes are held by one task.
    """
    return remove_repeats(docs, length).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        readable(F.col("kept")).alias("text"),
    )
