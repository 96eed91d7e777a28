"""Near duplicates by SimHash fingerprints: a byte-position inverted index with count filtering.

Two fingerprints with at most `max_bits` differing bits differ in at most that many of their eight bytes, so at least
`8 - max_bits` bytes agree at the same position. Posting lists of single positional bytes hold a 256th of all
fingerprints each, so their pairs grow with the square of the corpus. The index therefore posts groups of positional bytes:
any choice of `8 - max_bits` agreeing positions has three in the first or three in the second half (two if fewer agree), so a
pair that can reach the guaranteed minimum meets in at least one list. In a list the shared positional bytes of each pair are
tallied, pairs below the minimum are dropped, and the others are verified by their differing bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import free_names, map_batches, saved
from filingscope.llm.components import components

SEED = 42
BYTES = 8

# Fingerprints of a list compared in one task; longer lists are compared block by block.
LIST_BLOCK = 2048


def fingerprint(text: str | None, shingle_words: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every whole text; texts without a word have fp 0."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _posted(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of positions such that any `8 - max_bits` positions contain one of them."""
    sure = BYTES - max_bits
    if sure < 1:
        raise ValueError("with so many differing bits no byte is sure to agree")
    half = BYTES // 2
    width = min(half, -(-sure // 2))
    return [g for start in (0, half) for g in combinations(range(start, start + half), width)]


def _linked(values: np.ndarray, others: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Pairs that tie the fingerprints of a list, or of two blocks of it, into their groups: at most one for each fingerprint.

    Fingerprints are compared one against all; a pair is kept only if it joins two groups. So no list, however many links it
    has, gives more pairs than fingerprints.
    """
    every = values if others is None else np.concatenate([values, others])
    group = np.arange(len(every))
    pairs = []
    targets = np.arange(len(values), len(every)) if others is not None else None
    for i in range(len(values) if others is not None else len(every) - 1):
        to = targets if targets is not None else np.arange(i + 1, len(every))
        to = to[group[to] != group[i]]
        if not len(to):
            continue
        differ = every[to] ^ every[i]
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
        to, differ = to[shared >= BYTES - max_bits], differ[shared >= BYTES - max_bits]
        to = to[np.bitwise_count(differ) <= max_bits]
        for j in to:
            if group[j] != group[i]:
                pairs.append((int(every[i]), int(every[j])))
                group[group == group[j]] = group[i]
    return pairs


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of fingerprints within `max_bits` that connect all groups; `distinct` has one row for each fp."""
    unsigned = F.col("fp")

    def key(number: int, positions: tuple[int, ...]):
        value = F.lit(number).cast("long")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned(unsigned, 8 * p).bitwiseAND(F.lit(255).cast("long")))
        return value

    posted = distinct.select("fp", F.explode(F.array(*(key(n, g) for n, g in enumerate(_posted(max_bits))))).alias("list"))
    posted = saved(posted)
    sizes = posted.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / LIST_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = posted.join(sizes, "list").withColumn("blocks", blocks).withColumn("own", own)
    # Each fingerprint goes to every pair of blocks that its own block is in.
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("u"), F.greatest("own", o).alias("v")))
    dealt = rows.select("list", "fp", "own", F.explode(met).alias("meet")).select("list", "fp", "own", "meet.*")
    lists = dealt.groupBy("list", "u", "v").agg(
        F.collect_list(F.when(F.col("own") == F.col("u"), F.col("fp"))).alias("left"),
        F.collect_list(F.when(F.col("own") != F.col("u"), F.col("fp"))).alias("right"),
    )

    def run(batches):
        for batch in batches:
            a, b = [], []
            columns = [batch.column(i) for i in range(3)]
            flats = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()) for c in columns[:2]]
            (one, at1), (two, at2) = flats
            same = columns[2].to_pylist()
            for i, alone in enumerate(same):
                left, right = one[at1[i] : at1[i + 1]], two[at2[i] : at2[i + 1]]
                for x, y in _linked(left, None if alone else right, max_bits):
                    a.append(x)
                    b.append(y)
            found = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)]
            yield pa.RecordBatch.from_arrays(found, ["a", "b"])

    return map_batches(lists.select("left", "right", (F.col("u") == F.col("v")).alias("alone")), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) for every row.

    Texts without a word, null included, share fingerprint 0. Equal fingerprints always link. A null doc_id counts as larger
    than all others: such a row has the component of its fingerprint, null only if no row in it has an id. Repeated rows give
    repeated rows.
    """
    return _grouped(docs, shingle_words, max_bits).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """doc_id, fp, group (a name of its own for each component) and component_id of every row."""
    rows = saved(fingerprints(docs, shingle_words))
    smallest = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    groups = components(links(smallest.select("fp"), max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    named = smallest.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    of_fp = named.join(least, "group").select("fp", "group", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "group", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of `docs`, one for each component: the one with the smallest doc_id, all columns kept.

    Among repeated rows with that id one stays, for each component if an id is on different texts; rows without id stay only if
    their component has no row with one.
    """
    found = saved(_grouped(docs, shingle_words, max_bits))
    # A component is named by its smallest id, so the kept ids are those that equal their component.
    named = F.col("doc_id") == F.col("component_id")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(named).alias("named"), (F.min("fp") < F.max("fp")).alias("clashes"))
    ids = saved(ids.where("named").select("doc_id", "clashes"))
    (own,) = free_names(docs, "kept_id")
    kept = ids.where("not clashes").select(F.col("doc_id").alias(own))
    with_id = docs.join(kept, F.col("doc_id") == F.col(own), "left_semi")
    nameless = found.where("component_id is null").select("fp").distinct()
    out = with_id.dropDuplicates(["doc_id"]).unionByName(_first_nameless(docs, nameless, shingle_words))
    clashing = ids.where("clashes").select("doc_id")
    if clashing.isEmpty():
        return out
    first = found.where(named).join(clashing, "doc_id", "left_semi").groupBy("doc_id", "group").agg(F.min("fp").alias("fp"))
    return out.unionByName(_first_clashing(docs, first.select("doc_id", "fp"), shingle_words))


def _first_clashing(docs: DataFrame, first: DataFrame, shingle_words: int) -> DataFrame:
    """One row for each doc_id and fp of `first`; ids that are on different texts."""
    of, fp, key, own = free_names(docs, "kept_id", "kept_fp", "text_key", "own_fp")
    wanted = first.select(F.col("doc_id").alias(of), F.col("fp").alias(fp))
    rows = docs.join(wanted.select(of), F.col("doc_id") == F.col(of), "left_semi").withColumn(key, F.xxhash64("text"))
    of_text = fingerprints(rows.select(F.col(key).alias("doc_id"), "text"), shingle_words).distinct()
    rows = rows.join(of_text.select(F.col("doc_id").alias(key), F.col("fp").alias(own)), key)
    rows = rows.join(wanted, (F.col("doc_id") == F.col(of)) & (F.col(own) == F.col(fp)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).select(*docs.columns)


def _first_nameless(docs: DataFrame, nameless: DataFrame, shingle_words: int) -> DataFrame:
    """One row for each fingerprint of components in which no row has an id."""
    (key,) = free_names(docs, "text_key")
    without = docs.where("doc_id is null")
    keyed = without.withColumn(key, F.xxhash64("text"))
    first = fingerprints(without.select(F.xxhash64("text").alias("doc_id"), "text"), shingle_words)
    first = first.join(nameless, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias(key)).select(key)
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
