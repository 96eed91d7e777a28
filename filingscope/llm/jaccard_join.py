"""Groups of texts whose sets of word n-grams have a Jaccard similarity of num / den or more: T-occurrence search by DivideSkip.

A query set and an indexed set can only be similar if they share T n-grams, and T follows from their sizes. The inverted lists of the
query's n-grams are divided: the others are merged by counting, and only a set that occurs in enough of them to reach T with the longest
ones is looked up in these. What reaches the overlap its size asks for is a link.

A task holds the index of a group of sets. The groups come from the sets themselves, without loss:

1. Rows with equal sets are one set with a key. From here on only different sets are compared.
2. Sets are put in levels by size; a set that is similar to one of the next lower level counts there too. For each level a set's n-grams are
   cut by hash into a fixed number of segments, three more than the n-grams in which similar sets of that level can differ; so similar
   sets agree in three segments at least. A segment's hash is its signature. An empty segment is signed only by a set with
   three of them; a set with fewer agrees in another one.
3. Sets with an equal signature are tied: within a batch of texts at once, so that a signature leaves it with one set, and then in order after one
   shuffle of signatures. What is connected is a group, and every link lies within one. The n-grams of the sets in groups are
   taken from the texts again; a bitmap of their keys, BITMAP_BITS at most, spares the other texts the shuffle.
   A group of up to GROUP_SETS sets is one task's index.
4. A larger group is dealt at random into parts, twice, which leaves few classes of sets that are all alike. What is left has to share one
   of its rarest n-grams, as many as similar sets need not share and one more. N-grams are ordered by a sketch of their number in
   the large groups and by hash; any order that is the same for all sets finds every pair, this one leaves out what a template
   makes common. Only n-grams whose sets are in several classes count; of those with the same sets one is kept, and its
   sets meet, in blocks if they are many. So no pair goes unseen.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.llm.common import bitmap, in_bitmap, map_batches, saved, shared, written
from filingscope.llm.components import components

WORDS = 3
NUM, DEN = 90, 100

# Segments that similar sets have in common at least.
COMMON = 3

# The largest set of a level is this many times the smallest.
LEVEL_RATIO = 1.5

# Bits of the bitmap of grouped keys: eight for each key, 32 MB at most.
BITMAP_BITS = 28

# Sets, and n-grams, of one index; larger groups are dealt.
GROUP_SETS = 512
GROUP_GRAMS = 2_000_000

# Cells of the sketch of n-gram numbers: 8 MB.
CELL_BITS = 20

# Weight of a long list's probe in DivideSkip's number of long lists.
PROBE_WEIGHT = 0.01

REMEMBERED_WORDS = 500_000

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ value >> np.uint64(29)
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ value >> np.uint64(32)


class Hasher:
    """Hashes of the lower-cased words of texts, remembering those of words met before."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode().lower().split(), self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for word in words:
                if word not in known:
                    known[word] = xxhash.xxh64_intdigest(word)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """The different hashes of all windows of `width` words, in order; fewer words are one window, none have none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    value = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        value = _mixed((value ^ hashes[i : i + len(value)]) * FACTOR)
    return np.unique(value)


class Levels:
    """Size levels, and the segments of each: a set counts in its own level, and in the lower one if one there can be similar."""

    def __init__(self, num: int, den: int) -> None:
        low, self.lows = 1, []
        while low < 1 << 40:
            self.lows.append(low)
            low = max(int(low * LEVEL_RATIO), low * den // num) + 1
        highs = [n - 1 for n in [*self.lows[1:], low]]
        # Sets that cannot differ have the same key and need no signature.
        self.segments = [(den - num) * high // num + COMMON if (den - num) * high >= num else 0 for high in highs]
        self.reach = [high * den // num for high in highs]  # the size of the largest set that is similar to one of the level

    def signatures(self, grams_: np.ndarray) -> np.ndarray:
        """Different hashes, for a set with at least one n-gram."""
        out = []
        own = int(np.searchsorted(self.lows, len(grams_), "right")) - 1
        for level in (own - 1, own):
            m = self.segments[level] if level >= 0 and len(grams_) <= self.reach[level] else 0
            if not m:
                continue
            segment = (grams_ >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            filled = segment[starts]
            name = filled + np.uint64(level << 40)
            out.append(_mixed(_mixed(np.add.reduceat(_mixed(grams_ * FACTOR), starts)) ^ name * FACTOR))
            if m - len(filled) >= COMMON:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), filled) + np.uint64(level << 40)
                out.append(_mixed(~(empty * FACTOR)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def links(sets: list[np.ndarray], classes: list[int], num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Pairs of similar sets (numbers in `sets`) that tie each class of them together: at most one for each set.

    Sets with the same number in `classes` count as tied before.
    """
    if not sets:
        return []
    # Smaller sets are indexed first, so that partners of a query that are large enough end every list.
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    ends = np.cumsum(np.r_[0, sizes])
    gram = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    # The inverted lists, one after the other. An n-gram's list as its set meets it ends where the set itself stands.
    listed = np.argsort(gram, kind="stable")
    place = np.empty_like(listed)
    place[listed] = np.arange(len(listed))
    starts = np.cumsum(np.r_[0, np.bincount(gram)])[gram]
    lists = np.repeat(np.arange(len(sets)), sizes)[listed]
    tied = np.unique(np.array([classes[i] for i in order]), return_inverse=True)[1]
    probed = np.zeros(len(listed), bool)
    out = []
    for at, number in enumerate(order):
        size, own = int(sizes[at]), slice(ends[at], ends[at + 1])
        least = int(np.searchsorted(sizes[:at], -(-num * size // den)))
        if not (tied[least:at] != tied[at]).any():
            continue
        lengths = place[own] - starts[own]
        found = np.flatnonzero(lengths)
        found = found[lists[place[own][found] - 1] >= least]
        needed = -(-num * (size + int(sizes[least])) // (num + den))
        if not len(found) or len(found) < needed:
            continue
        found = found[np.argsort(-lengths[found], kind="stable")]
        long = max(0, min(needed - 1, int(needed / (PROBE_WEIGHT * log2(int(lengths[found[0]]) + 1) + 1))))
        merged, n = found[long:], lengths[found[long:]]
        hits = lists[np.arange(n.sum()) + np.repeat(starts[own][merged] - np.r_[0, np.cumsum(n)[:-1]], n)]
        counts = np.bincount(hits, minlength=at)
        others = np.flatnonzero(counts[least:at] >= needed - long) + least
        others = others[tied[others] != tied[at]]
        if not len(others):
            continue
        # The long lists are probed by the n-grams of the sets that may reach the overlap.
        probed[gram[own][found[:long]]] = True
        of = np.arange(sizes[others].sum()) + np.repeat(ends[others] - np.r_[0, np.cumsum(sizes[others])[:-1]], sizes[others])
        counts = counts[others] + np.add.reduceat(probed[gram[of]], np.r_[0, np.cumsum(sizes[others])[:-1]], dtype=np.int64)
        probed[gram[own]] = False
        for other in others[counts >= -(-num * (size + sizes[others]) // (num + den))].tolist():
            if tied[other] != tied[at]:
                out.append((order[other], number))
                tied[tied == tied[other]] = tied[at]
    return out


def _key(grams_: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams_.tobytes()) - (1 << 63)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def gram_sets(docs: DataFrame, width: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, key (a 64-bit hash of the set, null if it is empty) and n (its size) of every row, and what ties sets together:
    `signatures`, each with one set of a batch, and `ties`, the keys of sets of the batch with an equal one.

    A set that a task has met before has neither.
    """

    def run(batches):
        hasher, levels, met = Hasher(), Levels(num, den), set()
        for batch in batches:
            sets = [grams(hasher(t), width) for t in batch.column(1).to_pylist()]
            keys = [_key(g) if len(g) else None for g in sets]
            signed = []
            for g, k in zip(sets, keys):
                signed.append(np.zeros(0, np.uint64) if k is None or k in met else levels.signatures(g))
                met.add(k)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in signed])
            values = np.concatenate([np.zeros(0, np.uint64), *signed])
            order = np.argsort(values, kind="stable")
            first = np.r_[True, values[order][1:] != values[order][:-1]] if len(order) else np.zeros(0, bool)
            holder = owner[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else owner
            tied = np.unique(np.stack([owner[order][~first], holder[~first]]), axis=1)
            keep = np.sort(order[first])
            whole = np.array([k or 0 for k in keys], np.int64).view(np.uint64)
            cut = lambda of, v: np.split(v, np.cumsum(np.bincount(of, minlength=len(sets)))[:-1])
            columns = [batch.column(0), pa.array(keys, pa.int64()), pa.array([len(g) for g in sets], pa.int64())]
            columns += [_lists(cut(owner[keep], values[keep])), _lists(cut(tied[0], whole[tied[1]]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "signatures", "ties"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, key long, n long, signatures array<long>, ties array<long>")


def _grams_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """key and grams of the sets whose key is in `wanted`, of some others, and of some more than once."""
    bits = min(BITMAP_BITS, max(10, (8 * wanted.count()).bit_length()))
    sent = shared(docs.sparkSession, bitmap(wanted, "key", bits))

    def run(batches):
        hasher, met = Hasher(), set()
        for batch in batches:
            sets = [g for g in (grams(hasher(t), width) for t in batch.column(0).to_pylist()) if len(g)]
            keys = [_key(g) for g in sets]
            asked = in_bitmap(sent.value, np.array(keys, np.int64)).tolist() if keys else []
            out = {}
            for k, g, a in zip(keys, sets, asked):
                if a and k not in met:
                    met.add(k)
                    out[k] = g
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), _lists(list(out.values()))], ["key", "grams"])

    return map_batches(docs.select("text"), run, "key long, grams array<long>")


def _linked(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links a, b (keys) within each `task` of rows with task, key, class and grams; a set that is there twice counts once."""

    def solve(held):
        keys = [k for k, _, _ in held]
        found = links([g for _, _, g in held], [c for _, c, _ in held], num, den)
        return pa.RecordBatch.from_arrays([pa.array([keys[p[i]] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        held, task = [], None
        for batch in batches:
            offsets = batch.column(3).offsets.to_numpy()
            values = batch.column(3).values.to_numpy(zero_copy_only=False)
            for i, (t, key, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if t != task and held:
                    yield solve(held)
                    held = []
                task = t
                if not held or held[-1][0] != key:
                    held.append((key, own, values[offsets[i] : offsets[i + 1]].copy()))
        if held:
            yield solve(held)

    dealt = rows.select("task", "key", "class", "grams").repartition("task").sortWithinPartitions("task", "key")
    return map_batches(dealt, run, "a long, b long")


def _classes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """`members` (a column key among others) with their class by the edges found so far."""
    return members.join(components(edges).select(F.col("node").alias("key"), F.col("component").alias("class")), "key", "left").withColumn("class", F.coalesce("class", "key"))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many n-grams of the sets fall on each of 2 ** CELL_BITS cells, by hash: never too low for an n-gram."""

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            cells += np.bincount((values & np.uint64(len(cells) - 1)).astype(np.int64), minlength=len(cells))
        met = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(cells[met])], ["cell", "n"])

    table = map_batches(sets.select("grams"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out


def rarest(grams_: np.ndarray, cells: np.ndarray, num: int, den: int) -> np.ndarray:
    """So many n-grams, rarest first, that similar sets have one of them in common: all but those they must share at least, and one."""
    n = len(grams_)
    order = np.lexsort((grams_, cells[(grams_ & np.uint64(len(cells) - 1)).astype(np.int64)]))
    return grams_[order[: n + num * -n // den + 1]]


def _rare(sets: DataFrame, num: int, den: int) -> DataFrame:
    """key and signature: each of the set's rarest n-grams among the sets."""
    sent = shared(sets.sparkSession, _frequencies(sets))

    def run(batches):
        for batch in batches:
            offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)
            own = [rarest(values[a:b], sent.value, num, den) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(own)], ["key", "rare"])

    return map_batches(sets.select("key", "grams"), run, "key long, rare array<long>").select("key", F.explode("rare").alias("signature"))


def _large_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """All links needed within groups that no task can hold. `sets` has key, group, parts and grams."""
    members = sets.select("key", "group", "parts")
    found, classed = None, members.withColumn("class", F.col("key"))
    for turn in range(2):
        part = F.pmod(F.xxhash64("key", F.lit(turn)), F.col("parts"))
        dealt = classed.select("key", "class", F.xxhash64("group", part).alias("task"))
        more = written(_linked(sets.select("key", "grams").join(dealt, "key"), num, den))
        found = more if found is None else saved(found.unionByName(more))
        classed = written(_classes(members, found))
    # What may still be linked shares one of its rarest n-grams and is in another class.
    left = written(_rare(sets, num, den).join(classed.select("key", "class"), "key"))
    seen = left.groupBy("signature").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
    )
    seen = seen.where("low < high").groupBy("n", "x", "y").agg(F.min("signature").alias("signature"))
    seen = written(seen.select("signature", F.ceil(F.col("n") / (GROUP_SETS // 2)).cast("int").alias("blocks")))
    if seen.limit(1).count() == 0:
        return found
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = left.join(seen, "signature").withColumn("own", own)
    # Each set goes to every pair of blocks that its own block is in.
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own"))
    met = F.transform(others, lambda o: F.xxhash64("signature", F.least("own", o), F.greatest("own", o)))
    met = F.when(F.col("blocks") == 1, F.array(F.xxhash64("signature"))).otherwise(met)
    tasks = rows.select("key", "class", F.explode(met).alias("task"))
    return found.unionByName(written(_linked(sets.select("key", "grams").join(tasks, "key"), num, den)))


def similar_groups(docs: DataFrame, width: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_grams and component_id (smallest doc_id reachable over links) of every row.

    Words are lower-cased in A to Z and are what space and the control characters 9 to 13 part. A text with fewer than `width` words has
    one n-gram, all of them; a null text or one without a word has none and is linked with nothing, so its component is its own id.
    Equal sets always link. A null doc_id counts as larger than all others: such a row has the component of its group,
    null only if no row in it has an id. Repeated rows give repeated rows. A text is handled whole; other columns are not read.
    """
    rows = saved(gram_sets(docs, width, num, den))
    keyed = written(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")))
    signed = rows.select("key", F.explode("signatures").alias("signature"))
    before = F.lag("key").over(Window.partitionBy("signature").orderBy("key"))
    edges = signed.select("key", before.alias("other")).where("key <> other")
    edges = edges.unionByName(rows.select("key", F.explode("ties").alias("other"))).select(F.col("key").alias("a"), F.col("other").alias("b"))
    groups = components(written(edges.distinct())).select(F.col("node").alias("key"), F.col("component").alias("group"))
    grouped = keyed.select("key", "n").join(groups, "key")
    sizes = grouped.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_GRAMS)).alias("parts"))
    sized = saved(grouped.join(sizes, "group").select("key", "group", "parts"))
    # Both sides grow with the input, so the join is a shuffle at every size.
    sets = written(_grams_of(docs, sized, width).join(sized.hint("merge"), "key"))
    found = written(_linked(sets.where("parts = 1").select("key", F.col("key").alias("class"), F.col("group").alias("task"), "grams"), num, den))
    if sized.where("parts > 1").limit(1).count():
        large = saved(sets.where("parts > 1").dropDuplicates(["key"]))
        found = found.unionByName(_large_links(large, num, den))
    tied = _classes(keyed.select("key", "doc_id"), saved(found))
    least = tied.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    of_key = tied.join(least, "class").select("key", "component_id")
    some = rows.where("n > 0").select("doc_id", "n", "key").join(of_key, "key").select("doc_id", F.col("n").alias("n_grams"), "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_grams"), F.col("doc_id").alias("component_id")))
