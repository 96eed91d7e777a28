"""A forest of regression trees whose bags are known, so that every row can be scored by the trees that have not seen it.

A row's weight in a tree is Poisson(1), drawn from the hash of its key and the tree: the same ones however the data is partitioned, and
known again at scoring. All trees grow together, a pass over the rows for each level: every task counts its rows by tree, node, feature and
bin, the counts are summed in a shuffle, and a window over the bins of a feature gives each cut's gain. Labels are whole millionths, so that
sums are exact and the fit does not depend on the order of rows. What reaches the driver is the cut of each node,
at most trees * 2 ** depth rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingscope.functions.ordered import dealt, stored
from filingscope.operators.panel import complete_cases
from filingscope.operators.quantiles import exact_quantiles
from filingscope.plans import models

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
UNITS = 1_000_000  # of a label
BATCH_ROWS = 2048
# Trees that are counted together: what they need stays in a core's cache.
BLOCK_TREES = 32
# Rows that one task draws bags for.
TASK_ROWS = 200_000

# The chance of at most k copies of a row in a bag.
AT_MOST = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(9)]


def digests(key: Column, trees: int, seed: int = models.SEED) -> Column:
    """32 hexadecimal digits for every four trees: digests of key, block of trees and seed."""
    return F.concat(*[F.md5(F.concat_ws("|", key.cast("string"), F.lit(f"{i}|{seed}"))) for i in range(-(-trees // 4))])


def _bags(column: pa.Array, trees: int) -> np.ndarray:
    """How often each row is in the bag of each tree (trees, rows): 32 bits of its digests decide for one tree."""
    drawn = bytes.fromhex("".join(column.to_pylist()))
    u = np.frombuffer(drawn, ">u4").reshape(len(column), -(-trees // 4) * 4)[:, :trees].T.astype(np.uint32, order="C")
    out = np.zeros(u.shape, np.uint8)
    for p in AT_MOST:
        out += u >= ceil(p * 2**32)
    return out


def _bins(batch: pa.RecordBatch, features: list[str], edges: list[list[float]]) -> np.ndarray:
    """The number of edges below each value (features, rows); a cut after bin b sends values up to edge b to the left."""
    values = (batch.column(name).to_numpy(zero_copy_only=False) for name in features)
    return np.array([np.searchsorted(e, x) for e, x in zip(edges, values)], np.uint8).reshape(len(features), -1)


def nodes(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row in each tree (trees, rows), `depth` levels down at most; `bins` is (features, rows)."""
    trees, size = feature.shape
    root, leaf = np.arange(trees)[:, None] * size, feature < 0
    # Cells of a flat table, and the flat place of the left child: a leaf is its own left child and sends no row to the right.
    left = (root + np.where(leaf, np.arange(size), 2 * np.arange(size) + 1)).ravel()
    own, most = (np.maximum(feature, 0) * bins.shape[1]).ravel(), np.where(leaf, BINS, cut).astype(np.uint8).ravel()
    flat, row, values = np.broadcast_to(root, (trees, bins.shape[1])), np.arange(bins.shape[1]), bins.ravel()
    for _ in range(depth):
        right = values.take(own.take(flat) + row) > most.take(flat)
        flat = left.take(flat)
        flat += right
    return flat - root


@dataclass
class BaggedForest:
    """Nodes are numbered from the root, 0; the children of n are 2 n + 1 and 2 n + 2. `feature` is -1 at a leaf."""

    features: list[str]
    label: str
    edges: list[list[float]]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    seed: int

    @property
    def trees(self) -> int:
        return len(self.feature)

    def score(self, rows: DataFrame, key: Column) -> DataFrame:
        """Complete rows with y_pred, and for training rows oob_trees and oob_pred, from the trees whose bag lacks the row."""
        # Workers get arrays only, so they need no copy of this package.
        feature, cut, value, depth, columns = self.feature, self.cut, self.value, self.depth, rows.columns
        edges, inputs = self.edges, [f"_f{i}" for i in range(len(self.features))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = np.arange(len(feature))[:, None]
            for batch in _slices(batches):
                values = value[tree, nodes(feature, cut, _bins(batch, inputs, edges), depth)]
                drawn = batch.column("_digests")
                unseen = np.zeros(values.shape, bool)
                unseen[:, drawn.is_valid().to_numpy(zero_copy_only=False)] = _bags(drawn.drop_null(), len(feature)) == 0
                n = unseen.sum(0)
                mean = np.divide((values * unseen).sum(0), n, out=np.full(len(n), np.nan), where=n > 0)
                added = [pa.array(values.mean(0)), pa.array(n.astype(np.int64)), pa.array(mean, mask=n == 0)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, "y_pred", "oob_trees", "oob_pred"])

        ready = dealt(complete_cases(rows, [*self.features, self.label]), TASK_ROWS)
        # Rows flagged as test rows have no bag.
        drawn = F.when(~F.coalesce("is_test", F.lit(False)), digests(key, self.trees, self.seed)).alias("_digests")
        ready = ready.select("*", drawn, *[F.col(name).cast("double").alias(f) for name, f in zip(self.features, inputs)])
        schema = ready.select(*columns, F.lit(0.0).alias("y_pred"), F.lit(0).cast("long").alias("oob_trees"), F.lit(0.0).alias("oob_pred")).schema
        for name in ("y_pred", "oob_pred"):
            schema[name].nullable = True
        return ready.mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BATCH_ROWS rows at most: a row takes some kilobytes for all trees."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def _pack(matrix: np.ndarray) -> pa.Array:
    """A column of small numbers (values, rows) as one binary value a row."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix.T)], pa.binary())


def _unpack(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).T)


def _drawn(rows: DataFrame, inputs: list[str], edges: list[list[float]], trees: int, seed: int) -> DataFrame:
    """_bins, _bag and _y of each row, once for all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bags = _bags(batch.column("_digests"), trees)
            yield pa.RecordBatch.from_arrays([_pack(_bins(batch, inputs, edges)), _pack(bags), batch.column("_y")], ["_bins", "_bag", "_y"])

    drawn = rows.select(digests(F.col("_key"), trees, seed).alias("_digests"), "_y", *inputs)
    return drawn.mapInArrow(run, "_bins binary, _bag binary, _y long")


def _counts(rows: DataFrame, forest: BaggedForest, level: int) -> DataFrame:
    """tree, node, f, b, n (different rows), w (with repeats) and s (their labels) of the nodes of a level."""
    first, width = 2**level - 1, 2**level
    feature, cut, features, trees = forest.feature, forest.cut, len(forest.features), forest.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, features, trees, width, BINS), np.int64)
        for batch in _slices(batches):
            bins, bags, y = _unpack(batch.column(0)), _unpack(batch.column(1)), batch.column(2).to_numpy().astype(np.float64)
            for start in range(0, trees, BLOCK_TREES):
                block = slice(start, start + BLOCK_TREES)
                bag, at = bags[block], nodes(feature[block], cut[block], bins, level)
                tree, row = np.nonzero((bag > 0) & (at >= first))
                weight = bag[tree, row].astype(np.float64)
                cell, labels = (tree * width + at[tree, row] - first) * BINS, weight * y.take(row)
                # Rows and weights are counted in one number: a batch has less than 2 ** 16 rows.
                both, shape = weight * 2**16 + 1, (len(bag), width, BINS)
                for f in range(features):
                    place, size = cell + bins[f].take(row), len(bag) * width * BINS
                    counted = np.bincount(place, both, size).astype(np.int64).reshape(shape)
                    sums[0, f, block] += counted & 2**16 - 1
                    sums[1, f, block] += counted >> 16
                    sums[2, f, block] += np.bincount(place, labels, size).astype(np.int64).reshape(shape)
        f, t, node, b = np.nonzero(sums[0])
        keys = [pa.array(v.astype(np.int32)) for v in (t, node + first, f, b)]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(s[f, t, node, b]) for s in sums)], ["tree", "node", "f", "b", "n", "w", "s"])

    counted = rows.mapInArrow(run, "tree int, node int, f int, b int, n long, w long, s long")
    return counted.groupBy("tree", "node", "f", "b").agg(*[F.sum(c).alias(c) for c in ("n", "w", "s")])


def _cuts(counts: DataFrame, min_leaf: int) -> DataFrame:
    """The best cut of each node that has one, and each node's sums: gain is what it takes from the squared error."""
    own = W.partitionBy("tree", "node", "f")
    upto = own.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    totals = {f"{c}0": F.sum(c).over(own) for c in ("n", "w", "s")}
    left = {f"{c}1": F.sum(c).over(upto) for c in ("n", "w", "s")}
    sides = counts.select("tree", "node", "f", "b", *[v.alias(k) for k, v in (totals | left).items()])
    s0, s1 = F.col("s0").cast("double"), F.col("s1").cast("double")
    s2, w2 = (F.col("s0") - F.col("s1")).cast("double"), F.col("w0") - F.col("w1")
    gain = F.try_divide(s1 * s1, F.col("w1")) + F.try_divide(s2 * s2, w2) - s0 * s0 / F.col("w0")
    fits = (F.col("n1") >= min_leaf) & (F.col("n0") - F.col("n1") >= min_leaf)
    best = F.min(F.when(fits & (gain > 0), F.struct((-gain).alias("loss"), "f", "b", "w1", "s1")))
    return sides.groupBy("tree", "node").agg(F.max("w0").alias("w"), F.max("s0").alias("s"), best.alias("cut"))


def fit_forest(
    rows: DataFrame, key: Column, features: list[str], label: str, trees: int = models.TREES,
    depth: int = models.REGRESSION_DEPTH, min_leaf: int = models.MIN_LEAF, seed: int = models.SEED,
) -> BaggedForest:
    """Fit on the complete rows that are not flagged as test rows. A leaf holds at least `min_leaf` different rows of the bag.

    Cuts are tried at the exact 32-quantiles of each feature; the best one of all features wins, the first one among equals.
    """
    train = complete_cases(rows, [*features, label]).filter(~F.col("is_test"))
    inputs = [f"_f{i}" for i in range(len(features))]
    units = F.round(F.col(label) * UNITS).cast("long").alias("_y")
    plain = train.select(key.cast("string").alias("_key"), units, *[F.col(name).cast("double").alias(f) for name, f in zip(features, inputs)])
    plain = stored(dealt(plain, TASK_ROWS))
    probs = tuple(k / BINS for k in range(1, BINS))
    edges = [sorted(set(exact_quantiles(plain, name, probs).get(0, []))) for name in inputs]
    size = 2 ** (depth + 1) - 1
    forest = BaggedForest(
        features, label, edges, np.full((trees, size), -1, np.int64), np.zeros((trees, size), np.int64), np.full((trees, size), np.nan), depth, seed
    )
    table = stored(_drawn(plain, inputs, edges, trees, seed))
    for level in range(depth):
        found = _cuts(_counts(table, forest, level), min_leaf).collect()
        for r in found:
            t, node, cut = r["tree"], r["node"], r["cut"]
            if level == 0:
                forest.value[t, 0] = r["s"] / r["w"] / UNITS
            if cut is not None:
                forest.feature[t, node], forest.cut[t, node] = cut["f"], cut["b"]
                forest.value[t, 2 * node + 1] = cut["s1"] / cut["w1"] / UNITS
                forest.value[t, 2 * node + 2] = (r["s"] - cut["s1"]) / (r["w"] - cut["w1"]) / UNITS
        if not any(r["cut"] is not None for r in found):
            break
    return forest


def oob_r2(scored: DataFrame, label: str) -> DataFrame:
    """One row: training rows, those that some tree has not seen, and the R2 of what such trees say of them."""
    y, p = F.col(label), F.col("oob_pred")
    seen = scored.filter(~F.col("is_test"))
    sums = seen.agg(
        F.count("*").alias("rows"), F.count(p).alias("oob_rows"),
        F.sum(F.when(p.isNotNull(), (y - p) ** 2)).alias("left"), F.var_pop(F.when(p.isNotNull(), y)).alias("variance"),
    )
    return sums.select("rows", "oob_rows", (1 - F.try_divide(F.col("left"), F.col("variance") * F.col("oob_rows"))).alias("oob_r2"))
