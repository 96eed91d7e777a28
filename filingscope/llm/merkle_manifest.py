"""A Merkle manifest of a table, with a proof for every row: nested-struct rollup by rank digits.

Rows are leaves of one tree for each group, in order; the groups' roots are the leaves of a last tree. A node has up to FAN children.

1. Ranks without a window over a group: leaf digests are range partitioned and sorted once; a row's rank is its place in its
   part, plus the rows of its group in earlier parts, counted by group and part.
2. The last DIGITS digits of the rank, base FAN, become columns, the other digits number a block. Blocks are shuffled together once;
   each digit column is grouped away in turn, lowest first, and the rows it told apart become an array of child structs in their parent.
   The keys of the shuffle stay among the keys, so no further shuffle is needed. A block has at most FAN ** DIGITS leaves.
3. Blocks are the leaves of the next tier, rolled up the same way until a group has one block: their number falls by FAN ** DIGITS
   each time. What lies above a block is handed down to block rows, never to leaf rows.
4. A transform of each child array writes down the siblings left and right of each child, an explode goes one level down; so a
   block emits its proofs without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.llm.common import saved

FAN = 3
DIGITS = 6  # of the rank inside a block: 729 leaves, less than 1 MB nested

STEP = "array<struct<left: string, right: string>>"


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of the values, each as its UTF-8 byte count, a colon and itself, or a hyphen if null."""

    def sized(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(sized, values)))


def _ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """`leaves` (with a group key `g`, never null) and, by group, each row's `rank` from 0 and the group's rows, `total`.

    Rows that agree in all of `order` are told apart by where they were read, so that many equal rows still part.
    """
    by = ["g", *order, "__read"]
    dealt = leaves.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__read")
    placed = saved(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    parts = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "g", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total")
    )
    return placed.join(offsets, ["g", "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def _levels(total: Column) -> Column:
    """The levels above `total` nodes: the least k with FAN ** k >= total."""
    out, power = F.lit(0), 1
    while power < 1 << 62:
        out, power = out + (total > power).cast("int"), power * FAN
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """g, block, total, levels and node (hash and kids, nested DIGITS deep) of every block; nodes have g, rank, total and node."""
    digits = {f"d{k}": F.expr(f"rank div {FAN**k}L % {FAN}") for k in range(DIGITS)}
    rows = nodes.withColumns(digits | {"block": F.expr(f"rank div {FAN**DIGITS}L")}).withColumn("levels", _levels(F.col("total")))
    rows = rows.select("g", "total", "levels", "block", *digits, "node").repartition("g", "block")
    for k in range(DIGITS):
        keys = ["g", "block", "total", "levels", *(f"d{j}" for j in range(k + 1, DIGITS))]
        nested = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(f"d{k}", "node"))).alias("kids"))
        nested = nested.withColumn("kids", F.transform("kids", lambda kid: kid["node"]))
        joined = digest(F.array_join(F.transform("kids", lambda kid: kid["hash"]), ""))
        # Above a group's last level there is one node, handed up as it is.
        own = F.when(F.col("levels") > k, joined).otherwise(F.col("kids")[0]["hash"])
        rows = nested.select(*keys, F.struct(own.alias("hash"), "kids").alias("node"))
    return rows


def _below(level: int):
    """What a transform makes of each child: the child, and its path with the siblings of this level in front."""

    def step(kid: Column, i: Column) -> Column:
        hashes = F.transform(F.col("node")["kids"], lambda other: other["hash"])
        left, right = F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.lit(FAN))
        here = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
        path = F.when(F.col("levels") > level, F.concat(here, F.col("path"))).otherwise(F.col("path"))
        return F.struct(kid.alias("node"), path.alias("path"))

    return step


def _emitted(blocks: DataFrame, *keep: str) -> DataFrame:
    """`keep`, leaf (the leaf's struct) and path (siblings of each level, lowest first) of every leaf of the blocks."""
    rows = blocks.select(*keep, "levels", "node", F.col("up").alias("path"))
    for k in reversed(range(DIGITS)):
        kids = F.transform(F.col("node")["kids"], _below(k))
        rows = rows.select(*keep, "levels", F.explode(kids).alias("x")).select(*keep, "levels", "x.*")
    return rows.select(*keep, F.col("node").alias("leaf"), "path")


def _rolled(nodes: DataFrame) -> DataFrame:
    """The blocks of `nodes`, with `up` (the siblings above the block, lowest first) and `top` (the group's root) of each."""
    blocks = saved(_blocks(nodes))
    nothing = F.array().cast(STEP)
    above = F.expr(f"(total - 1) div {FAN**DIGITS}L + 1")
    if blocks.where("block > 0").limit(1).count() == 0:
        return blocks.withColumns({"up": nothing, "top": F.col("node")["hash"]})
    heads = blocks.select("g", F.col("block").alias("rank"), above.alias("total"), F.struct(F.col("node")["hash"].alias("hash"), "block").alias("node"))
    paths = _emitted(_rolled(heads), "g", "top").select("g", F.col("leaf")["block"].alias("block"), F.col("path").alias("up"), "top")
    return blocks.join(paths, ["g", "block"])


def manifest(
    docs: DataFrame, fields: Sequence[str], group: str, order: str, presented: Mapping[str, Column] | None = None
) -> DataFrame:
    """`order` column, leaf, subroot, root, path, folded_root and verified of every row of `docs`.

    A leaf is the hash of `fields`. Leaves of a group ascend by `order` (null first; repeated values by their leaf hash); groups
    ascend by their UTF-8 bytes, null first. `path` are the siblings to the left and right on each level up to the root, each side's
    hashes joined. `presented` gives fields as they are to be verified (columns over `docs`); `folded_root` is recomputed from them, or from
    the leaf, and the path. A table of one row has no level: its leaf is the root and the path is empty. An empty table gives no
    rows. Equal rows are leaves of their own; texts of any length are one hash. Other columns are not read.
    """
    now = [presented[f] if presented and f in presented else F.col(f) for f in fields]
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    # Digests are written before they are sorted: range bounds are sampled, which would hash all texts twice.
    leaves = saved(docs.select(g.alias("g"), F.col(order).alias("order"), leaf_hash([F.col(f) for f in fields]).alias("hash"), leaf_hash(now).alias("shown")))
    ranked = _ranked(leaves, ["order", "hash"])
    blocks = saved(_rolled(ranked.select("g", "rank", "total", F.struct("hash", "order", "shown").alias("node"))))
    subroots = blocks.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("top").alias("hash"))
    trees = _rolled(_ranked(saved(subroots), ["of"]).select("g", "rank", "total", F.struct("hash", "of").alias("node")))
    roots = _emitted(trees, "top").select(F.col("leaf")["of"].alias("g"), F.col("path").alias("last"), F.col("top").alias("root"))
    whole = blocks.join(roots, "g").withColumn("up", F.concat("up", "last"))
    out = _emitted(whole, "top", "root")
    folded = F.aggregate("path", F.col("leaf")["shown"], lambda own, s: digest(F.concat(s["left"], own, s["right"])))
    out = out.select(F.col("leaf")["order"].alias(order), F.col("leaf")["hash"].alias("leaf"), F.col("top").alias("subroot"), "root", "path", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_hash(path: str = "path") -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
