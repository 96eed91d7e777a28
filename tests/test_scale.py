"""Plans and results that must hold whatever the data look like: order, packing, quantiles, bags."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filingscope.functions import dates
from filingscope.functions import edit_distance as ed
from filingscope.functions.ordered import dealt, packed, with_rank
from filingscope.operators import audit
from filingscope.operators import quantiles as qt
from filingscope.operators import similarity as sim
from filingscope.plans import bagging, models
from filingscope.sources import index as ix


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_of_the_whole_table(spark):
    random.seed(1)
    rows = [(i, random.choice([None, "a", "b", "é", ""]), random.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id LONG, s STRING, x DOUBLE").repartition(7)
    got = with_rank(df, [F.desc("s"), F.asc("x")], into="place")
    assert "SinglePartition" not in plan(got)
    frame = [(r.id, r.place) for r in got.collect()]
    expected = sorted(rows, key=lambda r: ((r[1] is None, [-b for b in (r[1] or "").encode()] + [1]), r[2]))
    assert [i for i, _ in sorted(frame, key=lambda r: r[1])] == [r[0] for r in expected]
    assert sorted(p for _, p in frame) == list(range(1, 501))
    assert with_rank(df.filter("id < 0"), [F.asc("id")]).collect() == []


def test_first_of_block_over_many_files(spark):
    """100,000 files of two lines each; a line goes if it repeats the one before, across files as well."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("f"), F.lpad(F.floor(F.col("id") / 2).cast("string"), 6, "0")).alias("source_file"), (F.col("id") % 2).alias("line_no"),
        F.when(F.floor(F.col("id") / 3) % 5 == 0, None).otherwise(F.floor(F.col("id") / 3)).cast("string").alias("cik"),
    )
    kept = ix.first_of_each_block(rows)
    assert "SinglePartition" not in plan(kept)
    assert kept.count() == -(-200_000 // 3)


def test_pairs_are_packed_by_cost(spark):
    """A few dear pairs among many cheap ones: no partition costs more than the mean and its dearest row."""
    random.seed(2)
    costs = [random.choice([1, 1, 1, 50, 4000]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(costs)), "id LONG, cost LONG")
    numbered, parts = packed(df, ["id"], F.col("cost"), 40, 1e12)
    assert parts == 40
    placed = numbered.repartitionById(parts, "part").withColumn("at", F.spark_partition_id())
    sums = [r["s"] for r in placed.groupBy("at").agg(F.sum("cost").alias("s")).collect()]
    assert max(sums) <= 2 * sum(costs) / parts and sum(sums) == sum(costs)
    assert packed(df, ["id"], F.col("cost"), 4, sum(costs) / 9.5)[1] == 10
    assert packed(df.filter("id < 0"), ["id"], F.col("cost"), 4, 1e12)[0].collect() == []


def test_pair_texts_spread_a_firm_of_long_texts(spark):
    words = [("a", f"{i:03}", " ".join("xy"[(i + j) % 2] * (j % 3 + 1) for j in range(400 if i < 12 else 3))) for i in range(200)]
    pairs = [("a", f"{i:03}", None, f"{i + 1:03}", None) for i in range(199)]
    sections = spark.createDataFrame(words, "cik STRING, accession STRING, text STRING")
    texts = sim.pair_texts(sections, spark.createDataFrame(pairs, "cik STRING, filing_a STRING, date_a DATE, filing_b STRING, date_b DATE"))
    cost = sim.token_count(F.col("words_a")) * sim.token_count(F.col("words_b"))
    sums = [r["s"] for r in texts.groupBy(F.spark_partition_id()).agg(F.sum(cost).alias("s")).collect()]
    assert texts.count() == 199 and max(sums) <= 2 * 401 * 401 + 401 * 401


@pytest.mark.parametrize("band, block", [(1, 1), (2, 5), (64, 512)])
def test_banded_distance_equals_the_whole_table(monkeypatch, band, block):
    monkeypatch.setattr(ed, "LEAST_BAND", band)
    monkeypatch.setattr(ed, "BLOCK", block)
    random.seed(band)
    for _ in range(400):
        a = [random.choice("abcdefgh") for _ in range(random.randint(0, 70))]
        b = list(a)
        for _ in range(random.randint(0, 9)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 4)] = [random.choice("abxy") for _ in range(random.randint(0, 4))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert ed.token_distance(a, b) == row[-1]


@pytest.mark.parametrize("limit", [40, 100_000])
def test_quantiles_of_adversarial_values(spark, monkeypatch, limit):
    """Values that mislead a sketch: powers, two heaps, ends without end. Brackets narrow until they are small."""
    monkeypatch.setattr(qt, "BRACKET_ROWS", limit)
    monkeypatch.setattr(qt, "SKETCH_MARKS", 16)
    read = []
    read_off = qt._read_off
    monkeypatch.setattr(qt, "_read_off", lambda values, wanted: read.extend(b.inside for b in wanted.values()) or read_off(values, wanted))
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    columns = [
        [2.0**-i for i in range(900)] + [-(2.0**i) for i in range(900)],
        [1.0] * 900 + [2.0] * 901,
        [float("-inf")] * 300 + [float("inf")] * 300 + [i / 7 for i in range(900)],
    ]
    for values in columns:
        got = qt.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), "v", probs)[0]
        own = sorted(values)
        for p, edge in zip(probs, got):
            at = (len(own) - 1) * p
            low, high = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            assert edge == (low if low == high else low + (high - low) * (at - int(at)))
    assert max(read, default=0) <= limit


def test_dates_by_shape(spark):
    both = {"2020-01-31": "2020-01-31", "2020/01/31": "2020-01-31", "20200131": "2020-01-31", "2020-01-31 23:59:59": "2020-01-31", "2020-01-31T10:00:00Z": "2020-01-31",
            "31 January 2020": "2020-01-31", "JAN 31, 2020": "2020-01-31", "Sept 3, 2020": "2020-09-03", "01/31/2020": "2020-01-31", "31/01/2020": "2020-01-31", "31.1.2020": "2020-01-31",
            "2020-01-31 25:00:00": None, "Foo 31, 2020": None, "30/02/2020": None, "2020-13-01": None, "31/31/2020": None, "12": None, "": None, None: None}
    for first, case in ((True, "2020-05-04"), (False, "2020-04-05")):
        rows = list((both | {"4/5/2020": case, "04-05-2020": case}).items())
        df = spark.createDataFrame(rows, "t STRING, e STRING")
        wrong = df.filter(~dates.parse_date(F.col("t"), first).cast("string").eqNullSafe(F.col("e")))
        assert [tuple(r) for r in wrong.collect()] == []


def test_steps_are_counted_as_they_run(spark):
    rows = spark.range(1000)
    got = audit.step_counts(rows, [("even", lambda d: d.filter("id % 2 = 0")), ("few", lambda d: d.filter("id < 10")), ("none", lambda d: d.filter("id < 0"))])
    assert [tuple(r) for r in got.collect()] == [("read", 1000), ("even", 500), ("few", 5), ("none", 0)]


# --- the forest with known bags, against trees grown one by one


def bag_of(key, tree, seed=42):
    digest = hashlib.md5(f"{key}|{tree // 4}|{seed}".encode()).hexdigest()
    u = int(digest[tree % 4 * 8 : tree % 4 * 8 + 8], 16) / 2**32
    return sum(u >= p for p in bagging.AT_MOST)


def grown(frame, bins, edges, weights, y, depth, min_leaf):
    """Predictions of one tree for all rows of the frame."""
    out = np.zeros(len(bins))

    def split(members, everyone, level):
        w, s = weights[members], weights[members] * y[members]
        out[everyone] = s.sum() / w.sum() / bagging.UNITS
        best = None
        for f in range(bins.shape[1]):
            for b in range(len(edges[f])):
                left = bins[members, f] <= b
                if not (bins[members, f] == b).any() or min(left.sum(), (~left).sum()) < min_leaf:
                    continue
                s1, w1, s2, w2 = float(s[left].sum()), w[left].sum(), float(s[~left].sum()), w[~left].sum()
                gain = s1 * s1 / w1 + s2 * s2 / w2 - float(s.sum()) * float(s.sum()) / w.sum()
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, b)
        if best and level < depth:
            _, f, b = best
            for side in (True, False):
                split(members[(bins[members, f] <= b) == side], everyone[(bins[everyone, f] <= b) == side], level + 1)

    split(np.flatnonzero(weights > 0), np.arange(len(bins)), 0)
    return out


def test_forest_equals_trees_over_the_same_bags(spark):
    rng = np.random.default_rng(5)
    n, trees, depth, min_leaf = 400, 6, 3, 20
    frame = pd.DataFrame({"id": range(n), "x": rng.normal(size=n).round(2), "z": rng.integers(0, 5, n).astype(float), "y": rng.normal(size=n).round(3)})
    frame["y"] += (frame.x > 0.3) * 2 + (frame.z > 2)
    frame["is_test"] = frame.id % 5 == 0
    rows = spark.createDataFrame(frame).repartition(5)
    forest = bagging.fit_forest(rows, F.col("id"), ["x", "z"], "y", trees, depth, min_leaf)
    got = forest.score(rows, F.col("id")).toPandas().sort_values("id").reset_index(drop=True)

    train = ~frame.is_test.to_numpy()
    edges = [sorted(set(np.quantile(frame[c][train], [k / 32 for k in range(1, 32)]))) for c in ("x", "z")]
    bins = np.stack([np.searchsorted(e, frame[c]) for c, e in zip(("x", "z"), edges)], axis=1)
    bags = np.array([[bag_of(i, t) for t in range(trees)] for i in frame.id])
    units = np.rint(frame.y.to_numpy() * bagging.UNITS).astype(np.int64)
    values = np.stack([grown(frame, bins, edges, np.where(train, bags[:, t], 0), units, depth, min_leaf) for t in range(trees)], axis=1)
    unseen = (bags == 0) & train[:, None]
    assert got.y_pred.to_numpy() == pytest.approx(values.mean(1), abs=1e-9)
    assert got.oob_trees.tolist() == unseen.sum(1).tolist()
    has = unseen.any(1)
    mean = (values * unseen).sum(1)[has] / unseen.sum(1)[has]
    assert got.oob_pred[has].to_numpy() == pytest.approx(mean, abs=1e-9) and got.oob_pred[~has].isna().all()
    y = frame.y.to_numpy()[has]
    r2 = bagging.oob_r2(forest.score(rows, F.col("id")), "y").first()
    assert (r2.rows, r2.oob_rows) == (train.sum(), has.sum())
    assert r2.oob_r2 == pytest.approx(1 - ((y - mean) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_forest_of_few_rows_and_gaps(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, False), (2, None, 1.0, False), (3, 2.0, None, False), (4, 1.0, 4.0, True)], "id LONG, x DOUBLE, y DOUBLE, is_test BOOLEAN")
    forest = bagging.fit_forest(rows, F.col("id"), ["x"], "y", 8, 2, 1)
    got = {r.id: r for r in forest.score(rows, F.col("id")).collect()}
    assert set(got) == {1, 4} and got[4].oob_pred is None


def test_bags_come_from_one_digest_for_every_four_trees(spark):
    keys = pd.DataFrame({"id": [7, 123456, None], "x": [1.0, 2.0, 3.0]}).astype({"id": "Int64"})
    rows = spark.createDataFrame([(None if pd.isna(k) else int(k), x) for k, x in zip(keys.id, keys.x)], "id LONG, x DOUBLE")
    drawn = rows.select(bagging.digests(F.col("id"), 10).alias("d")).toArrow().column("d").combine_chunks()
    got = bagging._bags(drawn, 10)
    assert got[:, :2].T.tolist() == [[bag_of(k, t) for t in range(10)] for k in (7, 123456)]
    empty = [sum(int(hashlib.md5(f"{t // 4}|42".encode()).hexdigest()[t % 4 * 8 : t % 4 * 8 + 8], 16) / 2**32 >= p for p in bagging.AT_MOST) for t in range(10)]
    assert got[:, 2].tolist() == empty


def test_tables_of_many_rows_are_dealt_by_their_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, 1, 2)
    assert dealt(rows, 1000) is rows
    parts = dealt(rows, 1000 // (3 * cores)).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 * cores and max(r["count"] for r in parts) < 2 * 1000 / (3 * cores)


def test_a_fit_deals_its_rows(spark, monkeypatch):
    rows = spark.range(0, 2000, 1, 2).select((F.col("id") % 5 == 0).alias("is_test"), "id")
    monkeypatch.setattr(models, "TASK_ROWS", 1600 // (2 * spark.sparkContext.defaultParallelism))
    asked = SimpleNamespace(fit=lambda train: (train.count(), train.rdd.getNumPartitions()))
    n, parts = models.fit(asked, rows)
    assert n == 1600 and parts >= 2 * spark.sparkContext.defaultParallelism


def test_long_texts_reach_python_in_small_batches(spark):
    """A worker holds a batch several times over: 4,000 texts of 20,000 letters come in batches of 4 MB."""
    size = F.pandas_udf(lambda s: pd.Series([int(s.str.len().sum())] * len(s)), "long")
    df = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 2000).alias("t"))
    assert df.select(size("t").alias("n")).agg(F.max("n")).first()[0] <= (4 << 20) + 20_000


def test_few_tasks_of_many_rows_are_dealt_too(spark):
    rows = spark.range(0, 1000, 1, 1)
    parts = dealt(rows, 600).groupBy(F.spark_partition_id()).count().collect()
    assert max(p["count"] for p in parts) <= 600
    assert sum(p["count"] for p in parts) == 1000
