"""Returns, panel, features, quantiles and evaluation on hand-written and random rows."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filingscope.functions import dates
from filingscope.operators import evaluation as ev
from filingscope.operators import panel as pn
from filingscope.operators import pairs as pr
from filingscope.operators import quantiles as qt
from filingscope.operators import returns as rt
from filingscope.plans import models

D = datetime.date


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_anchors(spark):
    rows = [(D(2020, 1, 1),), (D(2020, 1, 31),), (D(2020, 12, 5),)]
    got = rt.with_anchors(table(spark, rows, "date_a DATE")).orderBy("date_a").collect()
    assert [r.start_anchor for r in got] == [D(2020, 2, 1), D(2020, 2, 1), D(2021, 1, 1)]
    assert got[0].prev_start == D(2019, 2, 1) and got[0].end_anchor == D(2021, 8, 1)


def test_window_bounds(spark):
    start = D(2020, 2, 1)
    anchors = table(spark, [("a", start), ("a", start), ("b", start)], "cik STRING, start_anchor DATE")
    returns = table(
        spark,
        [
            ("a", D(2020, 2, 1), 0.1), ("a", D(2021, 8, 1), 0.3), ("a", D(2021, 8, 2), 9.0), ("a", D(2020, 5, 5), None),
            ("a", D(2020, 6, 5), float("nan")), ("a", D(2019, 2, 1), 0.5), ("a", D(2020, 1, 31), 0.7), ("a", D(2019, 1, 31), 9.0),
            ("c", D(2020, 2, 1), 1.0),
        ],
        "cik STRING, date DATE, ret DOUBLE",
    )
    rows = rt.window_means(anchors, returns).collect()
    assert len(rows) == 1 and rows[0].cik == "a"
    assert rows[0].ret_18 == pytest.approx(20.0)
    assert rows[0].ret_prev_12m == pytest.approx(60.0)


def test_windows_equal_the_range_join(spark):
    rng = random.Random(2)
    day = lambda: D(2015, 1, 1) + datetime.timedelta(days=rng.randrange(1800))
    pairs = pd.DataFrame([(i, f"c{rng.randrange(4)}", day()) for i in range(80)], columns=["id", "cik", "date_a"])
    rets = pd.DataFrame([(f"c{rng.randrange(4)}", day(), rng.random() if rng.random() > 0.1 else None) for _ in range(600)], columns=["cik", "date", "ret"])
    anchored = rt.with_anchors(spark.createDataFrame(pairs, "id INT, cik STRING, date_a DATE"))
    returns = spark.createDataFrame(rets, "cik STRING, date DATE, ret DOUBLE")
    got = {r.id: r for r in rt.attach(anchored, rt.window_means(anchored, returns), ["cik", "start_anchor"]).collect()}
    for r in anchored.collect():
        mine = rets[rets.cik == r.cik]
        ahead = mine[(mine.date >= r.start_anchor) & (mine.date <= r.end_anchor)].ret.astype(float).mean()
        back = mine[(mine.date >= r.prev_start) & (mine.date < r.start_anchor)].ret.astype(float).mean()
        for value, mean in ((got[r.id].ret_18, ahead), (got[r.id].ret_prev_12m, back)):
            assert (value is None and np.isnan(mean)) or value == pytest.approx(mean * 100)


def test_link_validity(spark):
    stock = table(spark, [(1, D(2006, 1, 1), 0.1), (1, D(2010, 6, 30), 0.2), (1, D(2010, 7, 1), 0.3), (1, D(2005, 12, 31), 9.0), (2, D(2010, 1, 1), 0.5)], "permno BIGINT, date DATE, ret DOUBLE")
    links = table(
        spark,
        [(1, "g", "LU", "P", D(2000, 1, 1), D(2010, 6, 30)), (1, "h", "LC", "C", D(2010, 6, 30), None), (2, "g", "LX", "P", D(2000, 1, 1), None), (2, "g", "LU", "J", D(2000, 1, 1), None)],
        "lpermno BIGINT, gvkey STRING, linktype STRING, linkprim STRING, linkdt DATE, linkenddt DATE",
    )
    companies = table(spark, [("g", "12", "Gee"), ("h", "34", "Aitch")], "gvkey STRING, cik STRING, conm STRING")
    everything = rt.link_returns(stock, links, companies)
    assert 9.0 in {r.ret for r in everything.collect()}
    rows = rt.link_returns(stock, links, companies, first=rt.STUDY_FIRST_DATE, last=rt.STUDY_LAST_DATE).orderBy("date", "cik").collect()
    assert [(r.cik, r.ret) for r in rows] == [("0000000012", 0.1), ("0000000012", 0.2), ("0000000034", 0.2), ("0000000034", 0.3)]
    only = rt.link_returns(stock, links, companies, table(spark, [(" 34",)], "cik STRING"))
    assert {r.cik for r in only.collect()} == {"0000000034"}


def test_lag_counts_only_labelled_rows(spark):
    similarity = table(
        spark,
        [("a", D(2010, 1, 5), D(2009, 1, 5), 0.9, 80, 80, 0.1), ("a", D(2011, 1, 5), D(2010, 1, 5), 0.8, 80, 80, 0.1), ("a", D(2012, 1, 5), D(2011, 1, 5), 0.7, 80, 80, 0.1)],
        "ticker STRING, date_a DATE, date_b DATE, similarity DOUBLE, len_a INT, len_b INT, sentiment DOUBLE",
    )
    returns = table(spark, [("a", D(2010, 2, 1), 0.1), ("a", D(2013, 7, 1), 0.2)], "cik STRING, date DATE, ret DOUBLE")
    rows = pn.build_panel(similarity, returns).orderBy("date_a").collect()
    assert [r.similarity for r in rows] == [0.9, 0.7]
    assert [r.old_similarity for r in rows] == [None, 0.9]
    assert rows[1].ret_prev_12m is None and "prev_start" not in rows[0]


def test_pair_filters(spark):
    rows = table(
        spark,
        [("01/03/2011", "2010-03-01", 75, 75), ("2011-07-15", "01.03.2010", 80, 90), ("2010-01-01", "2011-01-01", 99, 99), ("2011-01-01", "2010-12-01", 74, 99), ("junk", "2010-01-01", 99, 99)],
        "date_a STRING, date_b STRING, len_a INT, len_b INT",
    )
    kept = sorted((str(r.date_a), str(r.date_b)) for r in pr.clean_pairs(rows).collect())
    assert kept == [("2010-01-01", "2011-01-01"), ("2011-03-01", "2010-03-01")]


def test_mixed_dates(spark):
    cases = {"04/03/2020": "2020-03-04", "2020-03-04": "2020-03-04", "31.12.2019": "2019-12-31", "12/31/2019": "2019-12-31", "4 March 2020": "2020-03-04", "Mar 4, 2020": "2020-03-04", "20200304": "2020-03-04", "x": None, "": None}
    df = table(spark, list(cases.items()), "t STRING, e STRING")
    assert df.filter(~dates.parse_mixed_date(F.col("t")).cast("string").eqNullSafe(F.col("e"))).count() == 0


def test_keys_and_years(spark):
    rows = spark.range(1).select(
        dates.normalise_cik(F.lit(" 320193 ")), dates.normalise_cik(F.lit(320193)), dates.normalise_cik(F.lit("12345678901")),
        dates.accession_year(F.lit("0000000000-70-000001")), dates.accession_year(F.lit("0000000000-69-000001")), dates.accession_year(F.lit("0000-69-1")),
    ).first()
    assert tuple(rows) == ("0000320193", "0000320193", "12345678901", 1970, 2069, None)


def test_features(spark):
    rows = table(
        spark,
        [(0.5, 0.0, 3, 0, 0.2), (0.7, -0.1, 3, 2, None), (float("nan"), float("nan"), 1, 2, 0.1), (float("inf"), None, 2, 2, 0.3)],
        "similarity DOUBLE, sentiment DOUBLE, len_a INT, len_b INT, old_similarity DOUBLE",
    )
    got = pn.with_features(rows).collect()
    assert [r.sim_below_70 for r in got] == [1, 0, 0, 0]
    assert [r.sentiment_pos for r in got] == [1, 0, 0, 0]
    assert [r.len_growth_pct for r in got] == [None, 0.5, -0.5, 0.0]
    assert [r.inc_len for r in got] == [1, 1, 0, 0]
    assert got[0].sim_sum == 0.2 and got[1].sim_sum is None
    percent = pn.with_features(rows.withColumn("similarity", F.lit(69.0)))
    assert percent.first().sim_below_70 == 1


@pytest.mark.parametrize("n", [1, 2, 7, 1003, 30_000])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2) if n > 5000 else rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    probs = (0.0, 0.2, 0.25, 0.5, 0.8, 0.999, 1.0)
    assert qt.exact_quantiles(df, "v", probs)[0] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_quantiles_with_a_hot_value_and_groups(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 40_000), "v": rng.normal(size=40_000)})
    frame.loc[frame.index % 3 == 0, "v"] = 0.25
    df = spark.createDataFrame(frame).repartition(6)
    got = qt.exact_quantiles(df, "v", (0.2, 0.61), by="g")
    for g, part in frame.groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(part.v, (0.2, 0.61))), abs=1e-12)


def test_quantiles_narrow_brackets(spark, monkeypatch):
    values = np.random.default_rng(8).normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    monkeypatch.setattr(qt, "SKETCH", 10)
    monkeypatch.setattr(qt, "BRACKET_ROWS", 100)
    assert qt.exact_quantiles(df, "v", (0.5, 0.9))[0] == pytest.approx(list(np.quantile(values, (0.5, 0.9))), abs=1e-12)


def test_quintiles_equal_qcut(spark):
    values = np.random.default_rng(1).normal(size=1003)
    frame = pd.DataFrame({"i": range(1003), "ret_18": values})
    expected = pd.qcut(frame.ret_18, 5, labels=list(qt.QUINTILE_LABELS))
    got = qt.with_quintiles(spark.createDataFrame(frame)).orderBy("i").collect()
    assert [r.ret_18_class for r in got] == list(expected.cat.codes)
    assert [r.ret_18_bucket for r in got] == list(expected)
    with pytest.raises(ValueError):
        qt.with_quintiles(spark.createDataFrame(pd.DataFrame({"ret_18": [1.0] * 20})))
    with pytest.raises(ValueError):
        qt.with_quintiles(spark.createDataFrame([(None,)], "ret_18 DOUBLE"))


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(2).normal(size=5000)
    rows = qt.histogram(spark.createDataFrame(pd.DataFrame({"v": values})), "v", 50).orderBy("bin").collect()
    counts, edges = np.histogram(values, 50)
    assert [r.n for r in rows] == list(counts)
    assert [r.lower for r in rows] == pytest.approx(list(edges[:-1]))
    flat = qt.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v DOUBLE"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in flat] == list(np.histogram([2.0, 2.0], 4)[0])


def test_evaluation(spark):
    rows = table(spark, [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "label INT, pred INT")
    report = {r["class"]: r for r in ev.classification_report(rows, "label", "pred").collect()}
    assert (report["0"].precision, report["0"].recall, report["0"].support) == (1.0, 0.5, 2)
    assert report["1"].f1 == pytest.approx(0.5)
    assert report["accuracy"].f1 == pytest.approx(4 / 6) and report["accuracy"].support == 6
    assert report["macro avg"].recall == pytest.approx((0.5 + 1 + 2 / 3) / 3)
    assert report["weighted avg"].precision == pytest.approx((2 * 1 + 1 / 3 + 3 * 1) / 6)
    never = {r["class"]: r for r in ev.classification_report(table(spark, [(0, 1)], "label INT, pred INT"), "label", "pred").collect()}
    assert never["0"].precision == never["1"].recall == 0.0
    named = ev.classification_report(rows.withColumn("pred", F.col("pred").cast("double")), "label", "pred", ("low", "mid", "high"))
    assert {r["class"]: r.support for r in named.collect()}["high"] == 3
    matrix = ev.confusion_matrix(rows, "label", "pred", [0, 1, 2]).orderBy("label").collect()
    assert [tuple(r)[1:] for r in matrix] == [(1, 1, 0), (0, 1, 0), (0, 1, 2)]
    metrics = ev.regression_metrics(table(spark, [(1.0, 1.5), (3.0, 2.0), (None, 1.0)], "y DOUBLE, p DOUBLE"), "y", "p").first()
    assert metrics.mae == 0.75 and metrics.rmse == pytest.approx(0.625**0.5) and metrics.r2 == pytest.approx(0.375)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 4000
    frame = pd.DataFrame({c: rng.normal(size=n) for c in models.REGRESSION_FEATURES})
    frame["ret_18"] = 10 * (frame.similarity > 0) + frame.sentiment + rng.normal(size=n)
    frame["id"] = range(n)
    return spark.createDataFrame(frame).repartition(4).cache()


def test_splits_do_not_depend_on_partitioning(planted):
    def flags(df):
        return sorted(r.id for r in models.with_test_flag(df, F.col("id")).filter("is_test").collect())

    assert flags(planted) == flags(planted.repartition(1))
    assert 0.17 < len(flags(planted)) / 4000 < 0.23
    rows = qt.with_quintiles(planted)
    split = models.with_stratified_test_flag(rows, F.col("id"), "ret_18_class")
    for r in split.groupBy("ret_18_class").agg(F.avg(F.col("is_test").cast("int")).alias("share")).collect():
        assert r.share == pytest.approx(0.2, abs=0.002)


def test_forest_finds_the_planted_signal(planted):
    rows = models.assemble(models.with_test_flag(planted, F.col("id")), models.REGRESSION_FEATURES, models.LABEL)
    model = models.fit(models.regressor(trees=10, min_leaf=50), rows)
    scored = models.score(model, rows)
    assert scored.count() == 4000
    first = ev.regression_metrics(scored.filter("is_test"), "ret_18", "y_pred").first()
    assert first.r2 > 0.7
    again = models.score(models.fit(models.regressor(trees=10, min_leaf=50), rows), rows)
    assert ev.regression_metrics(again.filter("is_test"), "ret_18", "y_pred").first() == first
    top = models.feature_importances(model, models.REGRESSION_FEATURES, rows).first()
    assert top.feature == "similarity"
    assert models.cross_validated_r2(models.regressor(trees=5, min_leaf=50), rows, F.col("id")) > 0.7
    rules = models.tree_rules(models.fit(models.regressor("tree", min_leaf=50), rows), models.REGRESSION_FEATURES)
    assert "similarity <=" in rules and "feature " not in rules


def test_classifier_beats_chance(planted):
    rows = models.with_stratified_test_flag(qt.with_quintiles(planted), F.col("id"), models.CLASS_LABEL)
    rows = models.assemble(rows, models.CLASSIFICATION_FEATURES, models.CLASS_LABEL)
    scored = models.score(models.fit(models.classifier(trees=10, min_leaf=50), rows), rows)
    assert scored.filter("is_test").agg(F.avg((F.col("y_pred") == F.col("ret_18_class")).cast("int"))).first()[0] > 0.35
    assert "sim_sum" not in models.CLASSIFICATION_FEATURES and len(models.CLASSIFICATION_FEATURES) == 8


def test_windows_need_one_shuffle_of_sums_and_no_expansion(spark):
    anchors = table(spark, [("1", D(2007, 1, 1))], "cik STRING, start_anchor DATE")
    returns = table(spark, [("1", D(2007, 1, 2), 0.1)], "cik STRING, date DATE, ret DOUBLE")
    plan = rt.window_means(anchors, returns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Window") >= 1


def test_not_a_number_has_no_class_and_endless_values_no_bin(spark):
    values = [float(i) for i in range(10)] + [float("nan"), None]
    rows = qt.with_quintiles(table(spark, [(v,) for v in values], "ret_18 DOUBLE")).collect()
    odd = [r for r in rows if r.ret_18 is None or r.ret_18 != r.ret_18]
    assert len(odd) == 2 and all(r.ret_18_class is None and r.ret_18_bucket is None for r in odd)
    endless = table(spark, [(v,) for v in [1.0, 2.0, 3.0, float("inf"), float("-inf"), float("nan")]], "v DOUBLE")
    bins = qt.histogram(endless, "v", 2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r.n) for r in bins] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]


def test_a_split_keeps_rows_without_a_class(spark):
    rows = table(spark, [(i, "ab"[i % 2] if i % 3 else None) for i in range(600)], "id INT, c STRING")
    flagged = models.with_stratified_test_flag(rows, F.col("id"), "c").collect()
    for c in ("a", "b", None):
        own = [r.is_test for r in flagged if r.c == c]
        assert abs(sum(own) / len(own) - models.TEST_SHARE) < 0.02
