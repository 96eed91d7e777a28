"""Forests on tables of many rows are grown a block of trees at a time."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from filingscope.plans import models


@pytest.fixture
def rows(spark):
    raw = spark.range(4000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("u"))
    raw = raw.withColumn("y", 2 * F.col("a") + F.col("b")).withColumn("k", F.floor("y").cast("int")).withColumn("is_test", F.col("u") < 0.2)
    return raw.drop("u").localCheckpoint()


@pytest.fixture
def fitted(monkeypatch):
    """Trees, seed and rows of every fit of the library."""
    asked, plain = [], RandomForestRegressor.fit

    def fit(self, dataset, params=None):
        own = self.copy(params) if params else self
        asked.append((own.getNumTrees(), own.getSeed(), dataset.count()))
        return plain(self, dataset, params)

    monkeypatch.setattr(RandomForestRegressor, "fit", fit)
    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    return asked


@pytest.mark.parametrize(("make", "label"), [(models.regressor, "y"), (models.classifier, "k")])
def test_a_large_fit_is_whole_and_in_blocks(spark, rows, fitted, monkeypatch, make, label):
    table = models.assemble(rows, ["a", "b"], label)
    n = table.filter(~F.col("is_test")).count()
    estimator = make(label=label, trees=10, min_leaf=50)
    small = models.fit(estimator, table)
    assert [f[0] for f in fitted] == [10]
    fitted.clear()
    monkeypatch.setattr(models, "TASK_ROWS", 500)
    monkeypatch.setattr(models, "BLOCK_TREES", 4)
    large = models.fit(estimator, table)
    assert [f[0] for f in fitted] == [4, 4, 2] and len({f[1] for f in fitted}) == 3 and {f[2] for f in fitted} == {n}
    assert type(large) is type(small) and len(large.trees) == large.getNumTrees == 10
    assert len({tree.toDebugString.split("\n", 1)[1] for tree in large.trees}) == 10
    assert abs(sum(large.featureImportances.toArray()) - 1) < 1e-9
    scored = [models.score(m, table).filter("is_test") for m in (small, large)]
    assert scored[0].columns == scored[1].columns and scored[0].dtypes == scored[1].dtypes
    errors = [s.agg(F.avg(F.abs(F.col(label) - F.col("y_pred")))).first()[0] for s in scored]
    assert abs(errors[0] - errors[1]) < 0.05
    # A forest predicts what its trees say: their mean, or the class with the largest mean share.
    if label == "y":
        row = scored[1].join(table.select("id", "features"), "id").first()
        assert abs(row["y_pred"] - sum(t.predict(row["features"]) for t in large.trees) / 10) < 1e-9


def test_folds_of_a_large_table_are_fitted_in_blocks(spark, rows, fitted, monkeypatch):
    table = models.assemble(rows, ["a", "b"], "y")
    estimator = models.regressor(label="y", trees=6, min_leaf=50)
    small = models.cross_validated_r2(estimator, table, F.col("id"))
    assert [f[0] for f in fitted] == [6] * models.FOLDS
    fitted.clear()
    monkeypatch.setattr(models, "TASK_ROWS", 500)
    monkeypatch.setattr(models, "BLOCK_TREES", 4)
    large = models.cross_validated_r2(estimator, table, F.col("id"))
    assert [f[0] for f in fitted] == [4, 2] * models.FOLDS
    assert abs(large - small) < 0.05
