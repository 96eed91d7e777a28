"""Splits, tree models and their outputs on the panel."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.ordered import dealt
from filingscope.operators.panel import complete_cases
from filingscope.operators.quantiles import exact_quantiles

# Feature lists, split and model settings.
REGRESSION_FEATURES = [
    "similarity",
    "sim_below_70",
    "sentiment",
    "sentiment_pos",
    "inc_len",
    "len_growth_pct",
    "old_similarity",
    "sim_sum",
    "ret_prev_12m",
]
CLASSIFICATION_FEATURES = [name for name in REGRESSION_FEATURES if name != "sim_sum"]
LABEL = "ret_18"
CLASS_LABEL = "ret_18_class"
SEED = 42
TEST_SHARE = 0.20
TREES = 300
REGRESSION_DEPTH = 4
CLASSIFICATION_DEPTH = 6
MIN_LEAF = 200
FOLDS = 3
# Rows of one task of a fit: a forest keeps a row with its weight in each tree, two kilobytes or more for 300 trees.
TASK_ROWS = 200_000
# Trees of a forest that are grown together on a table of more rows than that.
BLOCK_TREES = 30
BLOCK_SEEDS = 1_000_003

FORESTS = (RandomForestRegressor, RandomForestClassifier)
FOREST_MODELS = {
    RandomForestRegressor: lambda jvm: jvm.org.apache.spark.ml.regression.RandomForestRegressionModel,
    RandomForestClassifier: lambda jvm: jvm.org.apache.spark.ml.classification.RandomForestClassificationModel,
}


def unit_hash(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def with_test_flag(rows: DataFrame, key: Column, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Flag a share of the rows as test rows, the same ones however the data is partitioned."""
    return rows.withColumn("is_test", unit_hash(key, seed) < share)


def with_stratified_test_flag(
    rows: DataFrame, key: Column, stratum: str, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Flag the same share of every class, rows without one included: rows whose hash lies below the class's own quantile."""
    hashed = rows.withColumn("_u", unit_hash(key, seed))
    cuts = exact_quantiles(hashed, "_u", (share,), by=stratum)
    if not cuts:
        return hashed.withColumn("is_test", F.lit(False)).drop("_u")
    own = [F.lit(x) for c, q in cuts.items() if c is not None for x in (c, q[0])]
    cut = F.try_element_at(F.create_map(*own), F.col(stratum)) if own else F.lit(None).cast("double")
    if None in cuts:
        cut = F.when(F.col(stratum).isNull(), F.lit(cuts[None][0])).otherwise(cut)
    return hashed.withColumn("is_test", F.col("_u") < cut).drop("_u")


def assemble(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Complete rows with a feature vector."""
    rows = complete_cases(rows, [*features, label])
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def regressor(kind: str = "forest", label: str = LABEL, trees: int = TREES, min_leaf: int = MIN_LEAF):
    """The unfitted regression model: a forest on all features per split, or a single tree."""
    common = dict(
        featuresCol="features", labelCol=label, predictionCol="y_pred", maxDepth=REGRESSION_DEPTH,
        minInstancesPerNode=min_leaf, seed=SEED,
    )
    if kind == "tree":
        return DecisionTreeRegressor(**common)
    return RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", **common)


def classifier(label: str = CLASS_LABEL, trees: int = TREES, min_leaf: int = MIN_LEAF) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol=label, predictionCol="y_pred", probabilityCol="y_proba",
        numTrees=trees, maxDepth=CLASSIFICATION_DEPTH, minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt", seed=SEED,
    )


def fit(estimator, rows: DataFrame) -> Model:
    """Fit on the rows that are not flagged as test rows."""
    train = rows.filter(~F.col("is_test"))
    table = dealt(train, TASK_ROWS)
    if table is train or not isinstance(estimator, FORESTS):
        return estimator.fit(table)
    table = table.select(estimator.getFeaturesCol(), estimator.getLabelCol()).persist()
    try:
        return fit_in_blocks(estimator, table)
    finally:
        table.unpersist()


def fit_in_blocks(estimator, rows: DataFrame) -> Model:
    """One forest of all trees, grown BLOCK_TREES at a time on the same rows, each block with bags and bins from its own seed.

    A row is kept with its weights in the trees of one block only, and what a task counts for a block's nodes stays near its core.
    """
    trees, done = estimator.getNumTrees(), []
    for first in range(0, trees, BLOCK_TREES):
        # A task draws from the seed plus its number, so seeds lie further apart than there are tasks.
        params = {estimator.numTrees: min(BLOCK_TREES, trees - first), estimator.seed: estimator.getSeed() + first * BLOCK_SEEDS}
        done.append(estimator.fit(rows, params))
    java = done[0]._java_obj
    grown = [tree for block in done for tree in block._java_obj.trees()]
    context = rows.sparkSession.sparkContext
    kind = context._jvm.java.lang.Class.forName(grown[0].getClass().getName(), True, java.getClass().getClassLoader())
    array = context._jvm.java.lang.reflect.Array.newInstance(kind, len(grown))
    for i, tree in enumerate(grown):
        array[i] = tree
    sizes = [java.numFeatures(), *([java.numClasses()] if isinstance(estimator, RandomForestClassifier) else [])]
    whole = FOREST_MODELS[type(estimator)](context._jvm)(java.uid(), array, *sizes)
    model = estimator._copyValues(estimator._create_model(whole))
    model._transfer_params_to_java()
    return model


def score(model: Model, rows: DataFrame) -> DataFrame:
    """All rows with `y_pred`; internal vector columns are dropped."""
    return model.transform(rows).drop("features", "rawPrediction")


def with_fold(rows: DataFrame, key: Column, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """The training rows with the number of their fold; test rows take no part in validation."""
    return rows.filter(~F.col("is_test")).withColumn("fold", F.floor(unit_hash(key, seed + 1) * folds).cast("int"))


def cross_validated_r2(estimator, rows: DataFrame, key: Column, folds: int = FOLDS, seed: int = SEED) -> float:
    """Mean R2 over held-out folds of the training rows; folds are cut by hash of the key."""
    evaluator = RegressionEvaluator(
        labelCol=estimator.getLabelCol(), predictionCol="y_pred", metricName="r2"
    )
    train = with_fold(rows, key, folds, seed)
    rows = dealt(train, TASK_ROWS)
    in_blocks = rows is not train and isinstance(estimator, FORESTS)
    if in_blocks:
        rows = rows.select(estimator.getFeaturesCol(), estimator.getLabelCol(), "fold")
    rows = rows.persist()
    scores = []
    for held_out in range(folds):
        own = rows.filter(F.col("fold") != held_out)
        model = fit_in_blocks(estimator, own) if in_blocks else estimator.fit(own)
        scores.append(evaluator.evaluate(model.transform(rows.filter(F.col("fold") == held_out))))
    rows.unpersist()
    return sum(scores) / folds


def feature_importances(model: Model, features: list[str], rows: DataFrame) -> DataFrame:
    """Feature names with their importance and place from 1, highest first, equal ones by name. One row per feature."""
    pairs = zip(features, [float(x) for x in model.featureImportances.toArray()])
    ordered = sorted(pairs, key=lambda pair: (-pair[1], pair[0]))
    table = [(name, value, place) for place, (name, value) in enumerate(ordered, 1)]
    return rows.sparkSession.createDataFrame(table, "feature STRING, importance DOUBLE, place INT").orderBy("place")


def tree_rules(model: Model, features: list[str]) -> str:
    """The rules of a single tree with feature names in place of their numbers."""
    text = model.toDebugString
    for i in reversed(range(len(features))):
        text = text.replace(f"feature {i} ", f"{features[i]} ")
    return text
