"""Splits, evaluation and models: A5-A7, F7-F15, O3."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from filingscope.catalog.panel_queries import CLASS_SQL, FEATURES_SQL
from filingscope.catalog.registry import query
from filingscope.operators import evaluation as ev
from filingscope.operators import panel as pn
from filingscope.operators import quantiles as qt
from filingscope.plans import bagging, models

U_SQL = "CAST(('0x' || substr(md5(CAST(%s AS STRING) || '|42'), 1, 8)) AS BIGINT) / 4294967296.0"

query(
    "a5_regression_metrics",
    lambda t: ev.regression_metrics(t["ready_panel"], "ret_18", "ret_prev_12m").select(
        F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2")
    ),
    """
    WITH p AS (SELECT ret_18 AS y, ret_prev_12m AS p FROM {ready_panel} WHERE ret_18 IS NOT NULL AND ret_prev_12m IS NOT NULL)
    SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse,
      round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p
    """,
)
query(
    "a6_classification_report",
    lambda t: ev.classification_report(t["labels"], "quality", "toxic").select(
        "class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support"
    ),
    """
    WITH classes AS (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels),
    m AS (SELECT c, count(*) FILTER (quality = c AND toxic = c) AS tp, count(*) FILTER (quality = c) AS support,
        count(*) FILTER (toxic = c) AS predicted FROM classes, labels GROUP BY c),
    s AS (SELECT CAST(c AS STRING) AS class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, 2 * tp / (predicted + support) AS f1, support, tp FROM m)
    SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM s
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), sum(support) FROM s
    UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support) FROM s
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
      round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support) FROM s
    """,
)
query(
    "a7_confusion_matrix",
    lambda t: ev.confusion_matrix(t["labels"], "quality", "toxic", [0, 1]),
    """
    SELECT quality AS label, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1
    FROM labels GROUP BY quality
    """,
)
query(
    "f7_test_split",
    lambda t: models.with_test_flag(t["ready_panel"], F.col("id")).select("id", "is_test"),
    f"SELECT id, {U_SQL % 'id'} < 0.2 AS is_test FROM {{ready_panel}}",
)
query(
    "f8_stratified_split",
    lambda t: models.with_stratified_test_flag(
        qt.with_quintiles(pn.labelled(t["ready_panel"])), F.col("id"), "ret_18_class"
    ).select("id", "ret_18_class", "is_test"),
    f"""
    WITH c AS (SELECT id, ret_18_class, {U_SQL % "id"} AS u FROM ({CLASS_SQL}) WHERE ret_18_class IS NOT NULL),
    q AS (SELECT ret_18_class, quantile_cont(u, 0.2) AS cut FROM c GROUP BY ret_18_class)
    SELECT id, ret_18_class, u < cut AS is_test FROM c JOIN q USING (ret_18_class)
    """,
)


def _regression_rows(t):
    rows = models.with_test_flag(pn.with_features(t["ready_panel"]), F.col("id"))
    return models.assemble(rows, models.REGRESSION_FEATURES, models.LABEL)


def _classification_rows(t):
    rows = qt.with_quintiles(pn.with_features(t["ready_panel"]))
    rows = models.with_stratified_test_flag(pn.labelled(rows), F.col("id"), models.CLASS_LABEL)
    return models.assemble(rows, models.CLASSIFICATION_FEATURES, models.CLASS_LABEL)


def _fit(rows, estimator):
    return models.fit(estimator, rows)


def _scored(rows, estimator):
    return models.score(_fit(rows, estimator), rows)


query(
    "f9_forest_regression",
    lambda t: ev.regression_metrics(
        _scored(_regression_rows(t), models.regressor()).filter("is_test"), models.LABEL, "y_pred"
    ),
)
query(
    "f10_cross_validated_r2",
    lambda t: t["ready_panel"].agg(F.count("*").alias("rows")).withColumn(
        "cv_r2", F.lit(models.cross_validated_r2(models.regressor(), _regression_rows(t), F.col("id")))
    ),
)


def _bagged(t):
    """Training rows scored by the trees whose bag lacks them."""
    rows = models.with_test_flag(pn.with_features(t["ready_panel"]), F.col("id")).select("id", "is_test", models.LABEL, *models.REGRESSION_FEATURES)
    forest = bagging.fit_forest(rows, F.col("id"), models.REGRESSION_FEATURES, models.LABEL)
    return forest.score(rows, F.col("id"))


# The same bags, bins and cuts in plain SQL, a block of steps for each level of the trees.
AT_MOST_SQL = " + ".join(f"(u >= {p!r})::INT" for p in bagging.AT_MOST)
BAG_U_SQL = "CAST(('0x' || substr(md5(id || '|' || t // 4 || '|42'), t % 4 * 8 + 1, 8)) AS BIGINT) / 4294967296.0"
EDGES_SQL = f"quantile_cont(x, [{', '.join(f'{k}/{bagging.BINS}.0' for k in range(1, bagging.BINS))}])"


def _level_sql(level: int) -> str:
    return f"""
    counts{level} AS MATERIALIZED (SELECT t, node, f, b, count(*) AS n, sum(w)::BIGINT AS w, sum(w * y)::BIGINT AS s
      FROM nodes{level} JOIN bags USING (id, t) JOIN binned USING (id) WHERE w > 0 AND NOT is_test AND node >= {2**level - 1} GROUP BY ALL),
    sides{level} AS (SELECT t, node, f, b, sum(n) OVER p AS n0, sum(w) OVER p AS w0, sum(s) OVER p AS s0, sum(n) OVER q AS n1, sum(w) OVER q AS w1, sum(s) OVER q AS s1
      FROM counts{level} WINDOW p AS (PARTITION BY t, node, f), q AS (PARTITION BY t, node, f ORDER BY b ROWS UNBOUNDED PRECEDING)),
    gains{level} AS (SELECT *, s1::DOUBLE * s1::DOUBLE / w1::DOUBLE + (s0 - s1)::DOUBLE * (s0 - s1)::DOUBLE / (w0 - w1)::DOUBLE - s0::DOUBLE * s0::DOUBLE / w0::DOUBLE AS gain
      FROM sides{level} WHERE n1 >= {models.MIN_LEAF} AND n0 - n1 >= {models.MIN_LEAF}),
    cuts{level} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY gain DESC, f, b) AS place FROM gains{level} WHERE gain > 0) WHERE place = 1),
    nodes{level + 1} AS MATERIALIZED (SELECT id, t, is_test, CASE WHEN c.f IS NULL THEN node ELSE 2 * node + 1 + (x.b > c.b)::INT END AS node
      FROM nodes{level} LEFT JOIN cuts{level} c USING (t, node) LEFT JOIN binned x USING (id, f))"""


def _bagged_sql() -> str:
    depth = models.REGRESSION_DEPTH
    names = ", ".join(models.REGRESSION_FEATURES)
    values = [f"SELECT t, 2 * node + 1 AS node, s1::DOUBLE / w1 / 1000000 AS value FROM cuts{d} UNION ALL SELECT t, 2 * node + 2, (s0 - s1)::DOUBLE / (w0 - w1) / 1000000 FROM cuts{d}" for d in range(depth)]
    return f"""
    WITH full_rows AS MATERIALIZED (SELECT id, {U_SQL % "id"} < 0.2 AS is_test, CAST(round(ret_18 * 1000000) AS BIGINT) AS y, ret_18, {names} FROM ({FEATURES_SQL}) WHERE {COMPLETE}),
    long_rows AS MATERIALIZED (SELECT id, is_test, y, list_position({models.REGRESSION_FEATURES!r}, name) - 1 AS f, x FROM
      (UNPIVOT (SELECT id, is_test, y, {", ".join(f"{n}::DOUBLE AS {n}" for n in models.REGRESSION_FEATURES)} FROM full_rows) ON {names} INTO NAME name VALUE x)),
    edges AS (SELECT f, list_distinct({EDGES_SQL}) AS e FROM long_rows WHERE NOT is_test GROUP BY f),
    binned AS MATERIALIZED (SELECT id, y, f, len(list_filter(e, lambda v: v < x)) AS b FROM long_rows JOIN edges USING (f)),
    bags AS MATERIALIZED (SELECT id, t, {AT_MOST_SQL} AS w FROM (SELECT id, t, {BAG_U_SQL} AS u FROM full_rows, range({models.TREES}) AS r(t))),
    nodes0 AS (SELECT id, t, is_test, 0 AS node FROM full_rows, range({models.TREES}) AS r(t)),
    {",".join(_level_sql(d) for d in range(depth))},
    node_values AS (SELECT t, 0 AS node, sum(s0)::DOUBLE / sum(w0) / 1000000 AS value FROM (SELECT DISTINCT t, s0, w0 FROM sides0) GROUP BY t UNION ALL {" UNION ALL ".join(values)}),
    scored AS (SELECT id, is_test, ret_18, count(*) FILTER (w = 0 AND NOT is_test) AS oob_trees, avg(value) FILTER (w = 0 AND NOT is_test) AS oob_pred, avg(value) AS y_pred
      FROM nodes{depth} JOIN node_values USING (t, node) JOIN bags USING (id, t) JOIN (SELECT id, ret_18 FROM full_rows) USING (id) GROUP BY ALL)"""


query(
    "f11_scored_panel",
    lambda t: _scored(_regression_rows(t), models.regressor()).select("id", "is_test", "ret_18", "y_pred"),
)
query(
    "f12_forest_classification",
    lambda t: ev.classification_report(
        _scored(_classification_rows(t), models.classifier()).filter("is_test"),
        models.CLASS_LABEL,
        "y_pred",
        qt.QUINTILE_LABELS,
    ),
)


def _importances(t):
    rows = _classification_rows(t)
    model = _fit(rows, models.classifier())
    return models.feature_importances(model, models.CLASSIFICATION_FEATURES, rows)


def _tree_importances(t):
    rows = _regression_rows(t)
    model = _fit(rows, models.regressor(kind="tree"))
    return models.feature_importances(model, models.REGRESSION_FEATURES, rows)


query("f13_feature_importances", _importances)
query("o3_importances_descending", _tree_importances)

# What must hold for any correct fit, whatever its random choices, checked with the numbers SQL can give.
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in [*models.REGRESSION_FEATURES, "ret_18"])
SPLIT_SQL = f"""
    SELECT id, ret_18, {U_SQL % "id"} < 0.2 AS is_test,
      CAST(floor(CAST(('0x' || substr(md5(CAST(id AS STRING) || '|43'), 1, 8)) AS BIGINT) / 4294967296.0 * 3) AS INT) AS fold
    FROM ({FEATURES_SQL}) WHERE {COMPLETE}
"""


def _forest_facts(t):
    """Rows, the range of predictions inside that of the training labels, and an error below that of the mean."""
    scored = _scored(_regression_rows(t), models.regressor())
    train = ~F.col("is_test")
    label = F.when(train, F.col("ret_18"))
    error = F.sqrt(F.avg(F.when(train, (F.col("ret_18") - F.col("y_pred")) ** 2)))
    return scored.agg(
        F.count("*").alias("n"),
        F.count(F.when(train, 1)).alias("n_train"),
        F.round(F.min(label), 6).alias("lowest_label"),
        F.round(F.max(label), 6).alias("highest_label"),
        ((F.min("y_pred") >= F.min(label)) & (F.max("y_pred") <= F.max(label))).alias("inside"),
        (error < F.stddev_pop(label)).alias("better_than_mean"),
        (F.count_distinct("y_pred") > 1).alias("not_constant"),
    )


query(
    "f9_forest_facts",
    _forest_facts,
    f"""
    SELECT count(*) AS n, count(*) FILTER (NOT is_test) AS n_train, round(min(ret_18) FILTER (NOT is_test), 6) AS lowest_label,
      round(max(ret_18) FILTER (NOT is_test), 6) AS highest_label, true AS inside, true AS better_than_mean, true AS not_constant
    FROM ({SPLIT_SQL})
    """,
)
query(
    "f10_folds",
    lambda t: models.with_fold(_regression_rows(t), F.col("id")).select("id", "fold"),
    f"SELECT id, fold FROM ({SPLIT_SQL}) WHERE NOT is_test",
)
query(
    "f11_scored_rows",
    lambda t: _scored(_regression_rows(t), models.regressor()).select(
        "id", "is_test", F.col("y_pred").isNotNull().alias("scored"), F.round("ret_18", 6).alias("ret_18")
    ),
    f"SELECT id, is_test, true AS scored, round(ret_18, 6) AS ret_18 FROM ({SPLIT_SQL})",
)


def _class_facts(t):
    """Training rows of each class beside the sum of its predictions' probabilities, which add up to one for each row."""
    scored = _scored(_classification_rows(t), models.classifier())
    chances = vector_to_array("y_proba")
    return scored.filter(~F.col("is_test")).agg(
        F.count("*").alias("n"),
        F.min(F.abs(F.aggregate(chances, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        F.min((F.col("y_pred") >= 0) & (F.col("y_pred") < 5)).alias("known_classes"),
        (F.avg((F.col("y_pred") == F.col(models.CLASS_LABEL)).cast("double")) > 0.2).alias("better_than_chance"),
    )


query(
    "f12_class_facts",
    _class_facts,
    f"""
    WITH c AS (SELECT id, ret_18_class, {U_SQL % "id"} AS u FROM ({CLASS_SQL}) WHERE ret_18_class IS NOT NULL),
    q AS (SELECT ret_18_class, quantile_cont(u, 0.2) AS cut FROM c GROUP BY ret_18_class),
    whole AS (SELECT id FROM ({FEATURES_SQL}) WHERE {" AND ".join(f"{c} IS NOT NULL" for c in models.CLASSIFICATION_FEATURES)})
    SELECT count(*) AS n, true AS sums_to_one, true AS known_classes, true AS better_than_chance
    FROM c JOIN q USING (ret_18_class) SEMI JOIN whole USING (id) WHERE u >= cut
    """,
)


def _importance_facts(t):
    """The names once each, importances that add up to one and none below zero."""
    return _importances(t).agg(
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("none_negative"),
    )


query(
    "f13_importance_facts",
    _importance_facts,
    f"""
    SELECT string_agg(f, ',' ORDER BY f) AS features, true AS sums_to_one, true AS none_negative
    FROM (SELECT unnest([{", ".join(f"'{c}'" for c in models.CLASSIFICATION_FEATURES)}]) AS f)
    """,
)


def _leaf_facts(t):
    """Training rows of the single tree by predicted value: each is a leaf, or several, of enough rows and predicts their mean."""
    scored = _scored(_regression_rows(t), models.regressor(kind="tree")).filter(~F.col("is_test"))
    leaves = scored.groupBy("y_pred").agg(F.count("*").alias("n"), F.avg("ret_18").alias("mean"))
    return leaves.agg(
        F.sum("n").alias("n"),
        (F.min("n") >= models.MIN_LEAF).alias("large_enough"),
        (F.max(F.abs(F.col("mean") - F.col("y_pred"))) < 1e-6).alias("predicts_the_mean"),
    )


query(
    "f14_leaf_facts",
    _leaf_facts,
    f"SELECT count(*) AS n, true AS large_enough, true AS predicts_the_mean FROM ({SPLIT_SQL}) WHERE NOT is_test",
)


def _rules(t):
    rows = _regression_rows(t)
    model = _fit(rows, models.regressor(kind="tree"))
    text = models.tree_rules(model, models.REGRESSION_FEATURES)
    return rows.sparkSession.createDataFrame(
        list(enumerate(text.splitlines())), "line_no INT, rule STRING"
    )


query("f14_tree_rules", _rules)
query(
    "f15_feature_lists",
    lambda t: _regression_rows(t).agg(
        *[F.count(c).alias(c) for c in models.REGRESSION_FEATURES]
    ),
    f"""
    SELECT {", ".join(f"count({c}) AS {c}" for c in models.REGRESSION_FEATURES)}
    FROM (FEATURES) WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*models.REGRESSION_FEATURES, "ret_18"])}
    """.replace("FEATURES", FEATURES_SQL),
)

query(
    "f10_oob_predictions",
    lambda t: _bagged(t).select("id", "oob_trees", F.round("oob_pred", 6).alias("oob_pred"), F.round("y_pred", 6).alias("y_pred")),
    _bagged_sql() + " SELECT id, oob_trees, round(oob_pred, 6) AS oob_pred, round(y_pred, 6) AS y_pred FROM scored",
)
query(
    "f10_oob_r2",
    lambda t: bagging.oob_r2(_bagged(t), models.LABEL).withColumn("oob_r2", F.round("oob_r2", 6)),
    _bagged_sql()
    + """ SELECT count(*) AS rows, count(oob_pred) AS oob_rows, round(1 - sum((ret_18 - oob_pred) ** 2)
      / (var_pop(ret_18) FILTER (oob_pred IS NOT NULL) * count(oob_pred)), 6) AS oob_r2 FROM scored WHERE NOT is_test""",
)


def _order_facts(t):
    """Importances fall from place to place, and places count up from 1 without a gap."""
    pairs = F.array_sort(F.collect_list(F.struct("place", "importance")))
    return _tree_importances(t).agg(
        F.count("*").alias("features"),
        (F.transform(pairs, lambda p: p["importance"]) == F.sort_array(F.collect_list("importance"), asc=False)).alias("descending"),
        (F.sort_array(F.collect_list("place")) == F.sequence(F.lit(1), F.count("*").cast("int"))).alias("placed"),
    )


query("o3_order_facts", _order_facts, f"SELECT {len(models.REGRESSION_FEATURES)} AS features, TRUE AS descending, TRUE AS placed")
