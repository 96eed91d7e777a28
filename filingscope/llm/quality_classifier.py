"""Quality scores by a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled rows. Every path from a root to a node is a rule, a conjunction of comparisons. A logistic
model with lasso penalty gives each rule a weight, most of them zero. The rules that remain are compiled into one column
expression, so that scoring needs nothing but the statistics.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import map_batches, saved
from filingscope.llm.quality_rules import Text

# Labelled rows used for fitting: a sample of about this many if there are more.
SAMPLE_ROWS = 20_000

TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 11

FEATURES = ["n_words", "word_length", "symbols", "bars", "capitals", "exclamations", "digits", "distinct", "top_word", "repeats", "dup_lines", "line_words", "stops"]

Condition = tuple[str, bool, float]  # feature, whether it must be at most the bound, bound


@dataclass(frozen=True)
class Rules:
    intercept: float
    weighted: tuple[tuple[tuple[Condition, ...], float], ...]


def describe(raw: str | None) -> list[float]:
    """The statistics of a text, all finite; an empty text has zeros."""
    text = Text(raw)
    n, chars = len(text.words), max(1, text.word_chars)
    if not n:
        return [0.0] * len(FEATURES)
    words = Counter(text.words)
    upper = sum(map(text.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.text.count, "0123456789"))
    bars = text.text.count("|")
    return [
        math.log1p(n),
        chars / n,
        (text.symbols - bars) / n,
        bars / n,
        upper / chars,
        text.text.count("!") / n,
        digits / chars,
        len(words) / n,
        words.most_common(1)[0][1] / n,
        text.repeat_words / n,
        text.duplicate_lines / max(1, len(text.lines)),
        n / max(1, len(text.lines)),
        sum(map(text.text.count, ".?")) / n,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def run(batches):
        for batch in batches:
            rows = [describe(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([row[i] for row in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *FEATURES])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def paths(tree: str) -> list[tuple[Condition, ...]]:
    """The conjunction of each node below the root, from a tree's printed form, where depth is told by indentation."""
    found, stack = [], []
    for line in tree.splitlines():
        match = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if match:
            indent, feature, sign, bound = match.groups()
            while stack and stack[-1][0] >= len(indent):
                stack.pop()
            stack.append((len(indent), (FEATURES[int(feature)], sign == "<=", float(bound))))
            found.append(tuple(condition for _, condition in stack))
    return found


def holds(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for feature, at_most, bound in rule:
        out &= (F.col(feature) <= bound) if at_most else (F.col(feature) > bound)
    return out


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Rules from rows of `stats` with a label; labels has doc_id and quality (0 or 1, others and null left out).

    Without rows, or with one class only, the score is a constant: the smoothed share of class 1. A repeated document or label counts
    each time they meet, other labels of the same document too. Equal cuts and weights are what the forest and the lasso make of them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where("label in (0, 1)")
    rows = stats.join(known, "doc_id")
    n = rows.count()
    sample = saved(rows.sample(min(1.0, sample_rows / max(1, n)), seed=SEED).coalesce(4))
    classes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        share = (classes.get(1.0, 0) + 1) / (sum(classes.values()) + 2)
        return Rules(math.log(share / (1 - share)), ())
    described = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("label", "features", *FEATURES)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(described)
    rules = list(dict.fromkeys(path for tree in forest.trees for path in paths(tree.toDebugString)))
    if not rules:
        share = classes[1.0] / sum(classes.values())
        return Rules(math.log(share / (1 - share)), ())
    hits = described.select("label", F.array(*(holds(rule).cast("double") for rule in rules)).alias("hits"))
    lasso = LogisticRegression(featuresCol="rules", regParam=LASSO, elasticNetParam=1.0, maxIter=60).fit(hits.select("label", array_to_vector("hits").alias("rules")))
    weighted = tuple((rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-6)
    return Rules(float(lasso.intercept), weighted)


def score(rules: Rules) -> Column:
    """The probability of class 1 as an expression over the statistics."""
    total = F.lit(rules.intercept)
    for rule, weight in rules.weighted:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))
