"""Models: scaled logistic and linear baselines, boosted trees, quantile leaves, isotonic calibration, uplift learners,
and what a score is made of."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.operators.boosting import Tree
from freightloom.operators.ranked import few_group_quantiles, group_quantiles, quantiles
from freightloom.operators.scratch import dropped, written


def _assembled(features: Sequence[str], scaled: bool) -> list:
    parts = [VectorAssembler(inputCols=list(features), outputCol="raw")]
    return parts + [StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)] if scaled else [VectorAssembler(inputCols=list(features), outputCol="features")]


def logistic(train: DataFrame, features: Sequence[str], label: str, l2: float = 0.01) -> PipelineModel:
    """Multinomial where the label has more than two classes (numbered from 0)."""
    return Pipeline(stages=[*_assembled(features, True), LogisticRegression(labelCol=label, regParam=l2, maxIter=50)]).fit(train)


def linear(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    return Pipeline(stages=[*_assembled(features, True), LinearRegression(labelCol=label, regParam=1e-6)]).fit(train)


def boosted(train: DataFrame, features: Sequence[str], label: str, is_late: Column | None = None, trees: int = 20, depth: int = 3, seed: int = 7) -> PipelineModel:
    """Boosted trees for a 0/1 label; rows where `is_late` holds decide when to stop."""
    gbt = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.15)
    if is_late is not None:
        train = train.withColumn("_late", is_late)
        gbt = gbt.setValidationIndicatorCol("_late")
    return Pipeline(stages=[*_assembled(features, False), gbt]).fit(train)


def boosted_value(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 3, seed: int = 7) -> PipelineModel:
    return Pipeline(stages=[*_assembled(features, False), GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)]).fit(train)


def probability(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def predicted(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", name).select(*df.columns, name)


def quantile_leaves(train: DataFrame, df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float], depth: int = 4) -> DataFrame:
    """`df` with q_<alpha> columns: the exact quantiles of the training labels in the row's leaf of a tree, in order."""
    tree = DecisionTreeRegressor(labelCol=label, maxDepth=depth, minInstancesPerNode=20, leafCol="leaf", seed=7)
    model = Pipeline(stages=[*_assembled(features, False), tree]).fit(train)
    names = [f"q_{round(a * 100):02d}" for a in alphas]
    leaves = group_quantiles(model.transform(train), ["leaf"], label, alphas, names)
    out = model.transform(df).join(F.broadcast(leaves), "leaf", "left")  # at most 2 ** depth leaves
    ordered = F.array_sort(F.array(*names))
    return out.select(*df.columns, *[ordered[k].alias(n) for k, n in enumerate(names)])


def boosted_quantiles(train: DataFrame, df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float], rounds: int = 3, depth: int = 3, rate: float = 0.6, least: int = 20) -> DataFrame:
    """`df` with q_<alpha> columns by boosting on the pinball loss: each round's tree splits by the loss's gradient, with
    `least` rows in a leaf, and moves its leaves by the quantile of what is left in them; the quantiles of a row are put in
    order. Rows without a label don't learn.

    What a row's quantiles are depends on its features alone, so a round counts the rows of equal features once, those below
    each quantile and all, and its trees are fitted on the counts. Leaves' quantiles are found together for all shares. Rows
    of `df` meet the trees as column expressions, in one pass; rounds should be few (generated code grows with them)."""
    names, own = [f"q_{round(a * 100):02d}" for a in alphas], [f"x{k}" for k in range(len(features))]
    rows = written(train.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(x) for f, x in zip(features, own)], F.col(label).cast("double").alias("y")))
    start, n = quantiles(rows, "y", alphas, laid=True), rows.count()
    trees: list[list[Tree]] = [[] for _ in alphas]
    said = lambda k, columns: reduce(lambda a, b: a + b, [t.predicted(columns) for t in trees[k]], F.lit(start[k]).cast("double"))
    for _ in range(rounds if n else 0):
        now = rows.select(*own, "y", *[said(k, own).alias(f"q{k}") for k in range(len(alphas))])
        below = [F.count_if(F.col("y") < F.col(f"q{k}")).alias(f"n{k}") for k in range(len(alphas))]
        cells = written(now.groupBy(*own).agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *[F.first(f"q{k}").alias(f"q{k}") for k in range(len(alphas))], *below))
        grown = []
        for k, a in enumerate(alphas):
            sides = [F.struct(F.lit(slope).alias("slope"), count.cast("double").alias("rows")) for slope, count in ((a - 1.0, F.col(f"n{k}")), (float(a), F.col("n") - F.col(f"n{k}")))]
            # Half a row less than `least`, because the share is a fraction; of fewer than twice `least` rows none is split.
            tree = DecisionTreeRegressor(labelCol="slope", weightCol="rows", maxDepth=depth if n >= 2 * least else 0, minWeightFractionPerNode=min(0.49, max(0.0, (least - 0.5) / n)), seed=7)
            grown.append(Tree.of_model(Pipeline(stages=[*_assembled(own, False), tree]).fit(cells.select(*own, F.inline(F.array(*sides))).where("rows > 0")).stages[-1]))
        most_nodes = max(len(t.feature) for t in grown)
        group = [(F.lit(k * most_nodes) + t.leaf(own)).alias("g") for k, t in enumerate(grown)]
        left = now.select(F.inline(F.array(*[F.struct(g, (F.col("y") - F.col(f"q{k}")).alias("left")) for k, g in enumerate(group)])))
        ends = [F.struct(g, "n", *[(F.col(c) - F.col(f"q{k}")).alias(c) for c in ("low", "high")]) for k, g in enumerate(group)]
        ends = cells.select(F.inline(F.array(*ends))).groupBy("g").agg(F.sum("n"), F.min("low"), F.max("high"))
        steps = few_group_quantiles(left, "g", "left", lambda g: alphas[g // most_nodes], ends=ends)  # noqa: B023
        for g, step in steps.items():
            grown[g // most_nodes].value[g % most_nodes] = rate * step
        dropped(cells)
        for of, tree in zip(trees, grown):
            of.append(tree)
    dropped(rows)
    ordered = F.array_sort(F.array(*[said(k, features) for k in range(len(alphas))]))
    return df.select(*df.columns, *[ordered[k].alias(n) for k, n in enumerate(names)])


def isotonic(train: DataFrame, score: str, label: str, df: DataFrame, name: str = "calibrated") -> DataFrame:
    """`df` with the score made monotone against the label's rate, kept inside (0, 1)."""
    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(train.withColumn(label, F.col(label).cast("double")))
    out = model.transform(df)
    return out.withColumn(name, F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("prediction")))).select(*df.columns, name)


def contributions(model: PipelineModel, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, feature, contribution): each feature's part of a scaled linear model's log-odds or value."""
    scaler, last = model.stages[-2], model.stages[-1]
    weights = last.coefficients.toArray()
    parts = [F.struct(F.lit(f).alias("feature"), ((F.col(f) - float(m)) / float(s or 1.0) * float(w)).alias("contribution")) for f, m, s, w in zip(features, scaler.mean.toArray(), scaler.std.toArray(), weights)]
    return df.select(key, F.inline(F.array(*parts)))


def monotone_logistic(train: DataFrame, features: Sequence[str], label: str, signs: dict[str, int], l2: float = 0.01) -> PipelineModel:
    """A logistic model whose chance rises (1) or falls (-1) in the named features, by bounds on their weights."""
    n = len(features)
    low = [0.0 if signs.get(f) == 1 else -math.inf for f in features]
    high = [0.0 if signs.get(f) == -1 else math.inf for f in features]
    bounded = LogisticRegression(labelCol=label, regParam=l2, maxIter=50, lowerBoundsOnCoefficients=Matrices.dense(1, n, low), upperBoundsOnCoefficients=Matrices.dense(1, n, high))
    return Pipeline(stages=[*_assembled(features, True), bounded]).fit(train)


def largest_contributions(parts: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest by size for each row, sign kept."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "feature")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def driver_ranking(parts: DataFrame) -> DataFrame:
    """(feature, strength, share): mean size of each feature's contribution."""
    by = parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("strength"))
    return by.withColumn("share", F.col("strength") / F.sum("strength").over(Window.partitionBy()))


#: Ways to say who should be treated.
UPLIFT = ("s", "t", "dr", "risk")


def uplift_scores(df: DataFrame, features: Sequence[str], treated: str, outcome: str, fold: Column, folds: int = 4) -> DataFrame:
    """`df` with scores of who gains from treatment: s (one model), t (two models), dr (cross-fitted, doubly robust), and
    risk, which says only who is likely to lose untreated: a model of the controls.

    The outcome is a loss (1 is bad), so a gain is the untreated risk less the treated one.
    """
    # Written, because a dozen fits read it, each many times.
    both = written(df.withColumn("_fold", fold))
    share = both.agg(F.avg(treated)).first()[0]
    one = logistic(both, [*features, treated], outcome)
    risk = lambda m, d, name, arm=None: probability(m, d if arm is None else d.withColumn(treated, F.lit(float(arm))), name)
    own = both.withColumnRenamed(treated, "_own").withColumn(treated, F.col("_own"))
    scored = risk(one, risk(one, own, "_s0", 0), "_s1", 1).withColumn(treated, F.col("_own"))
    arms = [logistic(both.where(F.col(treated) == a), features, outcome) for a in (0, 1)]
    scored = risk(arms[1], risk(arms[0], scored, "_t0"), "_t1")
    pseudo = None
    for k in range(folds):
        rest, here = both.where(F.col("_fold") != k), both.where(F.col("_fold") == k)
        m0, m1 = (logistic(rest.where(F.col(treated) == a), features, outcome) for a in (0, 1))
        part = risk(m1, risk(m0, here, "_m0"), "_m1")
        t, y = F.col(treated), F.col(outcome)
        value = F.col("_m0") - F.col("_m1") + (1 - t) * (y - F.col("_m0")) / (1 - share) - t * (y - F.col("_m1")) / share
        part = part.withColumn("_value", value)
        pseudo = part if pseudo is None else pseudo.unionByName(part)
    scored = predicted(linear(pseudo, features, "_value"), scored, "dr")
    return scored.withColumns({"s": F.col("_s0") - F.col("_s1"), "t": F.col("_t0") - F.col("_t1"), "risk": F.col("_t0")}).select(*df.columns, *UPLIFT)
