"""What models are worth, on made rows whose truth is known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import models as M
from freightloom.operators import ranked as R


@pytest.fixture(scope="module")
def rows(spark):
    """Two features, a third of noise; a label whose log-odds are 3a - 2b, and a value 5a + b with known noise."""
    key = F.col("id")
    df = spark.range(4000).select("id", *[S.uniform(key, c).alias(c) for c in "abc"], S.uniform(key, "draw").alias("u"), (S.uniform(key, "arm") < 0.5).cast("double").alias("t"))
    odds = 6 * (F.col("a") - 0.5) - 4 * (F.col("b") - 0.5)
    df = df.withColumns({"p": 1 / (1 + F.exp(-odds)), "value": 5 * F.col("a") + F.col("b") + (F.col("u") - 0.5)})
    df = df.withColumn("y", (F.col("u") < F.col("p")).cast("double"))
    # Treatment halves the risk where a is over a half, and does nothing elsewhere.
    loss = F.when((F.col("t") == 1) & (F.col("a") > 0.5), 0.5).otherwise(1.0) * F.col("p")
    return df.withColumn("loss", (F.col("u") < loss).cast("double")).cache()


def auc(df, score, label):
    return R.roc_auc(df.withColumn(score, F.round(score, 3)), score, F.col(label)).first()[0]


def test_classifiers_rank_and_calibrate(rows):
    train, test = rows.where("id < 3000"), rows.where("id >= 3000")
    best = auc(test, "p", "y")
    for model, loss in ((M.logistic(train, ["a", "b", "c"], "y"), 0.02), (M.boosted(train, ["a", "b", "c"], "y", F.col("id") > 2600, trees=15), 0.04)):
        out = M.probability(model, test, "said")
        assert auc(out, "said", "y") > best - loss
        assert abs(out.agg(F.avg("said") - F.avg("y")).first()[0]) < 0.05
    raw = M.probability(M.logistic(train, ["a", "b"], "y"), test, "said").withColumn("score", F.col("said") * F.col("said"))
    even = M.isotonic(raw, "score", "y", raw)
    brier = lambda c: even.agg(F.avg(F.pow(F.col(c) - F.col("y"), 2))).first()[0]
    assert brier("calibrated") < brier("score") and even.where("calibrated <= 0 or calibrated >= 1").isEmpty()


def test_values_and_quantiles(rows):
    train, test = rows.where("id < 3000"), rows.where("id >= 3000")
    mae = lambda df: df.agg(F.avg(F.abs(F.col("said") - F.col("value")))).first()[0]
    assert mae(M.predicted(M.linear(train, ["a", "b"], "value"), test, "said")) < 0.27
    assert mae(M.predicted(M.boosted_value(train, ["a", "b"], "value"), test, "said")) < 0.4
    q = M.quantile_leaves(train, test, ["a", "b"], "value", [0.1, 0.5, 0.9])
    covered, crossed = q.agg(F.avg(F.col("value").between(F.col("q_10"), F.col("q_90")).cast("int")), F.count_if((F.col("q_10") > F.col("q_50")) | (F.col("q_50") > F.col("q_90")))).first()
    assert 0.72 < covered < 0.88 and crossed == 0


def test_contributions_add_up(rows):
    model = M.linear(rows, ["a", "b", "c"], "value")
    parts = M.contributions(model, rows, "id", ["a", "b", "c"])
    total = parts.groupBy("id").agg(F.sum("contribution").alias("s"))
    said = M.predicted(model, rows, "said").join(total, "id").agg(F.max(F.abs(F.col("said") - F.col("s"))) - F.min(F.abs(F.col("said") - F.col("s")))).first()[0]
    assert said < 1e-6  # the same intercept everywhere
    assert [r["feature"] for r in M.driver_ranking(parts).orderBy(F.desc("strength")).collect()] == ["a", "b", "c"]


def test_monotone_model_keeps_its_direction(rows):
    wrong = M.monotone_logistic(rows, ["a", "b"], "y", {"a": -1})
    weights = dict(zip(["a", "b"], wrong.stages[-1].coefficients.toArray()))
    assert weights["a"] <= 0 and weights["b"] < 0
    right = M.monotone_logistic(rows, ["a", "b"], "y", {"a": 1, "b": -1})
    assert auc(M.probability(right, rows, "said"), "said", "y") > auc(rows, "p", "y") - 0.02


def test_boosted_quantiles_cover(rows):
    train, test = rows.where("id < 3000").select("id", "a", "b", "value"), rows.where("id >= 3000").select("id", "a", "b", "value")
    q = M.boosted_quantiles(train, test, ["a", "b"], "value", [0.1, 0.5, 0.9])
    covered, width, crossed, n = q.agg(F.avg(F.col("value").between(F.col("q_10"), F.col("q_90")).cast("int")), F.avg(F.col("q_90") - F.col("q_10")), F.count_if(F.col("q_10") > F.col("q_90")), F.count("*")).first()
    plain = R.quantiles(train, "value", [0.1, 0.9])
    assert 0.7 < covered < 0.9 and width < 0.75 * (plain[1] - plain[0]) and crossed == 0 and n == 1000


def test_boosted_quantiles_fit_counts(spark, monkeypatch):
    """Trees are fitted on rows of equal features counted once, whatever the table holds; rows without a label don't learn."""
    key, seen = F.col("id"), []
    df = spark.range(3000).select("id", (key % 7).alias("a"), (key % 5).alias("b"), (key % 7 + S.uniform(key, "u")).alias("value")).cache()
    fit = M.Pipeline.fit
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    got = M.boosted_quantiles(df, df, ["a", "b"], "value", [0.1, 0.5, 0.9], rounds=2)
    assert len(seen) == 6 and max(seen) <= 2 * 35
    assert 0.7 < got.agg(F.avg(F.col("value").between(F.col("q_10"), F.col("q_90")).cast("int"))).first()[0] < 0.9
    unlabelled = df.unionByName(df.withColumn("value", F.lit(None).cast("double")))
    again = M.boosted_quantiles(unlabelled, df, ["a", "b"], "value", [0.1, 0.5, 0.9], rounds=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_uplift_finds_who_gains(rows):
    out = M.uplift_scores(rows.select("id", "a", "b", "p", "t", "loss"), ["a", "b"], "t", "loss", F.col("id") % 4)
    for score in ("t", "dr"):
        name = "t" if score == "t" else "dr"
        gain, none = (out.where(c).agg(F.avg(name)).first()[0] for c in ("a > 0.7", "a < 0.3"))
        assert math.isfinite(gain) and gain > none


def test_quantiles_are_exact(spark, rows):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(3).exponential(size=3001)] + [1.0] * 500 + [1e9, -5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.1, 0.5, 0.77, 0.999, 1.0):
        assert abs(R.quantiles(df, "v", [q])[0] - np.quantile(values, q)) < 1e-6
    ranks = [0, 5, 1500, len(values) - 1]
    assert R.order_statistics(df, "v", ranks, most=20, cuts=7) == [sorted(values)[k] for k in ranks]
    assert R.quantiles(df.where("v is null"), "v", [0.5]) == [None]
    assert R.quantiles(df.where("v = 1"), "v", [0.3, 0.6]) == [1.0, 1.0]


def test_quantiles_of_few_groups_are_exact(spark):
    r = np.random.default_rng(5)
    groups = {0: r.normal(size=4000), 1: np.repeat(r.integers(0, 5, 40), 60) * 1.0, 2: np.array([7.5]), 3: 10.0 ** r.uniform(-8, 8, 3000)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(4, None)], "g int, v double")
    shares = [0.1, 0.5, 0.9, 0.37]
    found = R.few_group_quantiles(df, "g", "v", lambda g: shares[g], most=16, cuts=8)
    assert sorted(found) == [0, 1, 2, 3]
    for g, x in groups.items():
        assert abs(found[g] - np.quantile(x, shares[g])) <= 1e-9 * max(1.0, abs(found[g]))
