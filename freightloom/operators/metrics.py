"""Metrics of forecasts, classifiers, intervals and policies, each one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.operators.ranked import quantiles, running


def wape(forecast: Column, actual: Column) -> Column:
    return F.sum(F.abs(forecast - actual)) / F.sum(actual)


def smape(forecast: Column, actual: Column) -> Column:
    return F.avg(2 * F.abs(forecast - actual) / F.greatest(F.abs(actual) + F.abs(forecast), F.lit(1e-9)))


def bias(forecast: Column, actual: Column) -> Column:
    return F.sum(forecast - actual) / F.sum(actual)


def pinball(forecast: Column, actual: Column, alpha: float) -> Column:
    d = actual - forecast
    return F.avg(F.greatest(alpha * d, (alpha - 1) * d))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def mae(forecast: Column, actual: Column) -> Column:
    return F.avg(F.abs(forecast - actual))


def rmse(forecast: Column, actual: Column) -> Column:
    return F.sqrt(F.avg((forecast - actual) * (forecast - actual)))


def median_ape(forecast: Column, actual: Column, floor: float = 0.25) -> Column:
    return F.percentile(F.abs(forecast - actual) / F.greatest(actual, F.lit(floor)), 0.5)


def coverage(low: Column, high: Column, actual: Column) -> Column:
    return F.avg(actual.between(low, high).cast("double"))


def confusion(df: DataFrame, actual: str, predicted: str, domain: Sequence[str]) -> DataFrame:
    """(actual, predicted, share) over the whole domain: shares of the actual class, absent pairs 0."""
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    pairs = df.sparkSession.createDataFrame([(a, p) for a in domain for p in domain], "actual string, predicted string")
    all_of = cells.groupBy("actual").agg(F.sum("n").alias("total"))
    out = pairs.join(cells, ["actual", "predicted"], "left").join(all_of, "actual", "left")
    return out.select("actual", "predicted", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"))


def class_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support): a zero denominator gives 0."""
    marks = df.select(F.inline(F.array(F.struct(F.col(actual).alias("class"), F.lit(1).alias("is_actual"), F.lit(0).alias("is_predicted"), (F.col(actual) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("is_actual"), F.lit(1).alias("is_predicted"), F.lit(0).alias("hit")))))
    s = marks.groupBy("class").agg(F.sum("hit").alias("tp"), F.sum("is_actual").alias("support"), F.sum("is_predicted").alias("flagged"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("class", ratio(F.col("tp"), F.col("flagged")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("flagged") + F.col("support")).alias("f1"), "support")


def mean_cost(df: DataFrame, actual: str, predicted: str, costs: Mapping[tuple[str, str], float]) -> DataFrame:
    """One row, `mean_cost`, under a literal matrix; a pair that it lacks costs nothing."""
    cost = F.lit(0.0)
    for (a, p), c in costs.items():
        cost = F.when((F.col(actual) == a) & (F.col(predicted) == p), c).otherwise(cost)
    return df.agg(F.avg(cost).alias("mean_cost"))


def threshold_sweep(df: DataFrame, confidence: Column, right: Column, cost: Column, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, coverage, accuracy, mean_cost) at each threshold that some row reaches.

    Rows are counted once by the largest threshold that they reach; the sweep runs over those few counts.
    """
    ts = sorted(thresholds)
    step = F.size(F.filter(F.lit(ts), lambda t: t <= confidence))
    by = df.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(right.cast("double")).alias("ok"), F.sum(cost).alias("cost"))
    all_rows = by.agg(F.sum("n").alias("total"))
    levels = df.sparkSession.createDataFrame([(k, t) for k, t in enumerate(ts, 1)], "level int, threshold double")
    met = levels.join(F.broadcast(by), F.col("step") >= F.col("level")).groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("cost").alias("cost"))
    return met.crossJoin(F.broadcast(all_rows)).select("threshold", (F.col("n") / F.col("total")).alias("coverage"), (F.col("ok") / F.col("n")).alias("accuracy"), (F.col("cost") / F.col("n")).alias("mean_cost"))


def calibration(df: DataFrame, p: str, y: Column, n: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate) over quantile bins of p; empty bins are absent."""
    edges = F.lit([x for x in quantiles(df, p, [k / n for k in range(1, n)]) if x is not None])
    binned = df.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(p))).cast("long"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y.cast("double")).alias("rate"))


def conformal_threshold(df: DataFrame, score: str, positive: Column, alpha: float) -> DataFrame:
    """One row, `threshold`: the k-th smallest score of the positives, k = floor((n + 1) * alpha - 1) counted from 0;
    minus infinity where k is negative."""
    hits = df.where(positive).select(score)
    k = hits.agg(F.floor((F.count("*") + 1) * F.lit(alpha) - 1).alias("_k"))
    found = running(hits, [F.col(score)]).crossJoin(F.broadcast(k)).where(F.col("rank") == F.col("_k") + 1).select(F.col(score).alias("threshold"))
    return k.join(F.broadcast(found), how="left").select(F.coalesce("threshold", F.lit(float("-inf"))).alias("threshold"))


def interval_widening(df: DataFrame, low: str, high: str, actual: str, level: float) -> DataFrame:
    """One row, `widening`: the ceil((n + 1) * level)-th smallest of max(low - y, y - high), the largest if there are fewer."""
    s = df.select(F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high)).alias("widening"))
    k = s.agg(F.least(F.ceil((F.count("*") + 1) * F.lit(level)), F.count("*")).alias("_k"))
    return running(s, [F.col("widening")]).crossJoin(F.broadcast(k)).where(F.col("rank") == F.col("_k")).select("widening")
