"""Deterministic made rows over given keys: every draw is an md5 uniform of the key and a name, so a row is the same
however the keys are split, and in any engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions.scalar import clipped, sigmoid, uniform


def chosen(key: Column, salt: str, options: Mapping[str, float]) -> Column:
    """One of the options by its weight."""
    total, bound, out = sum(options.values()), 1.0, None
    for name, weight in reversed(options.items()):
        out = F.lit(name) if out is None else F.when(uniform(key, salt) < bound, name).otherwise(out)
        bound -= weight / total
    return out


def ramp(value: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between, flat outside."""
    return clipped((value - low) / (high - low), 0.0, 1.0)


def pseudo_normal(key: Column, salt: str, n: int = 6) -> Column:
    """A sum of uniforms, scaled to mean 0 and variance 1: within a few hundredths of a normal, without logs or roots."""
    total = F.lit(0.0)
    for k in range(n):
        total = total + uniform(key, f"{salt}{k}")
    return (total - n / 2) * (12.0 / n) ** 0.5


def shipments(keys: DataFrame, key: str) -> DataFrame:
    """(key, distance, handoffs, promised_days, risk, missed): a logistic risk and a label drawn from it."""
    k = F.col(key)
    df = keys.select(key, (50 + 1950 * uniform(k, "distance")).alias("distance"), F.floor(1 + 4 * uniform(k, "handoffs")).alias("handoffs"), F.floor(1 + 5 * uniform(k, "promise")).alias("promised_days"))
    risk = sigmoid(-3.2 + 0.0011 * F.col("distance") + 0.45 * F.col("handoffs") - 0.3 * F.col("promised_days"))
    return df.withColumn("risk", risk).withColumn("missed", (uniform(k, "miss") < F.col("risk")).cast("int"))


def transit(keys: DataFrame, key: str) -> DataFrame:
    """(key, service, distance, days): days spread wider for the slower service."""
    k = F.col(key)
    df = keys.select(key, F.when(uniform(k, "service") < 0.3, "express").otherwise("ground").alias("service"), (50 + 1950 * uniform(k, "distance")).alias("distance"))
    spread = F.when(F.col("service") == "express", 0.2).otherwise(0.6)
    return df.withColumn("days", F.greatest(F.lit(0.25), 0.8 + F.col("distance") / F.when(F.col("service") == "express", 900.0).otherwise(500.0) + spread * pseudo_normal(k, "noise")))


def defects(df: DataFrame, key: str, value: str, label: str, twice: float = 0.02, absent: float = 0.03, wild: float = 0.02) -> DataFrame:
    """Some rows twice, some values absent or sentinel, some labels in another case."""
    k = F.col(key)
    hit = uniform(k, "mess")
    out = df.withColumn(value, F.when(hit < absent, F.lit(None)).when(hit < absent + wild, F.lit(9999.0)).otherwise(F.col(value)))
    out = out.withColumn(label, F.when(uniform(k, "case") < 0.1, F.concat(F.lit(" "), F.upper(label))).otherwise(F.col(label)))
    return out.unionByName(out.where(uniform(k, "twice") < twice))


def random_walk(df: DataFrame, keys: Sequence[str], day: str, key: Column, step: float) -> DataFrame:
    """`level`: a walk along the days of each key, from 100."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("level", 100 + F.sum((uniform(key, "walk") - 0.5) * step).over(w))
