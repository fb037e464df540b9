"""Windows over panels: calendars with gaps, lags, trailing statistics, runs and episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_calendar(df: DataFrame, keys: Sequence[str], day: str, step: str = "1 day") -> DataFrame:
    """Absent days between the table's first and last day, for each key, as rows of nulls."""
    ends = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = df.select(*keys).distinct().crossJoin(F.broadcast(ends)).select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(day))
    return days.join(df, [*keys, day], "left")


def calendar_lag(df: DataFrame, keys: Sequence[str], day: str, value: str, n: int, name: str | None = None) -> DataFrame:
    """The value n days before, by the calendar: null where that day is absent. One row for each key and day."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-n, -n)
    return df.withColumn(name or f"{value}_lag_{n}", F.max(value).over(w))


def trailing_mean(df: DataFrame, keys: Sequence[str], day: str, value: str, n: int, least: int, name: str) -> DataFrame:
    """Mean of the n calendar days before (not the day itself); null under `least` values."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-n, -1)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def rolling(keys: Sequence[str], order: Sequence[str], n: int):
    """The window of the last n rows, this one included."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


def rolling_mean(value: Column, keys: Sequence[str], order: Sequence[str], n: int) -> Column:
    """Null unless all n rows have a value."""
    w = rolling(keys, order, n)
    return F.when(F.count(value).over(w) >= n, F.avg(value).over(w))


def rolling_slope(value: Column, position: Column, keys: Sequence[str], order: Sequence[str], n: int) -> Column:
    """Least-squares slope against the row's position over the last n rows."""
    w = rolling(keys, order, n)
    top = F.avg(position * value).over(w) - F.avg(position).over(w) * F.avg(value).over(w)
    return F.when(F.count(value).over(w) >= n, top / ((n * n - 1) / 12.0))


def centred_median(value: str, keys: Sequence[str], order: Sequence[str], half: int, least: int) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w))


def frozen(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """Flags rows of a run of n or more equal values, from its first row on."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0))
    runs = df.withColumn("_run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(value).over(Window.partitionBy(*keys, "_run"))
    return runs.withColumn("is_frozen", size >= n).drop("_run")


def interpolated(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Nulls by straight lines between neighbours, by row position; ends take the nearest value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    here = here.withColumns({"_a": F.last(at, True).over(back), "_b": F.first(at, True).over(ahead)})
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / F.greatest(b["i"] - a["i"], F.lit(1))
    return here.withColumn(value, F.coalesce(F.col(value), line, a["v"], b["v"])).drop("_i", "_a", "_b")


def causal_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], outcome: Column, prefix: str) -> DataFrame:
    """Rows and mean outcome strictly before this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(w)
    return df.withColumns({f"{prefix}_count": n, f"{prefix}_rate": F.when(n > 0, F.sum(outcome).over(w) / n).otherwise(0.0)})


def event_ahead(df: DataFrame, keys: Sequence[str], day: str, flag: str, n: int, name: str) -> DataFrame:
    """1 where the flag is set on one of the next n days, by the calendar."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(1, n)
    return df.withColumn(name, F.coalesce(F.max(flag).over(w), F.lit(0)))


def episodes(df: DataFrame, keys: Sequence[str], day: str, gap: int) -> DataFrame:
    """(keys, first_day, last_day, n_alarms): alarms no more than `gap` days after the one before are one episode."""
    w = Window.partitionBy(*keys).orderBy(day)
    opens = F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > gap).cast("int"), F.lit(1))
    cut = df.withColumn("_e", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*keys, "_e").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_alarms")).drop("_e")
