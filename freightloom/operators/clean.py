"""Cleaning: dedup, bounds, imputation and an audit of what each step touched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions.scalar import between_or_null, sentinel_or_null
from freightloom.functions.text import tidy
from freightloom.operators.ranked import quantiles
from freightloom.operators.scratch import written


class SchemaError(ValueError):
    """Columns are missing, or hold values outside their domain."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    return df


def forbid_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raises where a column that would leak the answer is present."""
    leaks = [n for n in names if n in df.columns]
    if leaks:
        raise SchemaError(f"leaking columns: {leaks}")
    return df


def outside_domain(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Rows whose value the domain lacks (null included)."""
    return df.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first in a total order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians, each by counting: no task sees a whole column."""
    return {c: quantiles(df, c, [0.5])[0] for c in columns}


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls take the column's median over the table; a flag <column>__was_missing tells. A column without values
    stays null. The rows are written first, so that what made them is computed once."""
    out = written(df)
    for c, middle in medians(out, columns).items():
        out = out.withColumn(f"{c}__was_missing", F.col(c).isNull().cast("int")).withColumn(c, F.coalesce(F.col(c), F.lit(middle).cast("double")))
    return out


def impute_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df
    for c in columns:
        out = out.withColumn(f"{c}__was_missing", F.col(c).isNull().cast("int")).withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("int"))
    return out


@dataclass
class Rules:
    """What a table's cleaning does, in this order."""

    keys: Sequence[str] = ()
    order: Sequence[str] = ()
    labels: Sequence[str] = ()
    sentinels: Mapping[str, Sequence] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    essential: Sequence[str] = ()
    medians: Sequence[str] = ()
    zeros: Sequence[str] = ()


def cleaned(df: DataFrame, rules: Rules) -> DataFrame:
    """Dedup, normal labels, sentinels and bounds to null, essential columns, imputation."""
    out = keep_first(df, rules.keys, rules.order) if rules.keys else df
    out = out.withColumns({c: tidy(F.col(c)) for c in rules.labels}) if rules.labels else out
    out = out.withColumns({c: sentinel_or_null(F.col(c), v) for c, v in rules.sentinels.items()}) if rules.sentinels else out
    out = out.withColumns({c: between_or_null(F.col(c), a, b) for c, (a, b) in rules.bounds.items()}) if rules.bounds else out
    out = drop_nulls(out, rules.essential) if rules.essential else out
    out = impute_medians(out, rules.medians) if rules.medians else out
    return impute_zero(out, rules.zeros) if rules.zeros else out


def audit(df: DataFrame, rules: Rules) -> DataFrame:
    """(step, rows_affected) of the steps before imputation, from one aggregate over the deduplicated rows."""
    whole = df.agg(F.count("*").alias("n"))
    first = keep_first(df, rules.keys, rules.order) if rules.keys else df
    counts = {f"label:{c}": F.count_if(F.col(c) != tidy(F.col(c))) for c in rules.labels}
    counts |= {f"sentinel:{c}": F.count_if(F.col(c).isin(*v)) for c, v in rules.sentinels.items()}
    counts |= {f"bounds:{c}": F.count_if(~F.col(c).between(a, b)) for c, (a, b) in rules.bounds.items()}
    row = first.agg(F.count("*").alias("kept"), *[v.alias(k) for k, v in counts.items()]).crossJoin(F.broadcast(whole))
    steps = {"duplicates": F.col("n") - F.col("kept")} | {k: F.col(f"`{k}`") for k in counts}
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), v.cast("long").alias("rows_affected")) for k, v in steps.items()])))


def stratified_test(df: DataFrame, label: str, key: Sequence[str], fraction: float, draw: Column) -> DataFrame:
    """Flags round(fraction * n) rows of each label (half to even) by smallest draw."""
    w = Window.partitionBy(label)
    n = F.row_number().over(w.orderBy(draw, *key))
    return df.withColumn("is_test", n <= F.bround(F.count("*").over(w) * F.lit(float(fraction))))
