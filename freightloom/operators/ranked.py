"""Ranked tables: deciles, lift, thresholds, top fractions and curves, without a global sort in one task.

A global rank is built from a range partitioning: rows are sorted within ranges and written with their places, and
each range starts where the counts of the ranges before it end. Only the counts of the ranges (as many as partitions)
meet in one place. The rows are written because a range partitioning samples its bounds: computed a second time it
may cut elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.operators.scratch import written


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column] | None = None, rank: str = "rank", keep: Sequence[str] | None = None) -> DataFrame:
    """All rows with a long `rank` (from 1) in a total order, and running sums up to the row, itself included. Of the
    columns those in `keep` (default: all) are written and returned."""
    sums = sums or {}
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = laid.select(*(df.columns if keep is None else keep), *[v.alias(f"_v_{k}") for k, v in sums.items()]).withColumns({"_id": F.monotonically_increasing_id()})
    # The upper bits of the id are the range, the lower 33 the place in it.
    rows = written(laid).withColumn("_part", F.shiftright("_id", 33))
    bases = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_n", *[f"_s_{k}" for k in sums]]])
    inner = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(f"_v_{k}").over(inner) for k in sums}) if sums else rows
    out = rows.join(F.broadcast(bases), "_part")  # a row for each partition
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumns({rank: place + F.col("_n")} | {k: F.col(k) + F.col(f"_s_{k}") for k in sums}).drop("_part", "_id", "_n", *[x for k in sums for x in (f"_v_{k}", f"_s_{k}")])


def deciles(df: DataFrame, order: Sequence[Column], n: int = 10, keep: Sequence[str] | None = None) -> DataFrame:
    """All rows with `decile`: ceil(rank / rows * n); of the columns those in `keep` (default: all)."""
    ranked = running(df, order, keep=keep)
    size = ranked.agg(F.max("rank").alias("_all"))
    return ranked.crossJoin(F.broadcast(size)).withColumn("decile", F.ceil(F.col("rank") / F.col("_all") * n).cast("long")).drop("_all", "rank")


def lift(df: DataFrame, order: Sequence[Column], label: Column, n: int = 10) -> DataFrame:
    """(decile, n, positives, rate, lift, capture): lift against the base rate, capture cumulative."""
    by = deciles(df.withColumn("_y", label.cast("double")), order, n, ["_y"]).groupBy("decile").agg(F.count("*").alias("n"), F.sum("_y").alias("positives"))
    every = Window.partitionBy()  # of n rows
    base = F.sum("positives").over(every) / F.sum("n").over(every)
    so_far = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("decile", "n", "positives", (F.col("positives") / F.col("n")).alias("rate"), (F.col("positives") / F.col("n") / base).alias("lift"), (F.sum("positives").over(so_far) / F.sum("positives").over(every)).alias("capture"))


def top_fraction(df: DataFrame, order: Sequence[Column], fraction: float) -> DataFrame:
    """The first bround(fraction * rows) rows, one at least."""
    size = df.agg(F.greatest(F.bround(F.count("*") * F.lit(float(fraction))), F.lit(1)).alias("_k"))
    return running(df, order).crossJoin(F.broadcast(size)).where("rank <= _k").drop("_k")


def tie_curve(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(score, n, positives, cum_n, cum_positives) by descending score: one row for each distinct score.

    Rows are summed by score first, so what is ranked is no more than the distinct scores.
    """
    by = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(label.cast("long")).alias("positives"))
    return running(by, [F.desc("score")], {"cum_n": F.col("n"), "cum_positives": F.col("positives")}).drop("rank")


def roc_auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row, `auc`: the share of (positive, negative) pairs in order, ties half."""
    curve = tie_curve(df, score, label)
    p, n = F.col("positives"), F.col("n") - F.col("positives")
    above = F.col("cum_positives") - p
    pairs = F.sum(n * (above + p / 2.0))
    return curve.agg((pairs / (F.sum(p).cast("double") * F.sum(n))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row, `ap`: precision at the end of each tie, weighted by the recall gained there."""
    curve = tie_curve(df, score, label)
    return curve.agg((F.sum(F.col("positives") * F.col("cum_positives") / F.col("cum_n")) / F.sum("positives")).alias("ap"))


def lowest_threshold(df: DataFrame, score: str, label: Column, precision: float, default: float = 0.99) -> DataFrame:
    """One row: `threshold`, the lowest score down to which precision is reached, else `default`; and `coverage`."""
    curve = tie_curve(df, score, label)
    good = F.col("cum_positives") / F.col("cum_n") >= precision
    return curve.agg(F.coalesce(F.min(F.when(good, F.col("score"))), F.lit(default)).alias("threshold"), (F.coalesce(F.max(F.when(good, F.col("cum_n"))), F.lit(0)) / F.sum("n")).alias("coverage"))


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int], most: int = 1 << 18, cuts: int = 1 << 10, laid: bool = False) -> list[float]:
    """The values at the ranks (from 0) among the non-null values in ascending order; ranks must exist.

    The ranges of values that hold the ranks are cut into `cuts` equal parts, counted in one aggregate for all of them, until
    a part has `most` values at most, or a single one; only those are sorted, each in one place. Equal values are one. No
    copy is made of a table that is `laid`: a written one, or columns of a given one that cost little to read again.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(v.alias("v"))
    found: dict[int, float] = {}
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if n > most and not laid:
        rows = written(rows)  # read once for each level
    parts = [(low, high, 0, n, sorted(set(ranks)))]  # values from low to high, with the count of those below and inside
    while parts:
        found |= {k: a for a, b, _, _, inside in parts if a == b for k in inside}
        few, many = ([p for p in parts if p[0] < p[1] and (p[3] <= most) == small] for small in (True, False))
        parts = []
        if few:
            wanted = F.get(F.lit([[k - below for k in inside] for _, _, below, _, inside in few]), F.col("p"))
            lists = _in_parts(rows, few).groupBy("p").agg(F.sort_array(F.collect_list("v")).alias("s"))
            for p, values in lists.select("p", F.transform(wanted, lambda k: F.get("s", k))).collect():
                found |= dict(zip(few[p][4], values))
        if many:
            low, width = (F.get(F.lit(x), F.col("p")) for x in ([p[0] for p in many], [(p[1] - p[0]) / cuts for p in many]))
            cell = F.when(width > 0, F.least(F.floor((F.col("v") - low) / width), F.lit(cuts - 1))).otherwise((F.col("v") > low).cast("long"))
            below = [p[2] for p in many]
            for p, _, a, b, n in sorted(map(tuple, _in_parts(rows, many).groupBy("p", cell.alias("c")).agg(F.min("v"), F.max("v"), F.count("*")).collect())):
                if inside := [k for k in many[p][4] if below[p] <= k < below[p] + n]:
                    parts.append((a, b, below[p], n, inside))
                below[p] += n
    return [found[k] for k in ranks]


def _in_parts(rows: DataFrame, parts: Sequence[tuple]) -> DataFrame:
    """The rows whose `v` lies in a part, with its place `p` in the list; parts don't overlap."""
    own = reduce(lambda x, p: F.when(F.col("v").between(p[1][0], p[1][1]), p[0]).otherwise(x), enumerate(parts), F.lit(-1))
    return rows.withColumn("p", own).where("p >= 0")


def quantiles(df: DataFrame, value: str, qs: Sequence[float], laid: bool = False) -> list[float | None]:
    """Exact quantiles with linear interpolation, null where there is no value. No task sees more than a bounded
    number of values. Infinite values are not supported. `laid` as in `order_statistics`."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return [None] * len(qs)
    at = [(n - 1) * q for q in qs]
    ranks = sorted({k for x in at for k in (math.floor(x), math.ceil(x))})
    by = dict(zip(ranks, order_statistics(df, value, ranks, laid=laid)))
    low, high = [by[math.floor(x)] for x in at], [by[math.ceil(x)] for x in at]
    return [a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, at)]


def quantile_edges(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """One row (q1, q2, ...) of `quantiles`."""
    names = ", ".join(f"q{k} double" for k in range(1, len(qs) + 1))
    return df.sparkSession.createDataFrame([tuple(quantiles(df, value, qs))], names)


def few_group_quantiles(df: DataFrame, key: str, value: str, share: Callable[[int], float], most: int = 1 << 14, cuts: int = 1 << 11, ends: DataFrame | None = None) -> dict[int, float]:
    """For each of few groups, numbered from 0, the exact quantile of its own share with linear interpolation; groups
    without a value are left out. `df` is read a few times, so it should be written. `ends` has (group, count, least, largest)
    of the groups' values, where they are known without reading `df`. Infinite values aren't supported.

    All groups are narrowed together: one aggregate cuts the range of values that holds a group's wanted ranks into `cuts`
    parts, until it has `most` values at most, or a single one. The driver sees groups * (cuts or most) rows; nothing is sorted.
    """
    rows = df.select(F.col(key).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = rows.groupBy("g").agg(F.count("*"), F.min("v"), F.max("v")) if ends is None else ends
    sizes: dict[int, float] = {}
    found: dict[tuple[int, int], float] = {}
    ranges = {}  # for each group values from low to high, with the count of those below and inside, and the ranks wanted
    for g, n, low, high in ends.collect():
        at = sizes[g] = (n - 1) * share(g)
        inside = sorted({math.floor(at), math.ceil(at)})
        if low == high:
            found |= {(g, k): low for k in inside}
        else:
            ranges[g] = (low, high, 0, n, inside)
    while ranges:
        listed = lambda of, kind: F.get(F.lit([of(*ranges[g]) if g in ranges else None for g in range(max(ranges) + 1)]).cast(f"array<{kind}>"), F.col("g"))  # noqa: B023, E731
        low, high = listed(lambda a, *_: a, "double"), listed(lambda a, b, *_: b, "double")
        small, last = listed(lambda a, b, below, n, _: n <= most, "boolean"), listed(lambda a, b, below, n, _: min(cuts, math.isqrt(n) + 1) - 1.0, "double")
        part = rows.select("g", "v", low.alias("a"), high.alias("b"), small.alias("small"), last.alias("last")).where("v BETWEEN a AND b")
        # A small range is told value by value, a large one by parts, no more than the root of its count.
        width = (F.col("b") - F.col("a")) / (F.col("last") + 1)
        cell = F.when(F.col("small"), F.col("v")).when(width > 0, F.least(F.floor((F.col("v") - F.col("a")) / width).cast("double"), F.col("last"))).otherwise((F.col("v") > F.col("a")).cast("double"))
        told = part.groupBy("g", cell.alias("c")).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n")).toArrow()
        after, below = {}, {g: r[2] for g, r in ranges.items()}
        for g, _, a, b, n in sorted(zip(*[c.to_pylist() for c in told.columns])):
            first, end = below[g], below[g] + n - 1
            inside = [k for k in ranges[g][4] if first <= k <= end]
            # The ends of a part are known, so two ranks are never left in two parts.
            found |= {(g, k): a if k == first else b for k in inside if a == b or k in (first, end)}
            if inside := [k for k in inside if (g, k) not in found]:
                after[g] = (a, b, first, n, inside)
            below[g] += n
        ranges = after
    both = {g: (found[g, math.floor(at)], found[g, math.ceil(at)]) for g, at in sizes.items()}
    return {g: a + (b - a) * (sizes[g] - math.floor(sizes[g])) for g, (a, b) in both.items()}


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys, names): exact quantiles with linear interpolation of each group's values that aren't null, for all groups
    and shares at once; a group of nulls alone has nulls.

    Rows are counted by group and value, those counts ranked by group and value in ranges of any size, and a group's rows
    may lie in many ranges: no task holds a group. The counts at a share's place are found by their running sums.
    """
    v = F.col(value).cast("double")
    groups = df.select(*keys).distinct()
    by = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_k"))
    run = running(by, [*[F.col(k).asc_nulls_first() for k in keys], F.asc("_v")], {"_upto": F.col("_k")})
    ends = run.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_k")).alias("_base"), F.sum("_k").alias("_n"))
    ends = ends.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_base", "_n")
    placed = run.join(ends, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]))
    upto, below = F.col("_upto") - F.col("_base"), F.col("_upto") - F.col("_base") - F.col("_k")
    at = [(F.col("_n") - 1) * float(q) for q in qs]
    holds = lambda place: F.max(F.when((below <= place) & (place < upto), F.col("_v")))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[x for k, a in enumerate(at) for x in (holds(F.floor(a)).alias(f"_lo{k}"), holds(F.ceil(a)).alias(f"_hi{k}"))])
    part = lambda k: F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (at[k] - F.floor(at[k]))
    found = found.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[part(k).alias(n) for k, n in enumerate(names)])
    return groups.join(found, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]), "left").select(*keys, *names)
