"""Joins beyond plain equality: checked, as-of, look-back, nearest, blocked candidates, grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.operators.ranked import running
from freightloom.operators.scratch import written


#: Rows of both sides together that a task of a join by near keys or a part of a neighbours' search holds, about.
PART = 500_000


def checked_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that raises, when it runs, where a key has more than one row on the right."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    one = right.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("more than one row for a key")).cast("boolean"))).where("_ok").drop("_n", "_ok")
    return left.join(one, list(keys), "left")


def asof_after(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str) -> DataFrame:
    """Each left row with the earliest `when` of its key at or after `at` (null if none).

    Both sides go into one ordered window, so no pair of rows is ever formed.
    """
    a = left.withColumns({"_t": F.col(at), "_when": F.lit(None).cast(right.schema[when].dataType), "_left": F.lit(True)})
    b = right.select(*keys, F.col(when).alias("_t"), F.col(when).alias("_when"), F.lit(False).alias("_left"))
    w = Window.partitionBy(*keys).orderBy("_t", F.desc("_left")).rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(when, F.first("_when", True).over(w))
    return both.where("_left").drop("_t", "_when", "_left")


def lookback_first(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, low: int, high: int) -> DataFrame:
    """Each left row with the earliest day `when` of its key in [at - high, at - low] days (null if none).

    A day of the right falls into few buckets of a left row's reach, so the join is by equality of buckets.
    """
    span = high - low + 1
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    reach = F.array_distinct(F.array(F.floor((day(at) - high) / span), F.floor((day(at) - low) / span)))
    a = left.withColumn("_id", F.struct(*left.columns)).withColumn("_b", F.explode(reach))
    b = right.select(*keys, F.col(when).alias("_when"), F.floor(day(when) / span).alias("_b")).distinct()
    met = a.join(b, [*keys, "_b"], "left")
    gap = F.datediff(F.col(at), F.col("_when"))
    return met.groupBy("_id").agg(F.min(F.when(gap.between(low, high), F.col("_when"))).alias(when)).select("_id.*", when)


def candidates(left: DataFrame, right: DataFrame, blocks: Sequence[tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) that agree in one of the blocking keys, given as (left key, right key)."""
    keyed = lambda df, i, k: df.select(F.col(i), F.inline(F.array(*[F.struct(F.lit(n).alias("_n"), key.cast("string").alias("_k")) for n, key in enumerate(k)])))
    a = keyed(left, left_id, [x for x, _ in blocks]).where(F.col("_k").isNotNull())
    b = keyed(right, right_id, [y for _, y in blocks]).where(F.col("_k").isNotNull())
    return a.join(b, ["_n", "_k"]).select(left_id, right_id).distinct()


def best_match(pairs: DataFrame, left_id: str, score: str, order: Sequence[Column]) -> DataFrame:
    """The best-scored pair of each left row, ties by `order`."""
    n = F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc(score), *order))
    return pairs.withColumn("_n", n).where("_n = 1").drop("_n")


def with_grid(df: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    """Each row once for each value of a literal grid."""
    return df.withColumn(name, F.explode(F.lit([float(v) for v in values])))


def near_keys(text: Column) -> Column:
    """The text and what is left of it without one of its characters: texts one slip apart (a character lost, added or
    misread, two neighbours swapped) share one, and a key is shared by few others, however many texts there are."""
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))).otherwise(F.array().cast("array<string>"))))


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: Column, right_text: Column, same: Sequence[tuple[Column, Column]] = (), gap: tuple[Column, Column] | None = None) -> DataFrame:
    """Distinct (left_id, right_id) whose texts share one of `near_keys` and whose columns in `same` are equal; with `gap`
    also the edit distance of its two columns, of which an id has one value.

    A row has as many keys as characters. Spark estimates the sides as if it had one and would send millions of keys to
    all executors by way of the driver, so both sides are dealt by key into parts of about `PART` keys and merged.
    """
    keyed = lambda df, i, t, more, g: df.select(F.col(i), *[c.alias(f"_s{k}") for k, c in enumerate(more)], *([g.alias(f"_g_{i}")] if gap else []), F.explode(near_keys(t)).alias("_k"))
    n = sum(df.agg(F.sum(F.length(t) + 1)).first()[0] or 0 for df, t in ((left, left_text), (right, right_text)))
    by, parts = ["_k", *[f"_s{k}" for k in range(len(same))]], max(1, math.ceil(n / PART))
    a = keyed(left, left_id, left_text, [x for x, _ in same], gap and gap[0]).repartition(parts, *by)
    b = keyed(right, right_id, right_text, [y for _, y in same], gap and gap[1]).repartition(parts, *by)
    far = [F.levenshtein(f"_g_{left_id}", f"_g_{right_id}").cast("long").alias("gap")] if gap else []
    return a.join(b.hint("merge"), by).select(left_id, right_id, *far).distinct()


def cells(points: DataFrame, key: str, x: str, y: str, size: int) -> tuple[DataFrame, list[tuple]]:
    """Points (key, x, y, strip, cell), written, in cells of `size` to 2 * `size` points (fewer only if there are not so
    many), and the strips' (number, least x, largest x) in order: cut at equal counts by x into strips, whose number grows
    as the square root of the points', and those by y into cells."""
    plain = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = running(plain, [F.col("x"), F.col("y"), F.col("key")], rank="_rank")
    n = ranked.count()
    strips = max(1, n // max(1, math.ceil(math.sqrt(n * size))))
    laid = ranked.select("key", "x", "y", F.floor((F.col("_rank") - 1) * strips / max(n, 1)).alias("strip"))
    laid = running(laid, [F.col("strip"), F.col("y"), F.col("x"), F.col("key")], rank="_place")
    by = laid.groupBy("strip").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    bounds = sorted(tuple(r) for r in by.select("strip", "x0", "x1").collect())
    of_strip = F.greatest(F.lit(1), F.floor(F.col("_n") / size))
    cell = F.col("strip") * (1 << 31) + F.floor((F.col("_place") - F.col("_first")) * of_strip / F.col("_n"))
    return written(laid.join(F.broadcast(by.select("strip", "_first", "_n")), "strip").select("key", "x", "y", "strip", cell.alias("cell"))), bounds


def nearest(points: DataFrame, key: str, x: str, y: str, k: int, size: int = 128) -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest other points, ties by key, exactly. Points without a place (null or
    NaN) take no part.

    Points lie in cells of bounded numbers. A place's own cell tells how far its k nearest are at most; only cells whose
    box is within that reach are looked into. Of points at one place the k + 1 first by key are candidates, and a place is
    looked up once, so that very many points at one place don't meet each other.
    """
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = written(points.where(sound(x) & sound(y)).select(F.col(key).alias("key"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y")))
    at_place = Window.partitionBy("x", "y").orderBy("key")
    few = rows.withColumn("_n", F.row_number().over(at_place)).where(F.col("_n") <= k + 1).drop("_n")
    laid, strips = cells(few, "key", "x", "y", max(size, k + 2))
    far = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    others = laid.select(F.col("key").alias("neighbour"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cell", "strip")

    def within(cell: pa.Table) -> pa.Table:
        """For each place of a cell how far its (k + 1)-th nearest candidate there is, itself among them."""
        x, y = np.asarray(cell.column("x")), np.asarray(cell.column("y"))
        at = np.unique(np.stack([x, y], 1), axis=0)
        reach = np.full(len(at), np.inf)
        if len(x) > k:
            with np.errstate(invalid="ignore"):
                reach = np.sort(np.sqrt((at[:, :1] - x) ** 2 + (at[:, 1:] - y) ** 2), axis=1)[:, k] * (1 + 1e-12)
        return pa.table([at[:, 0], at[:, 1], pa.repeat(cell.column("cell")[0], len(at)), reach], names=["x", "y", "cell", "reach"])

    # A place whose points lie in two cells takes the nearer bound.
    places = laid.select("x", "y", "cell").groupBy("cell").applyInArrow(within, "x double, y double, cell long, reach double")
    places = written(places.groupBy("x", "y").agg(F.min(F.struct("reach", "cell")).alias("c")).select("x", "y", "c.cell", "c.reach"))
    reaches = places.groupBy("cell").agg(F.min(F.col("x") - F.col("reach")).alias("x0"), F.max(F.col("x") + F.col("reach")).alias("x1"), F.min(F.col("y") - F.col("reach")).alias("y0"), F.max(F.col("y") + F.col("reach")).alias("y1"))
    low, high = np.array([s[1] for s in strips]), np.array([s[2] for s in strips])

    def over_strips(batches):
        """Each cell's reach once for each strip that it touches; strips are in order of x."""
        for batch in batches:
            x0, x1 = np.asarray(batch.column("x0")), np.asarray(batch.column("x1"))
            first, last = np.searchsorted(high, x0, "left"), np.searchsorted(low, x1, "right")
            times = np.maximum(last - first, 0)
            take = np.repeat(np.arange(batch.num_rows), times)
            strip = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([part.column("cell"), pa.array(strip), part.column("y0"), part.column("y1")], names=["cell", "strip", "y0", "y1"])

    asked = reaches.mapInArrow(over_strips, "cell long, strip long, y0 double, y1 double")
    boxes = others.groupBy("strip", "cell").agg(F.min("x2").alias("bx0"), F.max("x2").alias("bx1"), F.min("y2").alias("by0"), F.max("y2").alias("by1"))

    def touching(left: pa.Table, right: pa.Table) -> pa.Table:
        """In a strip the cells are in order of y: those that a reach touches are a run."""
        right = right.sort_by("cell")
        y0, y1 = np.asarray(right.column("by0")), np.asarray(right.column("by1"))
        first, last = np.searchsorted(y1, np.asarray(left.column("y0")), "left"), np.searchsorted(y0, np.asarray(left.column("y1")), "right")
        times = np.maximum(last - first, 0)
        own = left.column("cell").take(pa.array(np.repeat(np.arange(left.num_rows), times)))
        met = right.take(pa.array(np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)))
        return pa.table([own, met.column("cell"), *[met.column(c) for c in ("bx0", "bx1", "by0", "by1")]], names=["cell", "met", "bx0", "bx1", "by0", "by1"])

    pairs = asked.groupBy("strip").cogroup(boxes.groupBy("strip")).applyInArrow(touching, "cell long, met long, bx0 double, bx1 double, by0 double, by1 double")
    beside = lambda at, a, b: F.greatest(F.col(a) - F.col(at), F.col(at) - F.col(b), F.lit(0.0))
    # Few cells become many rows here, which Spark doesn't foresee: they are dealt by count, before and after.
    parts = max(1, math.ceil(places.count() * 64 / PART))
    touched = places.join(pairs.repartition(parts, "cell", "met"), "cell").where(F.sqrt(beside("x", "bx0", "bx1") ** 2 + beside("y", "by0", "by1") ** 2) <= F.col("reach")).select("x", "y", "reach", F.col("met").alias("cell"))
    best = Window.partitionBy("x", "y").orderBy("distance", "neighbour")
    # What is beyond the reach is none of the k nearest, and is most of a cell: it goes before anything is sorted.
    near = touched.join(others, "cell").select("x", "y", "reach", "neighbour", far.alias("distance")).where(F.isnan("distance") | (F.col("distance") <= F.col("reach")))
    found = near.drop("reach").repartition(parts, "x", "y").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    ranked = rows.join(found, ["x", "y"]).where(F.col("key") != F.col("neighbour"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key", "x", "y").orderBy("distance", "neighbour"))).where(F.col("rank") <= k).select("key", "neighbour", "distance", "rank")
