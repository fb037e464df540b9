"""Decisions: allocation under a budget, prices on a grid, bookings, targeting, uplift curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightloom.operators.ranked import running
from freightloom.operators.scan import carried
from freightloom.operators.scratch import written


def best_action(df: DataFrame, key: str, p: Column, stake: Column, actions: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Each row with the action of the largest expected saving, as (action, cost, saving).

    An action is (cost, share of the risk that it removes); its saving is p * share * stake - cost. Ties go to the
    first action; a row that no action pays for has `none`.
    """
    options = F.array(
        F.struct(F.lit(0.0).alias("saving"), F.lit(0).alias("order"), F.lit("none").alias("action"), F.lit(0.0).alias("cost")),
        *[F.struct((p * share * stake - cost).alias("saving"), F.lit(-k).alias("order"), F.lit(name).alias("action"), F.lit(float(cost)).alias("cost")) for k, (name, (cost, share)) in enumerate(actions.items(), 1)],
    )
    return df.withColumn("_best", F.array_max(options)).select(*df.columns, F.col("_best.action").alias("action"), F.col("_best.cost").alias("cost"), F.col("_best.saving").alias("saving"))


def within_budget(df: DataFrame, order: Sequence[Column], cost: str, budget: float) -> DataFrame:
    """Rows in order until the first that doesn't fit."""
    return running(df, order, {"spent": F.col(cost)}).where(F.col("spent") <= budget)


def greedy_fill(df: DataFrame, order: Sequence[Column], cost: str, budget: float, parts: int = 1024) -> DataFrame:
    """Rows in order; one that doesn't fit is passed over and the scan goes on. Rows without a cost are never taken, costs
    may not be negative (ValueError).

    The money left only falls, so a cost that doesn't fit once never fits again, and costs close one after the other, from
    the largest down. While none closes, all rows of open costs are taken: where the largest open one closes follows from
    sums alone. The place is searched by sums over `parts` ranges of ranks at a time, which come to the driver. The ranked
    rows are written once; passes are as many as costs that close while there are rows left.
    """
    ranked = running(df.withColumn("_cost", F.col(cost).cast("double")), order, rank="_rank")
    c, rank = F.col("_cost"), F.col("_rank")
    n, least = ranked.agg(F.count("*"), F.min(c)).first()
    if (least or 0.0) < 0:
        raise ValueError("costs may not be negative")
    left, at, phases = float(budget), 0, []  # (what is left, the rank up to which costs of that much are taken)
    while True:
        rest = ranked.where((rank > at) & (c <= left))
        largest = rest.agg(F.max(c)).first()[0]
        found = None if largest is None else _passed(rest, rank, c, at, n, left - largest, parts)
        if found is None:
            phases.append((left, n))
            break
        phases.append((left, found[0]))
        at, left = found[0], left - found[1]

    def until(some: list[tuple[float, int]]) -> Column:
        """The last rank at which a row's cost is still open."""
        half = len(some) // 2
        return F.when(c > some[half][0], until(some[:half])).otherwise(until(some[half:])) if half else F.lit(some[0][1])

    return ranked.where((c <= float(budget)) & (rank <= until(phases))).select(*df.columns)


def _passed(rows: DataFrame, rank: Column, value: Column, low: int, high: int, limit: float, parts: int) -> tuple[int, float] | None:
    """The first rank at which the running sum of the values, which aren't negative, is over the limit, and that sum; None
    if there is none. Each pass adds up at most `parts` ranges of ranks, and looks into one of them next."""
    before = 0.0
    while True:
        width = -(-(high - low) // parts)
        k = F.floor((rank - low - 1) / width)
        for r in rows.where((rank > low) & (rank <= high)).groupBy(k.alias("k")).agg(F.sum(value).alias("s")).orderBy("k").collect():
            if before + r["s"] > limit:
                break
            before += r["s"]
        else:
            return None
        low += r["k"] * width
        if width == 1:
            return low + 1, before + r["s"]
        high = min(high, low + width)


def best_price(df: DataFrame, price: Column, margin: Column, grid: str, keys: Sequence[str]) -> DataFrame:
    """The price of the largest margin on each row's grid; ties to the lower price."""
    best = F.max(F.struct(margin.alias("margin"), (-price).alias("low")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.low")).alias("price"), F.col("_b.margin").alias("margin"))


def booking_costs(demand: Column, booked: Column, unit: float, spot: float, salvage: float) -> dict[str, Column]:
    """What a booking costs once demand is known: committed, bought on the spot, minus what unused units bring."""
    short = F.greatest(demand - booked, F.lit(0.0))
    spare = F.greatest(booked - demand, F.lit(0.0))
    return {"committed": booked * unit, "spot": short * spot, "salvage": spare * salvage, "total": booked * unit + short * spot - spare * salvage}


def uplift_curve(df: DataFrame, order: Sequence[Column], treated: Column, outcome: Column) -> DataFrame:
    """(rank, gain): targeted rows times the difference of the arms' outcome rates so far; 0 while an arm is empty."""
    t, y = treated.cast("long"), outcome.cast("long")
    return gains(running(df, order, {"nt": t, "yt": t * y, "nc": 1 - t, "yc": (1 - t) * y}))


def gains(ranked: DataFrame) -> DataFrame:
    """The curve of ranked rows that hold so far nt treated ones, yt of them with the outcome, and nc and yc of the others."""
    gain = F.when((F.col("nt") > 0) & (F.col("nc") > 0), F.col("rank") * (F.try_divide(F.col("yc"), F.col("nc")) - F.try_divide(F.col("yt"), F.col("nt")))).otherwise(0.0)
    return ranked.select("rank", gain.alias("gain"))


def area_over_diagonal(curve: DataFrame) -> DataFrame:
    """One row, `area`: trapezoids between the curve and the line to its end, over the share of rows."""
    ends = curve.agg(F.max("rank").alias("_n"), F.max_by("gain", "rank").alias("_last"))
    # Each trapezoid has half of both its ends: every point counts once, the last half.
    return curve.crossJoin(F.broadcast(ends)).groupBy("_n", "_last").agg(F.sum("gain").alias("s")).select((F.col("s") / F.col("_n") - F.col("_last") / (2 * F.col("_n")) - F.col("_last") / 2).alias("area"))


def cooled_down(df: DataFrame, keys: Sequence[str], day: str, days: int) -> DataFrame:
    """Flags as actions: a flagged day acts only if the key's last action is `days` or more days before. Days that a
    key has twice act once; rows without a day don't act. Keys with very many days are read in bounded memory."""
    rows = df.where(F.col(day).isNotNull()).select(*keys, F.col(day).cast("date").alias(day), F.unix_date(F.col(day).cast("date")).alias("_n"))

    def fold(last, columns):
        kept = []
        for k, n in enumerate(columns[1]):
            if last is None or n - last >= max(days, 1):
                kept.append(k)
                last = n
        return last, kept, []

    return carried(rows, keys, [F.col("_n")], [day, "_n"], fold, []).drop("_n")


def cusum(df: DataFrame, keys: Sequence[str], day: str, z: str, k: float, h: float) -> DataFrame:
    """(keys, day, s, alarm): S = max(0, S + z - k) along each key's days; an alarm at h sets S back to 0. A day without a
    value keeps S. Days that a key has twice go in order of their values. Keys with very many days are read in bounded
    memory."""

    def fold(state, columns):
        s, sums = state or 0.0, []
        for x in columns[1]:
            if x is not None:
                s = max(0.0, s + x - k)
            sums.append(s)
            if s >= h:
                s = 0.0
        return s, list(range(len(sums))), [sums, [x >= h for x in sums]]

    rows = df.select(*keys, F.col(day).alias("day"), F.col(z).cast("double").alias("_z"))
    out = carried(rows, keys, [F.col("day").asc_nulls_last(), F.col("_z").asc_nulls_first()], ["day", "_z"], fold, [("s", T.DoubleType()), ("alarm", T.BooleanType())])
    return out.select(*keys, "day", "s", "alarm")


def coupled_cusum(df: DataFrame, day: str, lane: str, z: str, weight: str, k: float, h: float, suspect: float) -> DataFrame:
    """(day, lane, shared, s, alarm): CUSUM after the day's shared effect is taken out, where lanes under suspicion
    (a state of `suspect` or more) lose their vote on it. Votes are clipped at 3 deviations; an alarm at h sets a
    lane's state back to 0; a lane without a row on a day keeps its state.

    A day's shared effect needs the state of all lanes on the day before. Days, whose number doesn't grow with the
    lanes, are handled one after the other: an aggregate of the day's votes, then an update of all lanes by a join,
    written once, with the states that the next day starts from.
    """
    cols = written(df.select(F.col(day).cast("date").alias("day"), F.col(lane).cast("string").alias("lane"), F.col(z).cast("double").alias("z"), F.col(weight).cast("double").alias("w")))
    out = [df.sparkSession.createDataFrame([], "day date, lane string, shared double, s double, alarm boolean")]
    state = df.sparkSession.createDataFrame([], "lane string, state double")
    for (at,) in cols.select("day").distinct().orderBy("day").collect():
        rows = cols.where(F.col("day") == F.lit(at)).join(state, "lane", "full").withColumn("state", F.coalesce("state", F.lit(0.0)))
        clipped = F.greatest(F.least(F.col("z"), F.lit(3.0)), F.lit(-3.0))
        total, sums = rows.where(F.col("day").isNotNull() & (F.col("state") < suspect)).agg(F.sum("w"), F.sum(clipped * F.col("w"))).first()
        shared = sums / total if total else 0.0
        s = F.when(F.col("day").isNotNull(), F.greatest(F.lit(0.0), F.col("state") + F.col("z") - shared - k))
        new = F.when(s >= h, 0.0).otherwise(F.coalesce(s, F.col("state")))
        # The day's rows and the next day's states are one table.
        done = written(rows.select("day", "lane", F.lit(shared).alias("shared"), s.alias("s"), (s >= h).alias("alarm"), new.alias("state")))
        out.append(done.where("day IS NOT NULL").drop("state"))
        state = done.select("lane", "state")
    return reduce(DataFrame.unionByName, out)
