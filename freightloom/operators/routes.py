"""Capacitated routing: instances side by side, one group each.

A route's next stop depends on the stops before it, so an instance is solved inside one task; Spark deals the
instances (depot-days) out. An instance is bounded by what one depot serves in a day.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUTES = "instance string, truck int, seq int, stop long, miles double"


def trucks_needed(stops: DataFrame, capacity: float) -> DataFrame:
    return stops.groupBy("instance").agg(F.ceil(F.sum("packages") / capacity).alias("trucks"))


def _length(route: list[int], d: np.ndarray) -> float:
    return float(sum(d[a, b] for a, b in zip([0, *route], [*route, 0])))


def _merged(d: np.ndarray, load: np.ndarray, capacity: float) -> list[list[int]]:
    """Savings: the two routes whose ends save the most when joined are joined while they fit."""
    n = len(d)
    route_of = {i: [i] for i in range(1, n)}
    i, j = np.triu_indices(n, 1)
    keep = i > 0
    i, j = i[keep], j[keep]
    saving = d[i, 0] + d[0, j] - d[i, j]
    for k in np.lexsort((j, i, -saving)):
        if saving[k] <= 0:
            break
        a, b = route_of[i[k]], route_of[j[k]]
        if a is b or load[a].sum() + load[b].sum() > capacity:
            continue
        if a[0] == i[k]:
            a.reverse()
        if b[-1] == j[k]:
            b.reverse()
        if a[-1] == i[k] and b[0] == j[k]:
            a.extend(b)
            for s in b:
                route_of[s] = a
    return list({id(r): r for r in route_of.values()}.values())


def _two_opt(route: list[int], d: np.ndarray) -> list[int]:
    """Turns stretches around while that shortens the route."""
    tour = [0, *route, 0]
    better = True
    while better:
        better = False
        for a in range(1, len(tour) - 2):
            for b in range(a + 1, len(tour) - 1):
                if d[tour[a - 1], tour[b]] + d[tour[a], tour[b + 1]] < d[tour[a - 1], tour[a]] + d[tour[b], tour[b + 1]] - 1e-9:
                    tour[a : b + 1] = tour[a : b + 1][::-1]
                    better = True
    return tour[1:-1]


def _nearest(d: np.ndarray, load: np.ndarray, capacity: float) -> list[list[int]]:
    """Each truck goes to the nearest stop that still fits."""
    left, out = set(range(1, len(d))), []
    while left:
        route, at, room = [], 0, capacity
        while True:
            fits = [s for s in left if load[s] <= room]
            if not fits:
                break
            at = min(fits, key=lambda s: (d[at, s], s))
            route.append(at)
            left.discard(at)
            room -= load[at]
        if not route:
            raise ValueError("a stop is larger than a truck")
        out.append(route)
    return out


def _zones(xy: np.ndarray, load: np.ndarray, capacity: float) -> list[list[int]]:
    """Stops by angle around the depot, cut where a truck is full."""
    turn = np.arctan2(xy[1:, 1] - xy[0, 1], xy[1:, 0] - xy[0, 0]) % (2 * math.pi)
    out, room = [[]], capacity
    for s in np.argsort(turn, kind="stable") + 1:
        if load[s] > room:
            out.append([])
            room = capacity
        out[-1].append(int(s))
        room -= load[s]
    return [r for r in out if r]


def solved(stops: DataFrame, capacity: float, method: str = "savings_2opt") -> DataFrame:
    """Rows (instance, truck, seq, stop, miles of the truck's route) from (instance, stop, x, y, packages).

    The depot is at the origin. Methods: `nearest`, `zones`, `savings`, `savings_2opt`.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stop")
        xy = np.concatenate(([[0.0, 0.0]], pdf[["x", "y"]].to_numpy()))
        load = np.concatenate(([0.0], pdf["packages"].to_numpy()))
        d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        routes = {"nearest": lambda: _nearest(d, load, capacity), "zones": lambda: _zones(xy, load, capacity)}.get(method, lambda: _merged(d, load, capacity))()
        if method == "savings_2opt":
            routes = [_two_opt(r, d) for r in routes]
        ids = pdf["stop"].to_numpy()
        rows = [(pdf["instance"].iloc[0], t, k, ids[s - 1], _length(r, d)) for t, r in enumerate(sorted(routes, key=lambda r: min(r))) for k, s in enumerate(r)]
        return pd.DataFrame(rows, columns=["instance", "truck", "seq", "stop", "miles"])

    return stops.select("instance", F.col("stop").cast("long"), "x", "y", F.col("packages").cast("double").alias("packages")).groupBy("instance").applyInPandas(run, ROUTES)


def route_problems(routes: DataFrame, stops: DataFrame, capacity: float) -> DataFrame:
    """(instance, problem) rows: a stop that isn't served exactly once, or a truck that is too full. Empty if valid."""
    served = stops.join(routes.groupBy("instance", "stop").agg(F.count("*").alias("n")), ["instance", "stop"], "left").where(F.coalesce("n", F.lit(0)) != 1)
    full = routes.join(stops, ["instance", "stop"]).groupBy("instance", "truck").agg(F.sum("packages").alias("load")).where(F.col("load") > capacity)
    return served.select("instance", F.concat(F.lit("stop "), F.col("stop").cast("string")).alias("problem")).unionByName(full.select("instance", F.concat(F.lit("truck "), F.col("truck").cast("string")).alias("problem")))


def lower_bound(pairs: DataFrame, trucks: DataFrame) -> DataFrame:
    """(instance, bound): half of each stop's two cheapest links, and of the cheapest links that K trucks need at the
    depot. pairs: (instance, a, b, miles) both ways, the depot is 0."""
    from pyspark.sql import Window

    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("instance", "a").orderBy("miles", "b")))
    links = ranked.join(trucks, "instance").where(F.col("r") <= F.when(F.col("a") == 0, 2 * F.col("trucks")).otherwise(2))
    return links.groupBy("instance").agg((F.sum("miles") / 2).alias("bound"))
