"""Nearest neighbours and near texts against all pairs, and how their work grows."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightloom.operators import joins as J
from freightloom.plans import QUERIES


def brute(points, k):
    out = {}
    for key, x, y in points:
        near = sorted((((x - b) ** 2 + (y - c) ** 2) ** 0.5, other) for other, b, c in points if other != key)[:k]
        out[key] = [(other, pytest.approx(d)) for d, other in near]
    return out


def clustered(seed, n):
    """Most points in two tight clusters, some far away, some on one place."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(0, 1e-3, (n // 2, 2)), rng.normal(5, 1e-2, (n // 4, 2)), rng.uniform(-100, 100, (n // 8, 2)), np.tile([[5.0, 5.0]], (n // 8, 1))])
    rng.shuffle(xy)
    return [(k, float(a), float(b)) for k, (a, b) in enumerate(xy)]


@pytest.mark.parametrize("seed,n,k,size", [(1, 400, 5, 16), (2, 333, 20, 8), (3, 12, 20, 4), (4, 64, 3, 128), (5, 240, 1, 3)])
def test_nearest_is_exact_on_clustered_points(spark, seed, n, k, size):
    points = clustered(seed, n)
    df = spark.createDataFrame([*points, (10_000, None, 1.0), (10_001, float("nan"), 1.0)], "id long, x double, y double").repartition(3)
    got = {}
    for r in J.nearest(df, "id", "x", "y", k, size).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append((r["neighbour"], r["distance"]))
    assert got == brute(points, k)


def test_no_cell_holds_more_than_its_bound(spark):
    points = clustered(6, 2000)
    laid, strips = J.cells(spark.createDataFrame(points, "id long, x double, y double"), "id", "x", "y", 20)
    sizes = [r["count"] for r in laid.groupBy("cell").count().collect()]
    assert sum(sizes) == len(points) and 20 <= min(sizes) and max(sizes) <= 40 and len(strips) <= len(points) ** 0.5
    assert all(a[2] <= b[1] for a, b in zip(strips, strips[1:]))
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert J.nearest(one, "id", "x", "y", 2).collect() == [] and J.nearest(one.limit(0), "id", "x", "y", 2).collect() == []


def slips(a, b):
    keys = lambda t: {t, *[t[:i] + t[i + 1 :] for i in range(len(t))]}
    return bool(keys(a) & keys(b))


def test_near_pairs_share_a_key(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab1") for _ in range(rnd.randint(0, 5))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "id int, t string, half int")
    got = J.near_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", F.col("t"), F.col("t"), [(F.col("half"), F.col("half"))]).collect()
    assert len(got) == len(set(got))
    assert {(r["a"], r["b"]) for r in got} == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s is not None and t is not None and i % 2 == j % 2 and slips(s, t)}


def test_candidates_of_a_row_do_not_grow_with_the_table(spark):
    """Customers grow tenfold, candidates of one by a digit's share."""
    told = {}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        if not os.path.isdir(f"/root/testdata/{sf}"):
            pytest.skip("no tables")
        told[sf] = QUERIES["agg_blocking_recall"].build(spark, f"/root/testdata/{sf}").first()
    assert all(r["recall"] >= 0.9 for r in told.values())
    assert told["sf0.1"]["pairs_per_row"] < 2 * told["sf0.01"]["pairs_per_row"] < 12


def test_near_keys_are_not_sent_to_all_executors(spark):
    """A small table has many times as many keys as Spark thinks: its side is dealt out by key, into parts that follow their number."""
    df = spark.range(20_000).select("id", F.format_string("%09d", "id").alias("t"))
    pairs = J.near_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", F.col("t"), F.col("t"), gap=(F.col("t"), F.col("t")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert plan.count("SinglePartition, REPARTITION_BY_NUM") == 2
    got = {(r["a"], r["b"]): r["gap"] for r in pairs.where("a < 30").collect()}
    assert got[3, 3] == 0 and got[3, 4] == 1 and got[12, 21] == 2 and (3, 44) not in got
    J.PART, most = 100_000, J.PART
    try:
        again = J.near_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", F.col("t"), F.col("t"))
        assert ", 4), REPARTITION_BY_NUM" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        J.PART = most


def test_candidates_beyond_the_reach_are_not_sorted(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 20 as double) AS x", "cast(id div 20 as double) AS y")
    plan = J.nearest(df, "id", "x", "y", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"<= reach#\d+", plan.split("Window", 1)[1]) and "RepartitionByExpression" in plan
