"""Routing over stops taken from the embeddings' first components: an instance for each block of so many keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import routes as R
from freightloom.plans.registry import query, rounded, table

CAPACITY = 60.0
#: Stops of an instance, at most: what one task holds doesn't grow with the table.
BLOCK = 25
_STOPS = f"s AS (SELECT CAST(vec_id // {BLOCK} AS VARCHAR) AS instance, vec_id AS stop, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, (1 + vec_id % 4)::DOUBLE AS packages FROM embeddings)"


def stops(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / BLOCK).cast("string").alias("instance"), F.col("vec_id").alias("stop"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (1 + F.col("vec_id") % 4).cast("double").alias("packages"))


@query(f"WITH {_STOPS} SELECT instance, CAST(ceil(sum(packages) / 60) AS BIGINT) AS trucks FROM s GROUP BY 1")
def fn_trucks_needed(spark, d):
    return R.trucks_needed(stops(spark, d), CAPACITY)


@query()
def route_zone_fixed(spark, d):
    return rounded(R.solved(stops(spark, d), CAPACITY, "zones"))


@query()
def route_nn_global(spark, d):
    return rounded(R.solved(stops(spark, d), CAPACITY, "nearest"))


@query()
def route_clarke_wright(spark, d):
    return rounded(R.solved(stops(spark, d), CAPACITY, "savings"))


@query()
def route_savings_2opt(spark, d):
    return rounded(R.solved(stops(spark, d), CAPACITY))


@query("SELECT CAST(NULL AS VARCHAR) AS instance, CAST(NULL AS VARCHAR) AS problem WHERE FALSE")
def route_check_valid(spark, d):
    """No rows: every stop is served once and no truck is too full."""
    s = stops(spark, d)
    return R.route_problems(R.solved(s, CAPACITY), s, CAPACITY)


@query(f"""
WITH {_STOPS}, n AS (SELECT instance, stop + 1 AS a, x, y FROM s UNION ALL SELECT DISTINCT instance, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM s), k AS (SELECT instance, ceil(sum(packages) / 60) AS trucks FROM s GROUP BY 1),
p AS (SELECT u.instance, u.a, row_number() OVER (PARTITION BY u.instance, u.a ORDER BY sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2)), v.a) AS r, sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2)) AS miles FROM n u JOIN n v ON u.instance = v.instance AND u.a <> v.a)
SELECT instance, round(sum(miles) / 2, 4) AS bound FROM p JOIN k USING (instance) WHERE r <= CASE WHEN a = 0 THEN 2 * trucks ELSE 2 END GROUP BY 1""")
def route_lower_bound(spark, d):
    """Pairs stay inside an instance, which a depot's day bounds."""
    s = stops(spark, d)
    nodes = s.select("instance", (F.col("stop") + 1).alias("a"), "x", "y").unionByName(s.select("instance", F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).distinct())
    other = nodes.select("instance", F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = nodes.join(other, "instance").where("a <> b").select("instance", "a", "b", S.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")).alias("miles"))
    return rounded(R.lower_bound(pairs, R.trucks_needed(s, CAPACITY)))


@query(f"""
WITH {_STOPS}, z AS (SELECT *, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS turn FROM s), c AS (SELECT *, sum(packages) OVER (PARTITION BY instance ORDER BY turn, stop) - packages AS before, sum(packages) OVER (PARTITION BY instance) / 4 AS share FROM z)
SELECT instance, stop, CAST(least(floor(before / share), 3) AS BIGINT) AS zone FROM c""")
def win_zone_cut(spark, d):
    """Swept by angle; a zone for each quarter of the packages."""
    from pyspark.sql import Window

    w = Window.partitionBy("instance")
    run = w.orderBy("turn", "stop").rowsBetween(Window.unboundedPreceding, 0)
    s = stops(spark, d).withColumn("turn", S.angle(F.col("y"), F.col("x")))
    before = F.sum("packages").over(run) - F.col("packages")
    return s.select("instance", "stop", F.least(F.floor(before / (F.sum("packages").over(w) / 4)), F.lit(3)).alias("zone"))
