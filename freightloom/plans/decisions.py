"""Decisions under budgets, grids of prices, bookings, targeting, and detectors with state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import decide as D
from freightloom.plans.panels import USER_DAYS, user_days
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.scores import SCORED, scored

#: An action's cost and the share of the risk that it removes.
ACTIONS = {"call": (8.0, 0.15), "upgrade": (40.0, 0.6), "courier": (120.0, 0.9)}
_STAKE = "(15 + least(0.002::DOUBLE * value, 200))"
_ACTED = f"""a AS (SELECT o_orderkey, p, p * 0.15::DOUBLE * {_STAKE} - 8 AS s1, p * 0.6::DOUBLE * {_STAKE} - 40 AS s2, p * 0.9::DOUBLE * {_STAKE} - 120 AS s3 FROM s),
b AS (SELECT o_orderkey, p, greatest(0, s1, s2, s3) AS saving, CASE greatest(0, s1, s2, s3) WHEN 0 THEN 'none' WHEN s1 THEN 'call' WHEN s2 THEN 'upgrade' ELSE 'courier' END AS action,
  CASE greatest(0, s1, s2, s3) WHEN 0 THEN 0.0::DOUBLE WHEN s1 THEN 8.0::DOUBLE WHEN s2 THEN 40.0::DOUBLE ELSE 120.0::DOUBLE END AS cost FROM a)"""


def acted(spark, d) -> DataFrame:
    stake = 15 + F.least(0.002 * F.col("value"), F.lit(200.0))
    return D.best_action(scored(spark, d).select("o_orderkey", "p", "value"), "o_orderkey", F.col("p"), stake, ACTIONS)


def _worth() -> list:
    return [F.desc(F.col("saving") / F.col("cost")), F.col("o_orderkey")]


@query(f"WITH {SCORED}, {_ACTED} SELECT o_orderkey, action, cost, round(saving, 4) AS saving FROM b")
def join_cross_catalog(spark, d):
    """Each row against the catalogue of actions; the best one stays."""
    return rounded(acted(spark, d).select("o_orderkey", "action", "cost", "saving"))


@query(f"""
WITH RECURSIVE {SCORED}, {_ACTED}, c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY saving / cost DESC, o_orderkey) AS i FROM b WHERE action <> 'none'),
f AS (SELECT 0::BIGINT AS i, 3000.0::DOUBLE AS money, FALSE AS took UNION ALL SELECT c.i, CASE WHEN c.cost <= f.money THEN f.money - c.cost ELSE f.money END, c.cost <= f.money FROM f JOIN c ON c.i = f.i + 1)
SELECT o_orderkey, action, cost, round(saving, 4) AS saving FROM c JOIN f USING (i) WHERE took""")
def alloc_ev_greedy(spark, d):
    """By saving a dollar until the money is gone; what doesn't fit is passed over."""
    return rounded(D.greedy_fill(acted(spark, d).where("action <> 'none'"), _worth(), "cost", 3000.0).select("o_orderkey", "action", "cost", "saving"))


@query(f"WITH {SCORED} SELECT o_orderkey FROM s QUALIFY row_number() OVER (ORDER BY p DESC, o_orderkey) <= floor(3000 / 40)")
def topk_budget(spark, d):
    df = scored(spark, d).select("o_orderkey", "p", F.lit(40.0).alias("cost"))
    return D.within_budget(df, [F.desc("p"), F.col("o_orderkey")], "cost", 3000.0).select("o_orderkey")


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_extendedprice * (1 - l_discount) AS cost FROM lineitem), g AS (SELECT unnest(generate_series(0, 9)) AS k),
e AS (SELECT q.*, cost * (1.0::DOUBLE + 0.1::DOUBLE * k) AS price, cost * 0.1::DOUBLE * k / (1 + exp(6 * (1.0::DOUBLE + 0.1::DOUBLE * k - 1.4::DOUBLE))) AS margin FROM q CROSS JOIN g)
SELECT l_orderkey, l_linenumber, l_partkey, round(price, 7) AS price, round(margin, 6) AS margin FROM e
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ORDER BY margin DESC, price) = 1""")
def price_grid_argmax(spark, d):
    """Each quote's price of the largest expected margin on a grid of multipliers: within the row, no join."""
    cost = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = table(spark, d, "lineitem").withColumn("c", cost)
    options = F.array(*[F.struct((F.col("c") * (0.1 * k) / (1 + F.exp(F.lit(6 * (1.0 + 0.1 * k - 1.4))))).alias("margin"), (-F.col("c") * (1.0 + 0.1 * k)).alias("low")) for k in range(10)])
    best = df.withColumn("b", F.array_max(options))
    return best.select("l_orderkey", "l_linenumber", "l_partkey", F.round(-F.col("b.low"), 7).alias("price"), F.round("b.margin", 6).alias("margin"))


@query("""
WITH w AS (SELECT o_custkey % 20 AS lane, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*)::DOUBLE AS demand FROM orders GROUP BY 1, 2),
b AS (SELECT lane, ceil(quantile_cont(demand, 0.5)) AS mean_book, ceil(quantile_cont(demand, 900 / 1950.0::DOUBLE)) AS news_book FROM w GROUP BY 1)
SELECT w.lane, w.month, round(mean_book * 1000 + greatest(demand - mean_book, 0) * 1900 - greatest(mean_book - demand, 0) * -50, 4) AS mean_cost,
  round(news_book * 1000 + greatest(demand - news_book, 0) * 1900 - greatest(news_book - demand, 0) * -50, 4) AS news_cost FROM w JOIN b USING (lane)""")
def newsvendor_bookings(spark, d):
    """Bookings at the critical fractile of a lane's demand, and their cost once demand is known."""
    w = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("lane"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count("*").cast("double").alias("demand"))
    books = w.groupBy("lane").agg(F.ceil(F.percentile("demand", 0.5)).alias("mean_book"), F.ceil(F.percentile("demand", S.critical_fractile(900, 1050))).alias("news_book"))
    cost = lambda b: D.booking_costs(F.col("demand"), F.col(b), 1000.0, 1900.0, -50.0)["total"]
    return rounded(w.join(books, "lane").select("lane", "month", cost("mean_book").alias("mean_cost"), cost("news_book").alias("news_cost")))


_ARMS = f"WITH {SCORED}, a AS (SELECT *, CAST(concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS UBIGINT) % 2 AS t, row_number() OVER (ORDER BY p DESC, o_orderkey) AS rank FROM s), c AS (SELECT rank, sum(t) OVER w AS nt, sum(t * y) OVER w AS yt, sum(1 - t) OVER w AS nc, sum((1 - t) * y) OVER w AS yc FROM (SELECT rank, CAST(t AS BIGINT) AS t, y FROM a) WINDOW w AS (ORDER BY rank)), q AS (SELECT rank, CASE WHEN nt > 0 AND nc > 0 THEN rank * (yc::DOUBLE / nc - yt::DOUBLE / nt) ELSE 0.0::DOUBLE END AS gain FROM c)"


def _uplift(spark, d) -> DataFrame:
    t = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 2
    return D.uplift_curve(scored(spark, d), [F.desc("p"), F.col("o_orderkey")], t, F.col("y"))


@query(_ARMS + " SELECT rank, round(gain, 4) AS gain FROM q")
def win_qini_observed(spark, d):
    return rounded(_uplift(spark, d))


@query(_ARMS + ", e AS (SELECT max(rank)::DOUBLE AS n, arg_max(gain, rank) AS last FROM q) SELECT round(sum(gain) / n - last / (2 * n) - last / 2, 4) AS area FROM q, e GROUP BY n, last")
def win_auuc(spark, d):
    return rounded(D.area_over_diagonal(_uplift(spark, d)))


@query(f"""
WITH RECURSIVE {USER_DAYS}, f AS MATERIALIZED (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM u WHERE failed = 1),
r AS (SELECT user_id, i, day, day AS last, TRUE AS acts FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.i, f.day, CASE WHEN f.day - r.last >= 5 THEN f.day ELSE r.last END, f.day - r.last >= 5 FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1)
SELECT user_id, day FROM r WHERE acts""")
def cooldown_replay(spark, d):
    return D.cooled_down(user_days(spark, d).where("failed = 1"), ["user_id"], "day", 5)


#: Days up to here are the baseline; detectors start after it.
BASELINE = "2024-01-10"
_Z = f"""{USER_DAYS}, g AS (SELECT avg(total) AS gm, stddev_pop(total) AS gs FROM u WHERE day <= DATE '{BASELINE}'),
m AS (SELECT user_id, avg(total) AS m, stddev_pop(total) AS s, count(*) AS k FROM u WHERE day <= DATE '{BASELINE}' GROUP BY 1),
z AS (SELECT user_id, day, (total - CASE WHEN k >= 3 THEN m ELSE gm END) / greatest(CASE WHEN k >= 3 THEN s ELSE gs END, 1e-9) AS z, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM u LEFT JOIN m USING (user_id), g WHERE day > DATE '{BASELINE}')"""


def standardised(spark, d) -> DataFrame:
    """Days after the baseline, by what the baseline knows: each user's mean and deviation where it has three days or
    more there, everyone's otherwise."""
    u = user_days(spark, d)
    known = u.where(F.col("day") <= F.lit(BASELINE).cast("date"))
    everyone = known.agg(F.avg("total").alias("gm"), F.stddev_pop("total").alias("gs"))
    own = known.groupBy("user_id").agg(F.avg("total").alias("m"), F.stddev_pop("total").alias("s"), F.count("*").alias("k"))
    df = u.where(F.col("day") > F.lit(BASELINE).cast("date")).join(own, "user_id", "left").crossJoin(F.broadcast(everyone))
    enough = F.coalesce(F.col("k") >= 3, F.lit(False))
    z = (F.col("total") - F.when(enough, F.col("m")).otherwise(F.col("gm"))) / F.greatest(F.when(enough, F.col("s")).otherwise(F.col("gs")), F.lit(1e-9))
    return df.select("user_id", "day", z.alias("z"), F.col("n").alias("weight"))


@query(f"""
WITH RECURSIVE {_Z}, zz AS MATERIALIZED (SELECT * FROM z), r AS (SELECT user_id, i, day, greatest(0, z - 0.25::DOUBLE) AS s FROM zz WHERE i = 1
  UNION ALL SELECT zz.user_id, zz.i, zz.day, greatest(0, CASE WHEN r.s >= 2 THEN 0 ELSE r.s END + zz.z - 0.25::DOUBLE) FROM r JOIN zz ON zz.user_id = r.user_id AND zz.i = r.i + 1)
SELECT user_id, day, round(s, 4) AS s, s >= 2 AS alarm FROM r""")
def cusum_lane_local(spark, d):
    return rounded(D.cusum(standardised(spark, d), ["user_id"], "day", "z", 0.25, 2.0))


@query()
def cusum_detect(spark, d):
    """With the day's shared effect taken out, and suspects' votes ignored."""
    return rounded(D.coupled_cusum(standardised(spark, d), "day", "user_id", "z", "weight", 0.25, 2.0, 1.0))


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, 15 + least(0.02::DOUBLE * o_totalprice, 60) * CASE o_orderpriority WHEN '1-URGENT' THEN 2.0::DOUBLE WHEN '2-HIGH' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS cost FROM orders)
SELECT o_orderkey, round(cost, 4) AS cost, round(1 - (1 - 0.3::DOUBLE) * (1 - 0.2::DOUBLE), 4) AS effect FROM o""")
def fn_miss_cost(spark, d):
    tier = S.looked_up(F.col("o_orderpriority"), {"1-URGENT": 2.0, "2-HIGH": 1.5}, 1.0)
    cost = 15 + F.least(0.02 * F.col("o_totalprice"), F.lit(60.0)) * tier
    return rounded(table(spark, d, "orders").select("o_orderkey", cost.alias("cost"), (1 - (1 - F.lit(0.3)) * (1 - F.lit(0.2))).alias("effect")))


@query("""
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS u, CAST(embedding[4] AS DOUBLE) AS v FROM embeddings), g AS (SELECT *, 40 + x * 10 AS a1, 40 + u * 10 AS a2, -90 + y * 10 AS o1, -90 + v * 10 AS o2 FROM p)
SELECT vec_id, round(sqrt(x * x + y * y), 4) AS reach, round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END, 4) AS turn,
  round(2 * 3958.8::DOUBLE * asin(sqrt(pow(sin(radians(a2 - a1) / 2), 2) + cos(radians(a1)) * cos(radians(a2)) * pow(sin(radians(o2 - o1) / 2), 2))), 4) AS miles FROM g""")
def fn_haversine(spark, d):
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    miles = S.haversine(40 + e[0] * 10, -90 + e[1] * 10, 40 + e[2] * 10, -90 + e[3] * 10)
    return rounded(table(spark, d, "embeddings").select("vec_id", S.hypot(e[0], e[1]).alias("reach"), S.angle(e[1], e[0]).alias("turn"), miles.alias("miles")))
