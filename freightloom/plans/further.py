"""Further operators: files round trip, matrices inside blocks, clocks along routes, alarms against onsets, margins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import clean as C
from freightloom.operators import ranked as R
from freightloom.operators import windows as W
from freightloom.operators.scratch import new_path
from freightloom.plans.panels import TYPE_DAYS, USER_DAYS, type_days, user_days
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.routing import _STOPS, stops
from freightloom.plans.scores import _FORECAST, SCORED, TIED, forecasts, scored, tied
from freightloom.sources import files


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def scan_csv_typed(spark, d):
    """Orders written as CSV and read with declared types."""
    path = new_path(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    files.write_csv(o, path)
    return files.csv_typed(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")


@query("SELECT s_suppkey AS supplier, s_acctbal AS balance FROM supplier")
def scan_csv_bom_rename(spark, d):
    """Whitelisted columns under new names; the rest stays at the door."""
    path = new_path(spark)
    files.write_csv(table(spark, d, "supplier"), path)
    return files.csv_renamed(spark, path, {"s_suppkey": "supplier", "s_acctbal": "balance"}, {"supplier": "long", "balance": "double"})


@query(f"""
WITH {_STOPS} SELECT a.instance, a.stop AS a, b.stop AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS miles, CAST(floor(1000 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) + 0.5::DOUBLE) AS BIGINT) AS whole
FROM s a JOIN s b ON a.instance = b.instance AND a.stop < b.stop""")
def join_cross_matrix(spark, d):
    """Distances between all stops of one instance, also as whole numbers (half up)."""
    s = stops(spark, d)
    b = s.select("instance", F.col("stop").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    miles = S.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return rounded(s.withColumnRenamed("stop", "a").join(b, "instance").where("a < b").select("instance", "a", "b", miles.alias("miles"), F.floor(1000 * miles + 0.5).alias("whole")))


@query(f"""
WITH {_STOPS}, p AS (SELECT a.instance, a.stop AS a, b.stop AS b, sqrt(a.x * a.x + a.y * a.y) + sqrt(b.x * b.x + b.y * b.y) - sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS saving FROM s a JOIN s b ON a.instance = b.instance AND a.stop < b.stop)
SELECT instance, a, b, round(saving, 4) AS saving FROM p QUALIFY row_number() OVER (PARTITION BY instance ORDER BY saving DESC, a, b) <= 20""")
def multi_sort_stable(spark, d):
    """The largest savings of joining two stops, ties by their numbers."""
    s = stops(spark, d).withColumn("out", S.hypot(F.col("x"), F.col("y")))
    b = s.select("instance", F.col("stop").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("out").alias("out2"))
    p = s.withColumnRenamed("stop", "a").join(b, "instance").where("a < b")
    p = p.withColumn("saving", F.col("out") + F.col("out2") - S.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    n = F.row_number().over(Window.partitionBy("instance").orderBy(F.desc("saving"), "a", "b"))
    return rounded(p.withColumn("n", n).where("n <= 20").select("instance", "a", "b", "saving"))


_TOUR = f"""{_STOPS}, t AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY stop) AS seq, lag(x, 1, 0) OVER (PARTITION BY instance ORDER BY stop) AS px, lag(y, 1, 0) OVER (PARTITION BY instance ORDER BY stop) AS py FROM s),
m AS (SELECT instance, stop, seq, packages, sqrt(pow(x - px, 2) + pow(y - py, 2)) * 20 AS leg, sqrt(x * x + y * y) * 20 AS back FROM t)"""


def _legs(spark, d):
    w = Window.partitionBy("instance").orderBy("stop")
    s = stops(spark, d)
    leg = S.hypot(F.col("x") - F.lag("x", 1, 0.0).over(w), F.col("y") - F.lag("y", 1, 0.0).over(w)) * 20
    return s.select("instance", "stop", F.row_number().over(w).alias("seq"), "packages", leg.alias("leg"), (S.hypot(F.col("x"), F.col("y")) * 20).alias("back"))


@query(f"""
WITH {_TOUR} SELECT instance, stop, round(sum(leg) OVER w, 4) AS miles, round(sum(packages) OVER w, 4) AS load, round(480 + sum(leg) OVER w * 2 + (seq - 1) * 3, 4) AS arrival FROM m WINDOW w AS (PARTITION BY instance ORDER BY seq)""")
def win_sequential_clock(spark, d):
    """Miles, load and clock along a tour in order of stops."""
    w = Window.partitionBy("instance").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    miles = F.sum("leg").over(w)
    return rounded(_legs(spark, d).select("instance", "stop", miles.alias("miles"), F.sum("packages").over(w).alias("load"), (480 + miles * 2 + (F.col("seq") - 1) * 3).alias("arrival")))


@query(f"WITH {_TOUR} SELECT instance, round(sum(leg) + arg_max(back, seq), 4) AS miles, round((sum(leg) + arg_max(back, seq)) * 2 + count(*) * 3, 4) AS minutes, round((sum(leg) + arg_max(back, seq)) / count(*), 4) AS per_stop FROM m GROUP BY 1")
def agg_route_summary(spark, d):
    """Miles with both depot legs, minutes and rates of each tour."""
    miles = F.sum("leg") + F.max_by("back", "seq")
    return rounded(_legs(spark, d).groupBy("instance").agg(miles.alias("miles"), (miles * 2 + F.count("*") * 3).alias("minutes"), (miles / F.count("*")).alias("per_stop")))


@query("""
WITH w AS (SELECT o_custkey % 20 AS lane, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT a.lane, a.week, round(CASE WHEN count(b.n) >= 2 THEN avg(b.n) END, 4) AS mean_4, round(coalesce(CASE WHEN count(b.n) >= 2 THEN avg(b.n) END, max(c.n)), 4) AS anchor
FROM w a LEFT JOIN w b ON a.lane = b.lane AND b.week BETWEEN a.week - 28 AND a.week - 7 LEFT JOIN w c ON c.lane = a.lane AND c.week = a.week - 364 GROUP BY 1, 2""")
def win_build_features_lane(spark, d):
    """Mean of four weeks before, else the same week last year."""
    w = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("lane"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("n"))
    w = W.calendar_lag(W.trailing_mean(w, ["lane"], "week", "n", 28, 2, "mean_4"), ["lane"], "week", "n", 364, "year")
    return rounded(w.select("lane", "week", "mean_4", F.coalesce("mean_4", "year").alias("anchor")))


@query(f"""
WITH {USER_DAYS}, o AS (SELECT user_id, min(day) AS onset FROM u WHERE failed = 1 GROUP BY 1), a AS (SELECT user_id, day FROM u WHERE n > 3)
SELECT a.user_id, a.day, CASE WHEN onset IS NULL THEN 'false' WHEN a.day < onset THEN 'early' WHEN a.day - onset <= 7 THEN 'hit' ELSE 'late' END AS kind FROM a LEFT JOIN o USING (user_id)""")
def annotate_alarms(spark, d):
    u = user_days(spark, d)
    onsets = u.where("failed = 1").groupBy("user_id").agg(F.min("day").alias("onset"))
    gap = F.datediff("day", "onset")
    kind = F.when(F.col("onset").isNull(), "false").when(gap < 0, "early").when(gap <= 7, "hit").otherwise("late")
    return u.where("n > 3").join(onsets, "user_id", "left").select("user_id", "day", kind.alias("kind"))


@query(f"""
WITH {USER_DAYS}, o AS (SELECT user_id, min(day) AS onset FROM u WHERE failed = 1 GROUP BY 1), a AS (SELECT o.user_id, onset, (SELECT min(day) FROM u WHERE u.user_id = o.user_id AND n > 3 AND day >= onset) AS found FROM o)
SELECT user_id % 3 AS kind, count(*) AS n, round(avg(CAST(found IS NOT NULL AS INTEGER)), 4) AS rate, round(avg(found - onset), 4) AS mean_delay, round(quantile_cont(found - onset, 0.5), 4) AS median_delay FROM a GROUP BY 1""")
def agg_rate_block(spark, d):
    """Detection rate and delays by kind."""
    from freightloom.plans.reports import delay_table

    t = delay_table(spark, d).groupBy((F.col("user_id") % 3).alias("kind"))
    return rounded(t.agg(F.count("*").alias("n"), F.avg(F.col("detected").isNotNull().cast("int")).alias("rate"), F.avg("delay").alias("mean_delay"), F.percentile("delay", 0.5).alias("median_delay")))


@query(f"""
WITH {USER_DAYS}, c AS (SELECT user_id FROM u GROUP BY 1 HAVING max(failed) = 0 OR user_id % 2 = 0) SELECT count(*) FILTER (WHERE n > 3) AS alarms, round(count(*) FILTER (WHERE n > 3) * 365.0::DOUBLE / count(*), 4) AS per_year FROM u JOIN c USING (user_id)""")
def agg_false_alarm(spark, d):
    """Alarms on lanes taken as clean, for each year of exposure."""
    u = user_days(spark, d)
    clean = u.groupBy("user_id").agg(F.max("failed").alias("f")).where("f = 0 OR user_id % 2 = 0").select("user_id")
    n = F.count_if(F.col("n") > 3)
    return rounded(u.join(clean, "user_id").agg(n.alias("alarms"), (n * 365.0 / F.count("*")).alias("per_year")))


@query(f"WITH {_FORECAST} SELECT event_type, day, actual, naive, round(mean, 4) AS mean FROM g WHERE event_type = (SELECT event_type FROM g GROUP BY 1 ORDER BY sum(actual) DESC, event_type LIMIT 1)")
def agg_overlay_hub(spark, d):
    """The largest type's days with its forecasts."""
    f = forecasts(spark, d)
    top = f.groupBy("event_type").agg(F.sum("actual").alias("total")).agg(F.max_by("event_type", F.struct("total", "event_type")).alias("event_type"))
    return rounded(f.join(F.broadcast(top), "event_type").select("event_type", "day", "actual", "naive", "mean"))


@query(f"WITH {SCORED}, {TIED}, g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM g) SELECT min(score) AS score, CAST(max(cn) AS BIGINT) AS cum_n, CAST(max(cp) AS BIGINT) AS cum_positives FROM c WHERE cp::DOUBLE / cn >= 0.85")
def win_coverage_at_target(spark, d):
    curve = R.tie_curve(tied(spark, d), "score", F.col("y")).where(F.col("cum_positives") / F.col("cum_n") >= 0.85)
    return curve.agg(F.min("score").alias("score"), F.max("cum_n").alias("cum_n"), F.max("cum_positives").alias("cum_positives"))


@query("""
WITH u AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(concat('0x', substr(md5(concat(CAST(o_orderkey AS VARCHAR), ':neg')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS draw FROM orders)
SELECT o_orderkey, o_custkey FROM u QUALIFY o_orderstatus = 'F' OR row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY draw, o_orderkey) <= 2""")
def win_neg_sampling(spark, d):
    """All positives, and two drawn negatives of each customer."""
    o = table(spark, d, "orders").withColumn("pos", F.col("o_orderstatus") == "F")
    n = F.row_number().over(Window.partitionBy("o_custkey", "pos").orderBy(S.uniform(F.col("o_orderkey"), "neg"), "o_orderkey"))
    return o.withColumn("n", n).where("pos OR n <= 2").select("o_orderkey", "o_custkey")


@query(f"""
WITH {_FORECAST} SELECT round(quantile_cont(actual - mean, 0.8), 4) AS up, round(quantile_cont(mean - actual, 0.8), 4) AS down, round(quantile_cont(abs(actual - mean), 0.8), 4) AS both FROM g""")
def cqr_margins(spark, d):
    """One-sided and two-sided margins at a plain linear quantile."""
    gap = F.col("actual") - F.col("mean")
    f = forecasts(spark, d).select(gap.alias("up"), (-gap).alias("down"), F.abs(gap).alias("both"))
    return rounded(spark.createDataFrame([tuple(R.quantiles(f, c, [0.8])[0] for c in f.columns)], "up double, down double, both double"))


@query("""
WITH l AS (SELECT c_nationkey AS lane, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) AS r FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), m AS (SELECT avg(r) AS m, greatest(var_pop(r), 1e-6) AS v FROM l)
SELECT round(m * greatest(m * (1 - m) / v - 1, 2), 4) AS a, round((1 - m) * greatest(m * (1 - m) / v - 1, 2), 4) AS b FROM m""")
def fit_beta_prior(spark, d):
    """Moments of lane rates, population variance, with floors."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    l = o.groupBy("c_nationkey").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("r")).agg(F.avg("r").alias("m"), F.greatest(F.var_pop("r"), F.lit(1e-6)).alias("v"))
    k = F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(2.0))
    return rounded(l.select((F.col("m") * k).alias("a"), ((1 - F.col("m")) * k).alias("b")))


@query(f"""
WITH {SCORED}, w AS (SELECT *, CAST(concat('0x', substr(md5(concat(CAST(o_orderkey AS VARCHAR), ':world')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS u FROM s)
SELECT priority, round(sum(CAST(u < p AS INTEGER) * value * 0.01::DOUBLE), 2) AS without, round(sum(CAST(u < p * CASE WHEN p > 0.4 THEN 0.4::DOUBLE ELSE 1 END AS INTEGER) * value * 0.01::DOUBLE), 2) AS "with", count(*) FILTER (WHERE p > 0.4) AS acted FROM w GROUP BY 1""")
def alloc_simulate(spark, d):
    """Losses with and without action on the same draws."""
    u, p, loss = S.uniform(F.col("o_orderkey"), "world"), F.col("p"), F.col("value") * 0.01
    hit = lambda risk: F.sum((u < risk).cast("int") * loss)
    return rounded(scored(spark, d).groupBy("priority").agg(hit(p).alias("without"), hit(p * F.when(p > 0.4, 0.4).otherwise(1.0)).alias("with"), F.count_if(p > 0.4).alias("acted")), 2)


@query("""
SELECT event_type, day, n, total FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY day ORDER BY n, event_type) = 1""")
def clean_hub_feed(spark, d):
    """One row a day: the smallest survives."""
    t = type_days(spark, d)
    return rounded(C.keep_first(t, ["day"], ["n", "event_type"]).select("event_type", "day", "n", "total"))


@query(f"""
WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, o_orderkey) AS i FROM s), k AS (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS f)
SELECT f AS fraction, round(sum(y * value) FILTER (WHERE i <= greatest(round_even((SELECT count(*) FROM s) * f, 0), 1)) / sum(y * value), 4) AS capture FROM r CROSS JOIN k GROUP BY 1""")
def agg_topk_capture(spark, d):
    """Dollars in the top fractions, from one ranking."""
    ranked = R.running(scored(spark, d), [F.desc("p"), F.col("o_orderkey")])
    size = ranked.agg(F.count("*").alias("n"))
    dollars = F.col("y") * F.col("value")
    fs = [0.05, 0.1, 0.2]
    top = lambda f: F.sum(F.when(F.col("rank") <= F.greatest(F.bround(F.col("n") * F.lit(f)), F.lit(1)), dollars))
    sums = ranked.crossJoin(F.broadcast(size)).agg(*[top(f).alias(f"d{k}") for k, f in enumerate(fs)], F.sum(dollars).alias("all"))
    return rounded(sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("fraction"), (F.col(f"d{k}") / F.col("all")).alias("capture")) for k, f in enumerate(fs)]))))


@query(f"""
WITH {TYPE_DAYS}, p AS (SELECT event_type, round(avg(n) FILTER (WHERE isodow(day) < 6), 4) AS weekday, round(avg(n) FILTER (WHERE isodow(day) >= 6), 4) AS weekend FROM u GROUP BY 1) SELECT event_type, weekday, weekend, CASE WHEN weekday >= weekend THEN 'weekday' ELSE 'weekend' END AS busier FROM p""")
def fn_argmax_columns(spark, d):
    late = S.weekday(F.col("day")) >= 5
    p = type_days(spark, d).groupBy("event_type").agg(F.avg(F.when(~late, F.col("n"))).alias("weekday"), F.avg(F.when(late, F.col("n"))).alias("weekend"))
    return rounded(p.withColumn("busier", S.first_largest({"weekday": F.col("weekday"), "weekend": F.col("weekend")})))
