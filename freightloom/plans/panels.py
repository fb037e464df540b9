"""Panels: user-days and type-days of the events, customers' orders in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import windows as W
from freightloom.plans.registry import query, rounded, table

USER_DAYS = "u AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS failed FROM events GROUP BY 1, 2)"
TYPE_DAYS = "u AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)"


def user_days(spark, d) -> DataFrame:
    """A row for each user and day with events: days without are absent."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max((F.col("event_type") == "error").cast("int")).alias("failed"))


def summed_days(spark, d) -> DataFrame:
    """`user_days` whose values are added in the events' order, however the rows are dealt: for ranks, where the last digit
    of a sum decides between days that are equal but for it."""
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "value", (F.col("event_type") == "error").cast("int").alias("failed"))
    w = Window.partitionBy("user_id", "day").orderBy("event_id")
    # One row for each event, the sum so far in it: no list of a day's events is made.
    run = e.select("user_id", "day", "failed", F.row_number().over(w).alias("_k"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_so_far"))
    return run.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.max_by("_so_far", "_k").alias("total"), F.max("failed").alias("failed"))


def type_days(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""
WITH {USER_DAYS} SELECT a.user_id, a.day, a.n, b.n AS n_lag_7, c.n AS n_lag_1 FROM u a LEFT JOIN u b ON a.user_id = b.user_id AND b.day = a.day - 7 LEFT JOIN u c ON a.user_id = c.user_id AND c.day = a.day - 1""")
def win_lag_calendar(spark, d):
    df = W.calendar_lag(user_days(spark, d), ["user_id"], "day", "n", 7)
    return W.calendar_lag(df, ["user_id"], "day", "n", 1).select("user_id", "day", "n", "n_lag_7", "n_lag_1")


@query(f"""
WITH {USER_DAYS} SELECT a.user_id, a.day, round(CASE WHEN count(b.n) >= 3 THEN avg(b.total) END, 4) AS mean_7
FROM u a LEFT JOIN u b ON a.user_id = b.user_id AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2""")
def win_trailing_mean(spark, d):
    return rounded(W.trailing_mean(user_days(spark, d), ["user_id"], "day", "total", 7, 3, "mean_7").select("user_id", "day", "mean_7"))


@query("""
WITH u AS (SELECT o_custkey % 20 AS lane, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT a.lane, a.week, b.n AS lag_1, c.n AS lag_4, e.n AS lag_52 FROM u a LEFT JOIN u b ON a.lane = b.lane AND b.week = a.week - 7
  LEFT JOIN u c ON a.lane = c.lane AND c.week = a.week - 28 LEFT JOIN u e ON a.lane = e.lane AND e.week = a.week - 364""")
def win_lag_calendar_week(spark, d):
    df = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("lane"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("n"))
    for k in (1, 4, 52):
        df = W.calendar_lag(df, ["lane"], "week", "n", 7 * k, f"lag_{k}")
    return df.drop("n")


@query(f"""
WITH {TYPE_DAYS}, f AS (
  SELECT event_type, day, n, max(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS lag_7,
    CASE WHEN count(n) OVER w >= 5 THEN avg(n) OVER w END AS mean_7 FROM u
  WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT event_type, day, n, lag_7, round(mean_7, 4) AS mean_7, round(coalesce(mean_7, lag_7), 4) AS anchor, CAST(isodow(day) - 1 AS INTEGER) AS dow, CAST(weekofyear(day) AS INTEGER) AS week,
  round(sin(dayofyear(day) * 2 * pi() / 365.25), 4) AS year_sin FROM f""")
def win_build_features_volume(spark, d):
    df = W.calendar_lag(type_days(spark, d), ["event_type"], "day", "n", 7, "lag_7")
    df = W.trailing_mean(df, ["event_type"], "day", "n", 7, 5, "mean_7")
    day = F.col("day")
    return rounded(df.select("event_type", "day", "n", "lag_7", "mean_7", F.coalesce("mean_7", "lag_7").alias("anchor"), S.weekday(day).alias("dow"), F.weekofyear(day).alias("week"), S.cyclic(F.dayofyear(day), 365.25)[0].alias("year_sin")))


@query(f"""
WITH {USER_DAYS}, w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM u)
SELECT user_id, day, round(CASE WHEN count(*) OVER v >= 7 THEN avg(total) OVER v END, 4) AS mean_7, round(CASE WHEN count(*) OVER v >= 7 THEN (avg(i * total) OVER v - avg(i) OVER v * avg(total) OVER v) / 4.0 END, 4) AS slope_7
FROM w WINDOW v AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def win_rolling_slope(spark, d):
    """Slopes go by row, not by calendar."""
    df = user_days(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    args = (["user_id"], ["day"], 7)
    return rounded(df.select("user_id", "day", W.rolling_mean(F.col("total"), *args).alias("mean_7"), W.rolling_slope(F.col("total"), F.col("i"), *args).alias("slope_7")))


@query(f"""
WITH {TYPE_DAYS} SELECT event_type, day, round(CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(total, 0.5) OVER w END, 4) AS middle,
  coalesce(total > 3 * quantile_cont(total, 0.5) OVER w, FALSE) AS is_outlier
FROM u WINDOW w AS (PARTITION BY event_type, isodow(day) ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def win_rolling_median_centered(spark, d):
    df = type_days(spark, d).withColumn("dow", S.weekday(F.col("day")))
    df = df.withColumn("middle", W.centred_median("total", ["event_type", "dow"], ["day"], 3, 3))
    raw = F.percentile("total", F.lit(0.5)).over(Window.partitionBy("event_type", "dow").orderBy("day").rowsBetween(-3, 3))
    return rounded(df.withColumn("is_outlier", F.coalesce(F.col("total") > 3 * raw, F.lit(False))).select("event_type", "day", "middle", "is_outlier"))


@query(f"""
WITH {USER_DAYS}, c AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY user_id ORDER BY day) <> n THEN 1 ELSE 0 END AS changed FROM u),
r AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY day) AS run FROM c)
SELECT user_id, day, count(*) OVER (PARTITION BY user_id, run) >= 4 AS is_frozen FROM r""")
def win_frozen_run(spark, d):
    return W.frozen(user_days(spark, d), ["user_id"], ["day"], "n", 4).select("user_id", "day", "is_frozen")


@query(f"""
WITH {USER_DAYS}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, CASE WHEN n > 1 THEN CAST(n AS DOUBLE) END AS v FROM u),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER p AS i0, min(CASE WHEN v IS NOT NULL THEN i END) OVER q AS i1 FROM g
      WINDOW p AS (PARTITION BY user_id ORDER BY i), q AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT b.user_id, b.day, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN x.v IS NULL THEN y.v WHEN y.v IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (b.i - b.i0) / (b.i1 - b.i0) END, 4) AS v
FROM b LEFT JOIN g x ON x.user_id = b.user_id AND x.i = b.i0 LEFT JOIN g y ON y.user_id = b.user_id AND y.i = b.i1""")
def win_interpolate_linear(spark, d):
    df = user_days(spark, d).withColumn("v", F.when(F.col("n") > 1, F.col("n").cast("double")))
    return rounded(W.interpolated(df, ["user_id"], ["day"], "v").select("user_id", "day", "v"))


@query(f"""
WITH {USER_DAYS} SELECT user_id, day, round(avg(greatest(failed, CAST(n > 4 AS INTEGER))) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rate FROM u""")
def win_dropout_rate(spark, d):
    either = F.greatest(F.col("failed"), (F.col("n") > 4).cast("int"))
    return rounded(user_days(spark, d).select("user_id", "day", F.avg(either).over(W.rolling(["user_id"], ["day"], 7)).alias("rate")))


@query(f"""
WITH {USER_DAYS} SELECT user_id, day, row_number() OVER (PARTITION BY day ORDER BY total DESC, user_id) <= ceil(count(*) OVER (PARTITION BY day) * 0.03::DOUBLE) AS flagged FROM u""")
def win_rank_topfrac_daily(spark, d):
    w = Window.partitionBy("day")
    return summed_days(spark, d).select("user_id", "day", (F.row_number().over(w.orderBy(F.desc("total"), "user_id")) <= F.ceil(F.count("*").over(w) * 0.03)).alias("flagged"))


@query("""
SELECT o_orderkey, coalesce(count(*) OVER w, 0) AS prior_count, round(coalesce(avg(CAST(o_orderstatus = 'F' AS INTEGER)) OVER w, 0), 4) AS prior_rate
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win_causal_history(spark, d):
    df = W.causal_history(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], (F.col("o_orderstatus") == "F").cast("int"), "prior")
    return rounded(df.select("o_orderkey", "prior_count", "prior_rate"))


@query(f"""
WITH {USER_DAYS} SELECT user_id, day, coalesce(max(failed) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 14 DAY FOLLOWING), 0) AS fails_soon FROM u""")
def win_shift_future_label(spark, d):
    return W.event_ahead(user_days(spark, d), ["user_id"], "day", "failed", 14, "fails_soon").select("user_id", "day", "fails_soon")


@query(f"""
WITH {USER_DAYS}, a AS (SELECT user_id, day FROM u WHERE failed = 1), c AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= 3 THEN 0 ELSE 1 END AS opens FROM a),
e AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY day) AS k FROM c)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS n_alarms FROM e GROUP BY user_id, k""")
def win_episode_sessionize(spark, d):
    return W.episodes(user_days(spark, d).where("failed = 1").select("user_id", "day"), ["user_id"], "day", 3)


@query(f"""
WITH {USER_DAYS} SELECT user_id, day, round(100 * (avg(total) OVER a / avg(total) OVER b - 1), 4) AS trend FROM u
WINDOW a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)""")
def win_trend_pct(spark, d):
    mean = lambda n: F.avg("total").over(W.rolling(["user_id"], ["day"], n))
    return rounded(user_days(spark, d).select("user_id", "day", (100 * (S.divided(mean(7), mean(28)) - 1)).alias("trend")))


@query(f"""
WITH {USER_DAYS} SELECT user_id, day, failed FROM u WHERE day >= (SELECT min(day) FROM u) + 7""")
def drop_warmup(spark, d):
    df = user_days(spark, d)
    start = df.agg(F.date_add(F.min("day"), 7).alias("start"))
    return df.crossJoin(F.broadcast(start)).where("day >= start").select("user_id", "day", "failed")


@query(f"""
WITH {USER_DAYS}, k AS (SELECT DISTINCT user_id FROM u), t AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM u), (SELECT max(day) FROM u), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT k.user_id, t.day, u.n FROM k CROSS JOIN t LEFT JOIN u ON u.user_id = k.user_id AND u.day = t.day""")
def reindex_calendar(spark, d):
    return W.on_calendar(user_days(spark, d), ["user_id"], "day").select("user_id", "day", "n")


@query(f"""
WITH {USER_DAYS} SELECT (SELECT count(DISTINCT user_id) FROM u) * (date_diff('day', (SELECT min(day) FROM u), (SELECT max(day) FROM u)) + 1) - (SELECT count(*) FROM u) AS n_gaps,
  (SELECT count(DISTINCT user_id) FROM u) AS n_users, (SELECT count(DISTINCT day) FROM u) AS n_days""")
def agg_gap_count(spark, d):
    days = F.datediff(F.max("day"), F.min("day")) + 1
    return user_days(spark, d).agg((F.count_distinct("user_id") * days - F.count("*")).alias("n_gaps"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("day").alias("n_days"))


@query(f"WITH {USER_DAYS} SELECT user_id, count(*) AS n_days FROM u GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT day) FROM u)")
def agg_size_having(spark, d):
    df = user_days(spark, d)
    every = df.agg(F.count_distinct("day").alias("every"))
    return df.groupBy("user_id").agg(F.count("*").alias("n_days")).crossJoin(F.broadcast(every)).where("n_days < every").drop("every")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
def agg_month_period(spark, d):
    return rounded(table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("revenue")), 2)


@query("""
SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
  round(sin(dayofyear(o_orderdate) * 2 * pi() / 365.25), 4) AS year_sin, round(cos(dayofyear(o_orderdate) * 2 * pi() / 365.25), 4) AS year_cos,
  (month(o_orderdate) * 100 + day(o_orderdate) >= 1120 OR month(o_orderdate) * 100 + day(o_orderdate) <= 105) AS in_peak FROM orders""")
def fn_date_parts(spark, d):
    o = F.col("o_orderdate")
    s, c = S.cyclic(F.dayofyear(o), 365.25)
    return rounded(table(spark, d, "orders").select("o_orderkey", S.weekday(o).alias("dow"), F.month(o).alias("month"), F.dayofyear(o).alias("doy"), F.weekofyear(o).alias("week"), s.alias("year_sin"), c.alias("year_cos"), S.in_season(o, (11, 20), (1, 5)).alias("in_peak")))


@query("""
WITH h AS (SELECT unnest(['1996-12-25', '1997-07-04', '1997-12-25', '1998-07-04']::DATE[]) AS h)
SELECT o_orderkey, CAST(least(greatest(arg_min(date_diff('day', h, CAST(o_orderdate AS DATE)), abs(date_diff('day', h, CAST(o_orderdate AS DATE))) * 10 + (year(h) - 1996)), -30), 30) AS INTEGER) AS gap FROM orders CROSS JOIN h GROUP BY o_orderkey""")
def join_nearest_date(spark, d):
    """The calendar is a short literal: it is searched within the row, not joined."""
    days = ["1996-12-25", "1997-07-04", "1997-12-25", "1998-07-04"]
    return table(spark, d, "orders").select("o_orderkey", S.nearest_signed_days(F.to_date("o_orderdate"), days, 30).alias("gap"))


@query("""
SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0, -60), 60), 4) AS transit FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey""")
def fn_duration_days(spark, d):
    df = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.clipped(S.days_between(F.col("l_shipdate"), F.col("o_orderdate")), -60, 60).alias("transit")))


@query("SELECT event_id, printf('%02d:%02d', hour(ts), minute(ts)) AS clock FROM events")
def fn_clock_format(spark, d):
    t = F.col("ts")
    return table(spark, d, "events").select("event_id", S.clock(F.hour(t) * 60 + F.minute(t)).alias("clock"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """The batch form of the streaming query in `streaming.events`."""
    from freightloom.streaming import events

    return rounded(events.tumbling(table(spark, d, "events"), "1 day").select(F.to_date("start").alias("day"), "event_type", "n", "total"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k.k""")
def stream_session(spark, d):
    from freightloom.streaming import events

    return events.sessions(table(spark, d, "events"), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH e AS (SELECT event_type, ts FROM events), w AS (SELECT event_type, CAST(unnest([CAST(ts AS DATE), CAST(ts AS DATE) - 1, CAST(ts AS DATE) - 2]) AS DATE) AS day FROM e)
SELECT day, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding(spark, d):
    from freightloom.streaming import events

    return events.sliding(table(spark, d, "events"), "3 days", "1 day").select(F.to_date("start").alias("day"), "event_type", "n")
