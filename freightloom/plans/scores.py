"""Metrics, lift tables, curves and sweeps over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import metrics as M
from freightloom.operators import ranked as R
from freightloom.plans.panels import TYPE_DAYS, type_days
from freightloom.plans.registry import query, rounded, table

U = "CAST(concat('0x', substr(md5(concat(CAST({0} AS VARCHAR), ':{1}')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE"
SCORED = f"""s AS (SELECT o_orderkey, o_custkey, o_totalprice AS value, o_orderpriority AS priority, o_orderdate, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
  0.7::DOUBLE * CAST(o_orderstatus = 'F' AS INTEGER) * {U.format('o_orderkey', 'a')} + 0.3::DOUBLE * {U.format('o_orderkey', 'b')} AS p FROM orders)"""
TIED = "t AS (SELECT *, round(p, 2) AS score FROM s)"


def scored(spark, d) -> DataFrame:
    """Orders with a label and a made probability that knows something of it."""
    y = (F.col("o_orderstatus") == "F").cast("int")
    p = 0.7 * y * S.uniform(F.col("o_orderkey"), "a") + 0.3 * S.uniform(F.col("o_orderkey"), "b")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"), "o_orderdate", y.alias("y"), p.alias("p"))


def tied(spark, d) -> DataFrame:
    """Scores of two digits, so that many rows tie."""
    return scored(spark, d).withColumn("score", F.round("p", 2))


@query(f"""
WITH {SCORED}, r AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY p DESC, o_orderkey) / (SELECT count(*) FROM s)::DOUBLE * 10) AS BIGINT) AS decile FROM s),
g AS (SELECT decile, count(*) AS n, sum(y)::DOUBLE AS positives FROM r GROUP BY 1)
SELECT decile, n, positives, round(positives / n, 4) AS rate, round(positives / n / (SELECT sum(positives) / sum(n) FROM g), 4) AS lift, round(sum(positives) OVER (ORDER BY decile) / (SELECT sum(positives) FROM g), 4) AS capture FROM g""")
def agg_decile_lift(spark, d):
    return rounded(R.lift(scored(spark, d), [F.desc("p"), F.col("o_orderkey")], F.col("y")))


@query(f"""
WITH {SCORED}, r AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY p * value DESC, o_orderkey) / (SELECT count(*) FROM s)::DOUBLE * 10) AS BIGINT) AS decile FROM s)
SELECT decile, count(*) AS n, round(sum(y * value), 2) AS dollars, round(avg(p), 4) AS mean_p FROM r GROUP BY 1""")
def agg_decile_cost(spark, d):
    df = R.deciles(scored(spark, d), [(F.col("p") * F.col("value")).desc(), F.col("o_orderkey")])
    return df.groupBy("decile").agg(F.count("*").alias("n"), F.round(F.sum(F.col("y") * F.col("value")), 2).alias("dollars"), F.round(F.avg("p"), 4).alias("mean_p"))


@query(f"""
WITH {SCORED}, q AS (SELECT quantile_cont(value, 1/3.0::DOUBLE) AS a, quantile_cont(value, 2/3.0::DOUBLE) AS b FROM s)
SELECT CASE WHEN value <= a THEN 0 WHEN value <= b THEN 1 ELSE 2 END AS tercile, count(*) AS n, round(avg(y), 4) AS rate FROM s, q GROUP BY 1""")
def agg_qcut_tercile(spark, d):
    df = scored(spark, d)
    edges = R.quantile_edges(df, "value", [1 / 3, 2 / 3])
    cut = F.when(F.col("value") <= F.col("q1"), 0).when(F.col("value") <= F.col("q2"), 1).otherwise(2)
    return rounded(df.crossJoin(F.broadcast(edges)).groupBy(cut.alias("tercile")).agg(F.count("*").alias("n"), F.avg("y").alias("rate")))


@query(f"""
WITH {SCORED}, {TIED}, g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) - pos AS above FROM g)
SELECT round(sum((n - pos) * (above + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)), 4) AS auc FROM c""")
def agg_roc_auc(spark, d):
    return rounded(R.roc_auc(tied(spark, d), "score", F.col("y")))


@query(f"""
WITH {SCORED}, {TIED}, g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM g)
SELECT round(sum(pos * (cp::DOUBLE / cn)) / sum(pos), 4) AS ap FROM c""")
def agg_pr_auc(spark, d):
    return rounded(R.average_precision(tied(spark, d), "score", F.col("y")))


@query(f"""
WITH {SCORED}, {TIED}, g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1)
SELECT score, n, CAST(pos AS BIGINT) AS positives, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS cum_n, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS cum_positives FROM g""")
def win_cum_precision_ties(spark, d):
    return R.tie_curve(tied(spark, d), "score", F.col("y"))


@query(f"""
WITH {SCORED}, {TIED}, g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM g)
SELECT coalesce(min(score) FILTER (WHERE cp::DOUBLE / cn >= 0.8), 0.99) AS threshold, round(coalesce(max(cn) FILTER (WHERE cp::DOUBLE / cn >= 0.8), 0) / sum(n)::DOUBLE, 4) AS coverage FROM c""")
def win_pick_threshold(spark, d):
    return rounded(R.lowest_threshold(tied(spark, d), "score", F.col("y"), 0.8))


@query(f"WITH {SCORED} SELECT priority, count(*) AS n, round(avg(pow(p - y, 2)), 4) AS brier, round(avg(p), 4) AS predicted, round(avg(y), 4) AS actual FROM s GROUP BY 1")
def agg_brier(spark, d):
    df = scored(spark, d)
    return rounded(df.groupBy("priority").agg(F.count("*").alias("n"), M.brier(F.col("p"), F.col("y")).alias("brier"), F.avg("p").alias("predicted"), F.avg("y").alias("actual")))


@query(f"""
WITH {SCORED}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s)
SELECT len(list_filter(e, lambda x: x < p)) AS bin, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(y), 4) AS rate FROM s, e GROUP BY 1""")
def agg_calibration_curve(spark, d):
    return rounded(M.calibration(scored(spark, d), "p", F.col("y")))


@query(f"""
WITH {SCORED} SELECT o_orderkey, p FROM s QUALIFY row_number() OVER (ORDER BY p DESC, o_orderkey) <= greatest(round_even((SELECT count(*) FROM s) * 0.05::DOUBLE, 0), 1)""")
def topk_fraction(spark, d):
    return R.top_fraction(scored(spark, d), [F.desc("p"), F.col("o_orderkey")], 0.05).select("o_orderkey", "p")


@query(f"""
WITH {SCORED}, k AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY p DESC, o_orderkey) <= greatest(round_even((SELECT count(*) FROM s) * 0.1::DOUBLE, 0), 1))
SELECT round(avg(y), 4) AS "precision", round(sum(y)::DOUBLE / (SELECT sum(y) FROM s), 4) AS recall, round(sum(y * value) / (SELECT sum(y * value) FROM s), 4) AS dollars FROM k""")
def agg_precision_at_frac(spark, d):
    df = scored(spark, d)
    whole = df.agg(F.sum("y").alias("ys"), F.sum(F.col("y") * F.col("value")).alias("vs"))
    k = R.top_fraction(df, [F.desc("p"), F.col("o_orderkey")], 0.1).agg(F.avg("y").alias("precision"), F.sum("y").alias("a"), F.sum(F.col("y") * F.col("value")).alias("b"))
    return rounded(k.crossJoin(F.broadcast(whole)).select("precision", (F.col("a") / F.col("ys")).alias("recall"), (F.col("b") / F.col("vs")).alias("dollars")))


@query(f"WITH {SCORED}, q AS (SELECT quantile_cont(p, 0.9) AS t FROM s) SELECT round(t, 4) AS threshold, count(*) FILTER (WHERE p >= t) AS flagged, CAST(sum(y) FILTER (WHERE p >= t) AS BIGINT) AS hits FROM s, q GROUP BY t")
def quantile_threshold(spark, d):
    df = scored(spark, d)
    edge = R.quantile_edges(df, "p", [0.9])
    on = F.col("p") >= F.col("q1")
    return rounded(df.crossJoin(F.broadcast(edge)).groupBy(F.col("q1").alias("threshold")).agg(F.count_if(on).alias("flagged"), F.sum(F.when(on, F.col("y"))).alias("hits")))


_ROUTED = """r AS (SELECT o_orderpriority AS actual, CASE WHEN o_totalprice > 300000 THEN '1-URGENT' WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN '2-HIGH' WHEN month(o_orderdate) = 12 THEN '3-MEDIUM' WHEN o_orderstatus = 'P' THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS predicted FROM orders)"""
QUEUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def routed(spark, d) -> DataFrame:
    from freightloom.plans.cleaning import rules_route

    return rules_route(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("actual")), "o_orderkey")


@query(f"""
WITH {_ROUTED}, q AS (SELECT unnest({QUEUES!r}) AS q) SELECT a.q AS actual, b.q AS predicted, round(coalesce((SELECT count(*) FROM r WHERE r.actual = a.q AND r.predicted = b.q)::DOUBLE / (SELECT count(*) FROM r WHERE r.actual = a.q), 0), 4) AS share FROM q a CROSS JOIN q b""")
def agg_confusion(spark, d):
    return rounded(M.confusion(routed(spark, d), "actual", "predicted", QUEUES))


@query(f"""
WITH {_ROUTED}, q AS (SELECT unnest({QUEUES!r}) AS class), c AS (SELECT class, (SELECT count(*) FROM r WHERE actual = class AND predicted = class)::DOUBLE AS tp, (SELECT count(*) FROM r WHERE actual = class) AS support, (SELECT count(*) FROM r WHERE predicted = class) AS flagged FROM q)
SELECT class, round(coalesce(tp / nullif(flagged, 0), 0), 4) AS "precision", round(coalesce(tp / nullif(support, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(flagged + support, 0), 0), 4) AS f1, support FROM c""")
def agg_per_class_prf(spark, d):
    return rounded(M.class_scores(routed(spark, d), "actual", "predicted"))


@query(f"""
WITH {_ROUTED} SELECT round(avg(CASE WHEN actual = '1-URGENT' AND predicted = '5-LOW' THEN 9.0::DOUBLE WHEN actual = '5-LOW' AND predicted = '1-URGENT' THEN 2.0::DOUBLE WHEN actual = '2-HIGH' AND predicted = '4-NOT SPECIFIED' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS mean_cost FROM r""")
def agg_cost_matrix(spark, d):
    costs = {("1-URGENT", "5-LOW"): 9.0, ("5-LOW", "1-URGENT"): 2.0, ("2-HIGH", "4-NOT SPECIFIED"): 4.0}
    return rounded(M.mean_cost(routed(spark, d), "actual", "predicted", costs))


@query(f"""
WITH {SCORED}, c AS (SELECT greatest(p, 1 - p) AS conf, CAST((p >= 0.5) = (y = 1) AS INTEGER) AS ok FROM s), t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.999]::DOUBLE[]) AS threshold)
SELECT threshold, round(count(*) / (SELECT count(*) FROM c)::DOUBLE, 4) AS coverage, round(avg(ok), 4) AS accuracy, round(avg((1 - ok) * 5.0::DOUBLE), 4) AS mean_cost FROM t JOIN c ON conf >= threshold GROUP BY 1""")
def agg_automation_sweep(spark, d):
    df = scored(spark, d).withColumn("ok", ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int"))
    return rounded(M.threshold_sweep(df, F.greatest(F.col("p"), 1 - F.col("p")), F.col("ok"), (1 - F.col("ok")) * 5.0, [0.5, 0.6, 0.7, 0.8, 0.9, 0.999]))


_FORECAST = f"{TYPE_DAYS}, f AS (SELECT event_type, day, n AS actual, lag(n) OVER w AS naive, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean FROM u WINDOW w AS (PARTITION BY event_type ORDER BY day)), g AS (SELECT * FROM f WHERE naive IS NOT NULL)"


def forecasts(spark, d) -> DataFrame:
    """Each type's day with two forecasts that know only days before: yesterday, and the mean of a week."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("day")
    df = type_days(spark, d).select("event_type", "day", F.col("n").alias("actual"), F.lag("n").over(w).alias("naive"), F.avg("n").over(w.rowsBetween(-7, -1)).alias("mean"))
    return df.where("naive IS NOT NULL")


def _row(method: str) -> str:
    return f"SELECT '{method}' AS method, round(sum(abs({method} - actual)) / sum(actual)::DOUBLE, 4) AS wape, round(avg(2 * abs({method} - actual)::DOUBLE / greatest(abs(actual) + abs({method}), 1e-9)), 4) AS smape, round(sum({method} - actual) / sum(actual)::DOUBLE, 4) AS bias, round(avg(greatest(0.8::DOUBLE * (actual - {method}), -0.2::DOUBLE * (actual - {method}))), 4) AS pinball, round(sqrt(avg(pow({method} - actual, 2))), 4) AS rmse, round(quantile_cont(abs({method} - actual)::DOUBLE / greatest(actual, 0.25), 0.5), 4) AS mdape FROM g"


@query(f"WITH {_FORECAST} {_row('naive')} UNION ALL {_row('mean')}")
def agg_metric_row(spark, d):
    """A row of metrics for each method; both come from one pass."""
    df = forecasts(spark, d)
    long = df.select("actual", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("f")) for m in ("naive", "mean")])))
    f, a = F.col("f"), F.col("actual")
    return rounded(long.groupBy("method").agg(M.wape(f, a).alias("wape"), M.smape(f, a).alias("smape"), M.bias(f, a).alias("bias"), M.pinball(f, a, 0.8).alias("pinball"), M.rmse(f, a).alias("rmse"), M.median_ape(f, a).alias("mdape")))


@query(f"WITH {_FORECAST} SELECT event_type, round(sum(abs(naive - actual)) / sum(actual)::DOUBLE, 4) AS naive, round(sum(abs(mean - actual)) / sum(actual)::DOUBLE, 4) AS mean FROM g GROUP BY 1")
def agg_hub_winloss(spark, d):
    a = F.col("actual")
    return rounded(forecasts(spark, d).groupBy("event_type").agg(M.wape(F.col("naive"), a).alias("naive"), M.wape(F.col("mean"), a).alias("mean")))


@query(f"""
WITH {_FORECAST} SELECT event_type, round(100.0::DOUBLE * avg(CAST(actual > ceil(mean * 1.1::DOUBLE) AS INTEGER)), 4) AS understaffed, round(100.0::DOUBLE * sum(greatest(actual - ceil(mean * 1.1::DOUBLE), 0)) / sum(actual), 4) AS uncovered, round(100.0::DOUBLE * sum(greatest(ceil(mean * 1.1::DOUBLE) - actual, 0)) / sum(ceil(mean * 1.1::DOUBLE)), 4) AS idle FROM g GROUP BY 1""")
def agg_staffing(spark, d):
    a, staff = F.col("actual"), F.ceil(F.col("mean") * 1.1)
    df = forecasts(spark, d).groupBy("event_type")
    return rounded(df.agg((100 * F.avg((a > staff).cast("int"))).alias("understaffed"), (100 * F.sum(F.greatest(a - staff, F.lit(0))) / F.sum(a)).alias("uncovered"), (100 * F.sum(F.greatest(staff - a, F.lit(0))) / F.sum(staff)).alias("idle")))


@query(f"""
WITH {_FORECAST} SELECT strftime(day, '%Y-%m') AS month, round(avg(CAST(actual BETWEEN mean * 0.8::DOUBLE AND mean * 1.2::DOUBLE AS INTEGER)), 4) AS coverage, round(avg(mean * 0.4::DOUBLE), 4) AS width FROM g GROUP BY 1""")
def agg_coverage_month(spark, d):
    m = F.col("mean")
    return rounded(forecasts(spark, d).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(M.coverage(m * 0.8, m * 1.2, F.col("actual")).alias("coverage"), F.avg(m * 0.4).alias("width")))


@query(f"WITH {SCORED}, q AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM s WHERE y = 1) SELECT p AS threshold FROM q WHERE i = floor((n + 1) * 0.1::DOUBLE - 1)")
def crc_threshold(spark, d):
    return M.conformal_threshold(scored(spark, d), "p", F.col("y") == 1, 0.1)


@query(f"""
WITH {_FORECAST}, w AS (SELECT greatest(mean * 0.9::DOUBLE - actual, actual - mean * 1.1::DOUBLE) AS e FROM g), r AS (SELECT e, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS n FROM w)
SELECT round(e, 4) AS widening FROM r WHERE i = least(ceil((n + 1) * 0.8::DOUBLE), n)""")
def cqr_qhat(spark, d):
    df = forecasts(spark, d).select("actual", (F.col("mean") * 0.9).alias("low"), (F.col("mean") * 1.1).alias("high"))
    return rounded(M.interval_widening(df, "low", "high", "actual", 0.8))


@query("""
WITH l AS (SELECT c_nationkey AS lane, sum(CAST(o_orderstatus = 'F' AS INTEGER))::DOUBLE AS misses, count(*)::DOUBLE AS volume FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
m AS (SELECT avg(misses / volume) AS m, greatest(var_pop(misses / volume), 1e-6) AS v FROM l), ab AS (SELECT m * greatest(m * (1 - m) / v - 1, 2) AS a, (1 - m) * greatest(m * (1 - m) / v - 1, 2) AS b FROM m)
SELECT lane, round(misses / volume, 4) AS raw, round((a + misses) / (a + b + volume), 4) AS shrunk FROM l, ab""")
def eb_posterior(spark, d):
    """Lane rates shrunk to a Beta prior that is fitted to them by moments."""
    lanes = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("lane"))
    lanes = lanes.agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).cast("double").alias("misses"), F.count("*").alias("volume"))
    rate = F.col("misses") / F.col("volume")
    prior = lanes.agg(F.avg(rate).alias("m"), F.greatest(F.var_pop(rate), F.lit(1e-6)).alias("v"))
    strength = F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(2.0))
    prior = prior.select((F.col("m") * strength).alias("a"), ((1 - F.col("m")) * strength).alias("b"))
    return rounded(lanes.crossJoin(F.broadcast(prior)).select("lane", rate.alias("raw"), ((F.col("a") + F.col("misses")) / (F.col("a") + F.col("b") + F.col("volume"))).alias("shrunk")))
