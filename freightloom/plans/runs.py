"""Whole runs: policies compared, records matched, bookings swept, detectors scored, models of several classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import boosting as B
from freightloom.operators import decide as D
from freightloom.operators import joins as J
from freightloom.operators import models as M
from freightloom.operators import ranked as R
from freightloom.plans.decisions import _ACTED, standardised
from freightloom.plans.models import FEATURES, _split
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.scores import SCORED, scored


@query(f"""
WITH {SCORED}, {_ACTED}, w AS (SELECT b.*, s.value, s.y, row_number() OVER (ORDER BY s.p DESC, o_orderkey) AS by_risk, row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':pick')), o_orderkey) AS by_chance FROM b JOIN s USING (o_orderkey)),
n AS (SELECT y * 0.6::DOUBLE * (15 + least(0.002::DOUBLE * value, 200)) - 40 AS net, * FROM w)
SELECT 'risk' AS policy, round(sum(net) FILTER (WHERE by_risk <= 75), 2) AS net, 3000.0::DOUBLE AS spend FROM n UNION ALL SELECT 'random', round(sum(net) FILTER (WHERE by_chance <= 75), 2), 3000.0::DOUBLE FROM n UNION ALL SELECT 'none', 0.0::DOUBLE, 0.0::DOUBLE""")
def alloc_evaluate(spark, d):
    """What each policy of one budget saves once outcomes are known."""
    s = scored(spark, d)
    net = F.col("y") * 0.6 * (15 + F.least(0.002 * F.col("value"), F.lit(200.0))) - 40
    s = s.withColumn("net", net).withColumn("draw", F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":pick"))))
    rows = {"risk": [F.desc("p"), F.col("o_orderkey")], "random": [F.col("draw"), F.col("o_orderkey")]}
    out = None
    for name, order in rows.items():
        top = s.orderBy(*order).limit(75).agg(F.round(F.sum("net"), 2).alias("net")).select(F.lit(name).alias("policy"), "net", F.lit(3000.0).alias("spend"))
        out = top if out is None else out.unionByName(top)
    none = s.agg(F.lit(0.0).alias("net")).select(F.lit("none").alias("policy"), "net", F.lit(0.0).alias("spend"))
    return out.unionByName(none)


@query(f"WITH {SCORED}, m AS (SELECT unnest([1.0, 1.1, 1.2, 1.3]::DOUBLE[]) AS m) SELECT m AS multiplier, round(avg(value * (m - 0.9::DOUBLE) / (1 + exp(8 * (m - 1.2::DOUBLE) - p))), 2) AS mean_ev FROM s CROSS JOIN m GROUP BY 1 ORDER BY avg(value * (m - 0.9::DOUBLE) / (1 + exp(8 * (m - 1.2::DOUBLE) - p))) DESC LIMIT 1")
def price_flat_choice(spark, d):
    """The one multiplier of the largest mean value: each row is scored at all of them in itself."""
    v, p = F.col("value"), F.col("p")
    ms = (1.0, 1.1, 1.2, 1.3)
    sums = scored(spark, d).agg(*[F.avg(v * (m - 0.9) / (1 + F.exp(F.lit(8 * (m - 1.2)) - p))).alias(f"e{k}") for k, m in enumerate(ms)])
    best = F.array_max(F.array(*[F.struct(F.col(f"e{k}").alias("ev"), F.lit(m).alias("m")) for k, m in enumerate(ms)]))
    return sums.select(best.alias("b")).select(F.col("b.m").alias("multiplier"), F.round("b.ev", 2).alias("mean_ev"))


_DEMAND = "w AS (SELECT o_custkey % 20 AS lane, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*)::DOUBLE AS demand FROM orders GROUP BY 1, 2)"


def _demand(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("lane"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("demand"))


@query(f"WITH {_DEMAND}, p AS (SELECT unnest([1200, 1500, 1900, 2500]::DOUBLE[]) AS spot), q AS (SELECT lane, spot, ceil(quantile_cont(demand, 0.5)) AS mid, list(demand) AS ds FROM w CROSS JOIN p GROUP BY 1, 2) SELECT spot, round(sum(mid * 1000 * len(ds) + list_sum(list_transform(ds, lambda x: greatest(x - mid, 0))) * spot), 2) AS cost FROM q GROUP BY 1")
def agg_spot_sweep(spark, d):
    """Cost of one booking rule over a sweep of spot prices; a lane's shortfall is summed once."""
    w = _demand(spark, d)
    w = w.join(w.groupBy("lane").agg(F.ceil(F.percentile("demand", 0.5)).alias("mid")), "lane")
    sums = w.agg(F.sum(F.col("mid") * 1000).alias("base"), F.sum(F.greatest(F.col("demand") - F.col("mid"), F.lit(0.0))).alias("short"))
    return sums.select(F.explode(F.lit([1200.0, 1500.0, 1900.0, 2500.0])).alias("spot"), "base", "short").select("spot", F.round(F.col("base") + F.col("short") * F.col("spot"), 2).alias("cost"))


@query(f"WITH {_DEMAND}, b AS (SELECT lane, ceil(avg(demand)) AS booked FROM w GROUP BY 1) SELECT lane, booked, round(avg(booked * 1000 + greatest(demand - booked, 0) * 1900 - greatest(booked - demand, 0) * 300), 4) AS expected FROM w JOIN b USING (lane) GROUP BY 1, 2")
def newsvendor_expected(spark, d):
    w = _demand(spark, d)
    w = w.join(w.groupBy("lane").agg(F.ceil(F.avg("demand")).cast("double").alias("booked")), "lane")
    return rounded(w.groupBy("lane", "booked").agg(F.avg(D.booking_costs(F.col("demand"), F.col("booked"), 1000.0, 1900.0, 300.0)["total"]).alias("expected")))


@query()
def score_detector(spark, d):
    """Alarms of the coupled detector against failures: share found, and days to the first alarm."""
    from freightloom.plans.panels import user_days

    alarms = D.coupled_cusum(standardised(spark, d), "day", "user_id", "z", "weight", 0.25, 2.0, 1.0).where("alarm").select(F.col("lane").cast("long").alias("user_id"), F.col("day").alias("found"))
    onsets = user_days(spark, d).where("failed = 1").groupBy("user_id").agg(F.min("day").alias("onset"))
    out = J.asof_after(onsets, alarms, ["user_id"], "onset", "found")
    return rounded(out.agg(F.count("*").alias("onsets"), F.count("found").alias("found"), F.avg(F.datediff("found", "onset")).alias("mean_delay")))


@query()
def ml_multiclass(spark, d):
    """The probability of each of three flags for later lines, by boosted trees."""
    train, test = _split(spark, d)
    keyed = table(spark, d, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    label = S.looked_up(F.col("l_returnflag"), {"A": 0.0, "N": 1.0, "R": 2.0})
    labels = keyed.select(key.alias("line"), label.alias("flag")).dropDuplicates(["line"])
    model = B.fit(train.join(labels, "line"), FEATURES, "flag", loss="softmax", classes=3, rounds=5)
    p = model.chances()
    return rounded(test.select("line", p[0].alias("p_a"), p[1].alias("p_n"), p[2].alias("p_r")))


@query()
def card_example_commit(spark, d):
    """The riskiest test line and what makes it so."""
    train, test = _split(spark, d)
    model = M.logistic(train, FEATURES, "returned")
    top = R.top_fraction(M.probability(model, test), [F.desc("p"), F.col("line")], 0.0).drop("rank")
    return rounded(M.largest_contributions(M.contributions(model, top, "line", FEATURES), "line", 4))
