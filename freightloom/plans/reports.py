"""Reports: grouped summaries, policies against baselines, cases picked for a card, detectors against truth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.operators import decide as D
from freightloom.operators import ranked as R
from freightloom.plans.decisions import _ACTED, acted
from freightloom.plans.panels import TYPE_DAYS, USER_DAYS, summed_days, type_days, user_days
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.scores import _FORECAST, SCORED, forecasts, scored


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice), 4) AS price, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS first_supplier, arg_min(l_partkey, l_linenumber * 1000000000000 + l_suppkey * 1000000 + l_partkey) AS first_part FROM lineitem GROUP BY 1")
def agg_group_multi(spark, d):
    """Counts, sums and firsts in a stated order."""
    first = lambda c, *o: F.min_by(c, F.struct(*o))
    return rounded(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), first("l_suppkey", "l_linenumber", "l_suppkey").alias("first_supplier"), first("l_partkey", "l_linenumber", "l_suppkey", "l_partkey").alias("first_part")))


@query("SELECT c_nationkey AS nation, round(avg(c_acctbal), 4) AS balance, round(avg(c_custkey), 4) AS key, round(quantile_cont(c_acctbal, 0.5), 4) AS middle FROM customer GROUP BY 1")
def agg_mean_two(spark, d):
    """Means by nation, and the exact median, which no task gets a nation's rows for."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal", "c_custkey")
    middle = R.group_quantiles(c, ["nation"], "c_acctbal", [0.5], ["middle"])
    return rounded(c.groupBy("nation").agg(F.avg("c_acctbal").alias("balance"), F.avg("c_custkey").alias("key")).join(middle, "nation"))


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem")
def agg_count_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.to_date("l_shipdate")).alias("days"))


@query(f"WITH {SCORED} SELECT 'all' AS part, count(*) AS n, round(avg(y), 4) AS rate FROM s UNION ALL SELECT 'large', count(*), round(avg(y), 4) FROM s WHERE value > 200000 UNION ALL SELECT priority, count(*), round(avg(y), 4) FROM s GROUP BY 1")
def agg_mask_subset(spark, d):
    """Overall, in a mask, and by segment: each row is summed once by segment and mask."""
    by = scored(spark, d).groupBy("priority", (F.col("value") > 200000).alias("large")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    parts = F.array_compact(F.array(F.lit("all"), F.when(F.col("large"), "large"), F.col("priority")))
    return rounded(by.select(F.explode(parts).alias("part"), "n", "y").groupBy("part").agg(F.sum("n").alias("n"), (F.sum("y") / F.sum("n")).alias("rate")))


@query(f"WITH {TYPE_DAYS}, m AS (SELECT event_type, avg(n) AS mean FROM u GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY mean, event_type) - 1 AS i, count(*) OVER () AS k FROM m) SELECT event_type, CASE WHEN i < k / 3.0::DOUBLE THEN 'small' WHEN i < 2 * k / 3.0::DOUBLE THEN 'middle' ELSE 'large' END AS size FROM r")
def agg_hub_terciles(spark, d):
    means = R.running(type_days(spark, d).groupBy("event_type").agg(F.avg("n").alias("mean")), [F.col("mean"), F.col("event_type")])
    n = type_days(spark, d).agg(F.count_distinct("event_type").alias("k"))
    i = F.col("rank") - 1
    return means.crossJoin(F.broadcast(n)).select("event_type", F.when(i < F.col("k") / 3, "small").when(i < 2 * F.col("k") / 3, "middle").otherwise("large").alias("size"))


@query(f"WITH {SCORED}, r AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY p, o_orderkey) / (SELECT count(*) FROM s)::DOUBLE * 10) AS BIGINT) AS decile FROM s) SELECT decile, round(avg(value), 2) AS value, round(avg(p), 4) AS p FROM r GROUP BY 1")
def agg_qcut_rank_decile(spark, d):
    df = R.deciles(scored(spark, d), [F.col("p"), F.col("o_orderkey")])
    return df.groupBy("decile").agg(F.round(F.avg("value"), 2).alias("value"), F.round(F.avg("p"), 4).alias("p"))


@query("""
WITH t AS (SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS days, l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey), q AS (SELECT l_linestatus, ceil(quantile_cont(days, 0.5)) AS p50, ceil(quantile_cont(days, 0.9)) AS p90 FROM t GROUP BY 1)
SELECT l_linestatus, p50::DOUBLE AS p50, p90::DOUBLE AS p90, round(avg(CAST(days <= p50 AS INTEGER)), 4) AS kept_50, round(avg(CAST(days <= p90 AS INTEGER)), 4) AS kept_90 FROM t JOIN q USING (l_linestatus) GROUP BY 1, 2, 3""")
def agg_promise_table(spark, d):
    """Promises at rounded-up quantiles, and the share that arrives by them."""
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_linestatus", S.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))
    q = t.groupBy("l_linestatus").agg(*[F.ceil(F.percentile("days", a)).cast("double").alias(n) for n, a in (("p50", 0.5), ("p90", 0.9))])
    kept = [F.avg((F.col("days") <= F.col(p)).cast("int")).alias(k) for p, k in (("p50", "kept_50"), ("p90", "kept_90"))]
    return rounded(t.join(F.broadcast(q), "l_linestatus").groupBy("l_linestatus", "p50", "p90").agg(*kept))


@query(f"WITH {_FORECAST} SELECT round(avg(abs(mean - actual)), 4) AS mae, round(sqrt(avg(pow(mean - actual, 2))), 4) AS rmse, round(quantile_cont(abs(mean - actual) / greatest(actual, 0.25::DOUBLE), 0.5), 4) AS mdape, round(avg(CAST(actual BETWEEN mean * 0.8::DOUBLE AND mean * 1.2::DOUBLE AS INTEGER)), 4) AS coverage FROM g")
def agg_point_metrics(spark, d):
    from freightloom.operators import metrics as M

    f, a = F.col("mean"), F.col("actual")
    return rounded(forecasts(spark, d).agg(M.mae(f, a).alias("mae"), M.rmse(f, a).alias("rmse"), M.median_ape(f, a).alias("mdape"), M.coverage(f * 0.8, f * 1.2, a).alias("coverage")))


@query(f"""
WITH {SCORED}, t AS (SELECT unnest([0.9, 0.7, 0.5, 0.3, 0.1]::DOUBLE[]) AS threshold)
SELECT threshold, count(p) AS accepted, round(count(p) / (SELECT count(*) FROM s)::DOUBLE, 4) AS coverage, round(coalesce(avg(y), 1.0), 4) AS "precision" FROM t LEFT JOIN s ON p >= threshold GROUP BY 1""")
def agg_threshold_table(spark, d):
    """At each threshold; precision is 1 where nothing is accepted. Rows are counted once by the thresholds they reach."""
    ts = [0.1, 0.3, 0.5, 0.7, 0.9]
    steps = scored(spark, d).groupBy(F.size(F.filter(F.lit(ts), lambda t: t <= F.col("p"))).alias("step")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    long = steps.select(F.explode(F.slice(F.lit(ts), F.lit(1), F.col("step"))).alias("threshold"), "n", "y")
    sums = long.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    every = steps.agg(F.sum("n").alias("total"), F.lit(ts).alias("ts")).select("total", F.explode("ts").alias("threshold"))
    n = F.coalesce("n", F.lit(0))
    return rounded(every.join(sums, "threshold", "left").select("threshold", n.alias("accepted"), (n / F.col("total")).alias("coverage"), F.coalesce(F.col("y") / F.col("n"), F.lit(1.0)).alias("precision")))


@query(f"""
WITH {SCORED}, {_ACTED}, r AS (SELECT b.*, CAST(ceil(row_number() OVER (ORDER BY b.p DESC, o_orderkey) / (SELECT count(*) FROM b)::DOUBLE * 10) AS BIGINT) AS decile FROM b)
SELECT decile, count(*) FILTER (WHERE action = 'none') AS "none", count(*) FILTER (WHERE action = 'call') AS call, count(*) FILTER (WHERE action = 'upgrade') AS upgrade, count(*) FILTER (WHERE action = 'courier') AS courier FROM r GROUP BY 1""")
def agg_unstack_mix(spark, d):
    df = R.deciles(acted(spark, d), [F.desc("p"), F.col("o_orderkey")])
    return df.groupBy("decile").pivot("action", ["none", "call", "upgrade", "courier"]).count().na.fill(0)


@query(f"""
WITH {SCORED}, a AS (SELECT priority, sum(value * 0.1::DOUBLE) AS base, sum(value * 0.1::DOUBLE * (1 + p)) AS model FROM s GROUP BY 1)
SELECT priority, round(base, 2) AS base, round(model, 2) AS model, round(100 * (model / base - 1), 4) AS uplift, round((model - base) / (SELECT sum(model - base) FROM a), 4) AS share FROM a""")
def agg_segment_uplift(spark, d):
    a = scored(spark, d).groupBy("priority").agg(F.sum(F.col("value") * 0.1).alias("base"), F.sum(F.col("value") * 0.1 * (1 + F.col("p"))).alias("model"))
    gain = F.col("model") - F.col("base")
    return a.select("priority", F.round("base", 2).alias("base"), F.round("model", 2).alias("model"), F.round(100 * (F.col("model") / F.col("base") - 1), 4).alias("uplift"), F.round(gain / F.sum(gain).over(Window.partitionBy()), 4).alias("share"))


@query(f"""
WITH {SCORED}, m AS (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2]::DOUBLE[]) AS scale) SELECT scale, round(avg(1 / (1 + exp(5 * (scale - 1) - p))), 4) AS win_rate, round(avg(value * (scale - 0.75::DOUBLE) / (1 + exp(5 * (scale - 1) - p))), 2) AS margin FROM s CROSS JOIN m GROUP BY 1""")
def agg_frontier(spark, d):
    """Each row is scored at every scale inside itself; only sums leave the task."""
    win = lambda s: S.sigmoid(-(F.lit(5 * (s - 1)) - F.col("p")))
    scales = [0.8, 0.9, 1.0, 1.1, 1.2]
    sums = scored(spark, d).agg(*[x for k, s in enumerate(scales) for x in (F.avg(win(s)).alias(f"w{k}"), F.avg(F.col("value") * (s - 0.75) * win(s)).alias(f"m{k}"))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(s).alias("scale"), F.round(f"w{k}", 4).alias("win_rate"), F.round(f"m{k}", 2).alias("margin")) for k, s in enumerate(scales)])))


@query(f"""
WITH {USER_DAYS}, f AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, user_id) <= 5 AS flagged FROM u), g AS (SELECT day, sum(CAST(flagged AS INTEGER) * failed)::DOUBLE AS hits, sum(CAST(flagged AS INTEGER)) AS n, sum(failed) AS bad FROM f GROUP BY 1)
SELECT round(avg(hits / n), 4) AS "precision", round(avg(hits / nullif(bad, 0)), 4) AS recall FROM g""")
def agg_capacity_metrics(spark, d):
    """By day first, then the mean over days; a day without failures has no recall."""
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("total"), "user_id"))
    f = summed_days(spark, d).withColumn("flagged", (rank <= 5).cast("int"))
    g = f.groupBy("day").agg(F.sum(F.col("flagged") * F.col("failed")).alias("hits"), F.sum("flagged").alias("n"), F.sum("failed").alias("bad"))
    return rounded(g.agg(F.avg(F.col("hits") / F.col("n")).alias("precision"), F.avg(F.try_divide("hits", "bad")).alias("recall")))


@query(f"WITH {SCORED} SELECT priority, count(*) AS n, round(avg(value), 2) AS value, round(avg(p), 4) AS predicted, round(avg(y), 4) AS actual, round(avg(p - y), 4) AS gap FROM s GROUP BY 1")
def agg_segment_autopsy(spark, d):
    m = lambda c, k=4: F.round(F.avg(c), k)
    return scored(spark, d).groupBy("priority").agg(F.count("*").alias("n"), m("value", 2).alias("value"), m("p").alias("predicted"), m("y").alias("actual"), m(F.col("p") - F.col("y")).alias("gap"))


@query("""
WITH z AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, [('overstrain', l_discount > 0.05 AND l_quantity > 30), ('power', l_tax < 0.02 AND l_extendedprice > 50000), ('wear', l_quantity >= 45)] AS zs FROM lineitem), e AS (SELECT y, unnest(zs) AS t FROM z)
SELECT t[1] AS zone, count(*) FILTER (WHERE t[2]) AS n_in, round(avg(y) FILTER (WHERE t[2]), 4) AS rate_in, round(avg(y) FILTER (WHERE NOT t[2]), 4) AS rate_out FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE t[2]) > 0""")
def agg_physics_check(spark, d):
    zones = {"overstrain": (F.col("l_discount") > 0.05) & (F.col("l_quantity") > 30), "power": (F.col("l_tax") < 0.02) & (F.col("l_extendedprice") > 50000), "wear": F.col("l_quantity") >= 45}
    long = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.inline(F.array(*[F.struct(F.lit(k).alias("zone"), v.alias("inside")) for k, v in zones.items()])))
    out = long.groupBy("zone").agg(F.count_if("inside").alias("n_in"), F.avg(F.when(F.col("inside"), F.col("y"))).alias("rate_in"), F.avg(F.when(~F.col("inside"), F.col("y"))).alias("rate_out"))
    return rounded(out.where("n_in > 0"))


@query(f"WITH {SCORED}, a AS (SELECT CASE WHEN p > 0.5 THEN 'model' ELSE 'rest' END AS policy, value FROM s), b AS (SELECT policy, count(*) AS n, sum(value) AS total FROM a GROUP BY 1) SELECT policy, n, round(total, 2) AS total, round(total - (SELECT total FROM b WHERE policy = 'rest'), 2) AS delta FROM b")
def agg_policy_vs_baseline(spark, d):
    b = scored(spark, d).groupBy(F.when(F.col("p") > 0.5, "model").otherwise("rest").alias("policy")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    base = F.max(F.when(F.col("policy") == "rest", F.col("total"))).over(Window.partitionBy())
    return rounded(b.select("policy", "n", "total", (F.col("total") - base).alias("delta")), 2)


@query("""
WITH w AS (SELECT o_custkey % 20 AS lane, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*)::DOUBLE AS demand FROM orders GROUP BY 1, 2), b AS (SELECT lane, ceil(avg(demand)) AS booked FROM w GROUP BY 1)
SELECT lane, round(avg(booked * 10.0::DOUBLE), 4) AS committed, round(avg(greatest(demand - booked, 0) * 19.0::DOUBLE), 4) AS spot, round(avg(greatest(booked - demand, 0) * 2.0::DOUBLE), 4) AS salvage, round(1 - sum(greatest(demand - booked, 0)) / sum(demand), 4) AS service FROM w JOIN b USING (lane) GROUP BY 1""")
def agg_cost_components(spark, d):
    w = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("lane"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("demand"))
    w = w.join(w.groupBy("lane").agg(F.ceil(F.avg("demand")).alias("booked")), "lane")
    cost = D.booking_costs(F.col("demand"), F.col("booked"), 10.0, 19.0, 2.0)
    short = F.greatest(F.col("demand") - F.col("booked"), F.lit(0.0))
    return rounded(w.groupBy("lane").agg(*[F.avg(cost[k]).alias(k) for k in ("committed", "spot", "salvage")], (1 - F.sum(short) / F.sum("demand")).alias("service")))


@query("SELECT p_brand AS reason, count(*) AS n FROM part GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, p_brand) <= 10")
def agg_value_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query(f"WITH {SCORED} SELECT arg_max(o_orderkey, p) AS o_orderkey, round(max(p), 4) AS p FROM s WHERE priority = '1-URGENT'")
def idxmax_row(spark, d):
    return rounded(scored(spark, d).where("priority = '1-URGENT'").agg(F.max_by("o_orderkey", "p").alias("o_orderkey"), F.max("p").alias("p")))


@query(f"WITH {SCORED} SELECT priority, o_orderkey, round(p, 4) AS p FROM s QUALIFY row_number() OVER (PARTITION BY priority ORDER BY p, o_orderkey) <= 6")
def nsmallest_rank(spark, d):
    w = Window.partitionBy("priority").orderBy("p", "o_orderkey")
    return rounded(scored(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 6").select("priority", "o_orderkey", "p"))


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS i FROM s WHERE y = 1) SELECT o_orderkey, round(p, 4) AS p FROM r WHERE i = 1 + (SELECT count(*) FROM r) // 2")
def pick_middle_row(spark, d):
    hits = scored(spark, d).where("y = 1")
    n = hits.agg((1 + F.floor(F.count("*") / 2)).alias("k"))
    return rounded(R.running(hits, [F.col("p"), F.col("o_orderkey")]).crossJoin(F.broadcast(n)).where("rank = k").select("o_orderkey", "p"))


@query(f"WITH {SCORED} SELECT o_orderkey FROM s QUALIFY row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':pick')), o_orderkey) <= 50")
def topk_random(spark, d):
    """A seeded draw without replacement: the smallest hashes."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":pick"))), "o_orderkey").limit(50)


@query("""
WITH m AS (SELECT c_nationkey AS lane, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS volume, count(*) FILTER (WHERE o_orderstatus = 'F') AS misses FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), b AS (SELECT lane, sum(misses)::DOUBLE / sum(volume) AS rate FROM m GROUP BY 1)
SELECT lane, month, misses FROM m JOIN b USING (lane) WHERE volume >= 5 AND misses > rate * volume + 2 * sqrt(volume * rate * (1 - rate))""")
def monthly_flag(spark, d):
    """Months whose misses lie more than two deviations over the lane's own rate; thin months are passed over."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    m = o.groupBy(F.col("c_nationkey").alias("lane"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("volume"), F.count_if(F.col("o_orderstatus") == "F").alias("misses"))
    w = Window.partitionBy("lane")
    rate, v = F.sum("misses").over(w) / F.sum("volume").over(w), F.col("volume")
    return m.withColumn("limit", rate * v + 2 * F.sqrt(v * rate * (1 - rate))).where("volume >= 5 AND misses > `limit`").select("lane", "month", "misses")


@query(f"""
WITH {USER_DAYS}, m AS (SELECT user_id, avg(total) AS mean FROM u GROUP BY 1) SELECT day, round(sum(n * least(greatest(total - mean, -20), 20)) / sum(n), 4) AS shared FROM u JOIN m USING (user_id) GROUP BY 1""")
def global_effect_weighted(spark, d):
    """The day's weighted mean of clipped deviations."""
    u = user_days(spark, d).withColumn("gap", F.col("total") - F.avg("total").over(Window.partitionBy("user_id")))
    return rounded(u.groupBy("day").agg((F.sum(F.col("n") * S.clipped(F.col("gap"), -20, 20)) / F.sum("n")).alias("shared")))


@query(f"""
WITH {USER_DAYS}, o AS (SELECT user_id, min(day) AS onset FROM u WHERE failed = 1 GROUP BY 1), a AS (SELECT user_id, day FROM u WHERE n > 3)
SELECT o.user_id, onset, min(a.day) AS detected, CAST(min(a.day) - onset AS BIGINT) AS delay FROM o LEFT JOIN a ON a.user_id = o.user_id AND a.day >= onset GROUP BY 1, 2""")
def delay_table(spark, d):
    """First alarm at or after each onset, and its delay in days."""
    from freightloom.operators.joins import asof_after

    u = user_days(spark, d)
    onsets = u.where("failed = 1").groupBy("user_id").agg(F.min("day").alias("onset"))
    out = asof_after(onsets, u.where("n > 3").select("user_id", F.col("day").alias("detected")), ["user_id"], "onset", "detected")
    return out.select("user_id", "onset", "detected", F.datediff("detected", "onset").cast("long").alias("delay"))


@query(f"WITH {USER_DAYS}, a AS (SELECT user_id, day FROM u WHERE n > 3) SELECT count(DISTINCT user_id) AS lanes FROM a WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'")
def surge_check(spark, d):
    return user_days(spark, d).where("n > 3 AND day BETWEEN date '2024-01-10' AND date '2024-01-14'").agg(F.count_distinct("user_id").alias("lanes"))


@query(f"WITH {SCORED}, e AS (SELECT *, row_number() OVER (ORDER BY p DESC, o_orderkey) AS r FROM s WHERE value > 100000) SELECT 'model' AS policy, round(sum(y * value * 0.01::DOUBLE), 2) AS savings, 500 * 4.0::DOUBLE AS spend FROM e WHERE r <= 500 UNION ALL SELECT 'everyone', round(sum(y * value * 0.01::DOUBLE), 2), count(*) * 4.0::DOUBLE FROM e")
def target_simulate(spark, d):
    """Targeting by score against everyone eligible."""
    e = scored(spark, d).where("value > 100000").withColumn("gain", F.col("y") * F.col("value") * 0.01)
    ranked = R.running(e, [F.desc("p"), F.col("o_orderkey")])
    sums = ranked.agg(F.sum(F.when(F.col("rank") <= 500, F.col("gain"))).alias("a"), F.sum("gain").alias("b"), F.count("*").alias("n"))
    row = lambda name, s, spend: F.struct(F.lit(name).alias("policy"), F.round(s, 2).alias("savings"), spend.alias("spend"))
    return sums.select(F.inline(F.array(row("model", "a", F.lit(2000.0)), row("everyone", "b", F.col("n") * 4.0))))


@query(f"WITH {SCORED}, q AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM s WHERE y = 1), t AS (SELECT a, (SELECT p FROM q WHERE i = floor((n + 1) * a - 1)) AS threshold FROM (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS a)) SELECT a AS alpha, round(avg(CAST(p >= threshold AS INTEGER)) FILTER (WHERE y = 1), 4) AS capture, round(avg(CAST(p >= threshold AS INTEGER)), 4) AS flag_rate FROM s CROSS JOIN t GROUP BY 1")
def crc_report(spark, d):
    """Capture and flag rate at the conformal threshold of each level."""
    from freightloom.operators.metrics import conformal_threshold

    s = scored(spark, d)
    ts = None
    for a in (0.05, 0.1, 0.2):
        t = conformal_threshold(s, "p", F.col("y") == 1, a).select(F.lit(a).alias("alpha"), "threshold")
        ts = t if ts is None else ts.unionByName(t)
    hit = (F.col("p") >= F.col("threshold")).cast("int")
    return rounded(s.crossJoin(F.broadcast(ts)).groupBy("alpha").agg(F.avg(F.when(F.col("y") == 1, hit)).alias("capture"), F.avg(hit).alias("flag_rate")))


@query(f"WITH {SCORED}, c AS (SELECT o_orderkey, sum(p * y) OVER (ORDER BY p DESC, o_orderkey) AS gain, row_number() OVER (ORDER BY p DESC, o_orderkey) AS rank FROM s) SELECT rank, round(gain, 4) AS gain FROM c")
def win_qini_exact(spark, d):
    """The true effect, summed in order of score."""
    return rounded(R.running(scored(spark, d), [F.desc("p"), F.col("o_orderkey")], {"gain": F.col("p") * F.col("y")}).select("rank", "gain"))


@query(f"""
WITH {SCORED} SELECT round(sum(CASE WHEN p > 0.5 THEN y * value * 0.02::DOUBLE - 40 ELSE 0 END), 2) AS realised, round(sum(CASE WHEN p > 0.5 THEN p * value * 0.02::DOUBLE - 40 ELSE 0 END), 2) AS expected, count(*) FILTER (WHERE p > 0.5) AS acted FROM s""")
def alloc_expected_net(spark, d):
    on, gain = F.col("p") > 0.5, F.col("value") * 0.02
    return rounded(scored(spark, d).agg(F.sum(F.when(on, F.col("y") * gain - 40).otherwise(0.0)).alias("realised"), F.sum(F.when(on, F.col("p") * gain - 40).otherwise(0.0)).alias("expected"), F.count_if(on).alias("acted")), 2)
