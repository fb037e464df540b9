"""Single functions over the tables' columns, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions import scalar as S
from freightloom.functions import text as T
from freightloom.operators import clean as C
from freightloom.operators import metrics as M
from freightloom.operators import ranked as R
from freightloom.plans.panels import TYPE_DAYS, USER_DAYS, type_days, user_days
from freightloom.plans.registry import query, rounded, table
from freightloom.plans.scores import _FORECAST, _ROUTED, SCORED, TIED, forecasts, routed, scored, tied


def part(spark, d) -> DataFrame:
    return table(spark, d, "part")


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders")


@query("SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS unit FROM part")
def fn_clean_unit(spark, d):
    return part(spark, d).select("p_partkey", T.alphanumeric(F.col("p_brand")).alias("unit"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'ECO' WHEN 'STANDARD' THEN 'STD' ELSE p_type END AS kind, upper(replace(p_brand, '#', '')) AS unit FROM part")
def fn_normalize_points(spark, d):
    kind = F.coalesce(S.looked_up(F.col("p_type"), {"ECONOMY": "ECO", "STANDARD": "STD"}), F.col("p_type"))
    return part(spark, d).select("p_partkey", kind.alias("kind"), T.alphanumeric(F.col("p_brand")).alias("unit"))


@query("SELECT c_custkey, list_aggregate(list_sort(string_split(CAST(c_custkey AS VARCHAR), '')), 'string_agg', '') AS digits FROM customer")
def fn_digit_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.sorted_chars(F.col("c_custkey").cast("string")).alias("digits"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, 'blue gear') AS INTEGER) AS gap FROM part")
def fn_levenshtein(spark, d):
    return part(spark, d).select("p_partkey", F.levenshtein("p_name", F.lit("blue gear")).alias("gap"))


@query("""
SELECT s_suppkey, CAST(levenshtein(s_name, 'Supplier#000000007') AS INTEGER) AS edits, s_nationkey = 7 AS same_zip, abs(s_nationkey - 7) AS zip_gap, substr(s_name, 1, 1) = 'S' AS same_first,
  length(s_name) = 18 AS same_length, CAST(right(s_name, 3) AS INTEGER) % 10 = 7 AS same_digit FROM supplier""")
def fn_pair_features(spark, d):
    """Features of each row against one record."""
    n, z = F.col("s_name"), F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.levenshtein(n, F.lit("Supplier#000000007")).alias("edits"), (z == 7).alias("same_zip"), F.abs(z - 7).alias("zip_gap"), F.startswith(n, F.lit("S")).alias("same_first"), (F.length(n) == 18).alias("same_length"), (F.substring(n, -3, 3).cast("int") % 10 == 7).alias("same_digit"))


@query("SELECT o_orderkey, round(sin(weekofyear(o_orderdate) * 2 * pi() / 52.18::DOUBLE), 4) AS s, round(cos(weekofyear(o_orderdate) * 2 * pi() / 52.18::DOUBLE), 4) AS c FROM orders")
def fn_cyclic_encode(spark, d):
    s, c = S.cyclic(F.weekofyear("o_orderdate"), 52.18)
    return rounded(orders(spark, d).select("o_orderkey", s.alias("s"), c.alias("c")))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def fn_normalize_date(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))


@query("SELECT o_orderkey, month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 301 AND 515 AS spring, CAST(o_orderdate AS DATE) IN (DATE '1997-07-04', DATE '1998-12-25') AS holiday FROM orders")
def fn_month_day_range(spark, d):
    o = F.col("o_orderdate")
    return orders(spark, d).select("o_orderkey", S.in_season(o, (3, 1), (5, 15)).alias("spring"), F.to_date(o).isin("1997-07-04", "1998-12-25").alias("holiday"))


@query("SELECT o_orderkey, year(o_orderdate) = 1997 AND month(o_orderdate) = 7 AND day(o_orderdate) < 8 AS in_week FROM orders")
def fn_isin_calendar(spark, d):
    days = [f"1997-07-{k:02d}" for k in range(1, 8)]
    return orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").isin(*days).alias("in_week"))


@query("SELECT p_partkey, round(ln(1 + p_retailprice), 4) AS logged, round(exp(ln(1 + p_size)) - 1, 4) AS back, round(1 / (1 + exp(-(p_size / 10.0::DOUBLE - 2))), 4) AS squashed FROM part")
def fn_log_exp(spark, d):
    return rounded(part(spark, d).select("p_partkey", F.log1p("p_retailprice").alias("logged"), F.expm1(F.log1p("p_size")).alias("back"), S.sigmoid(F.col("p_size") / 10 - 2).alias("squashed")))


@query(f"WITH {TYPE_DAYS}, f AS (SELECT *, lag(n, 7) OVER (PARTITION BY event_type ORDER BY day) AS last_week, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean FROM u) SELECT event_type, day, round(coalesce(mean, last_week), 4) AS anchor, round(exp(ln(1 + last_week)) - 1, 4) AS naive FROM f")
def fn_seasonal_naive(spark, d):
    w = Window.partitionBy("event_type").orderBy("day")
    week, mean = F.lag("n", 7).over(w), F.avg("n").over(w.rowsBetween(-3, -1))
    return rounded(type_days(spark, d).select("event_type", "day", F.coalesce(mean, week.cast("double")).alias("anchor"), F.expm1(F.log1p(week)).alias("naive")))


@query("SELECT p_partkey, round(1 - (1 - p_size / 50.0::DOUBLE) * 0.7::DOUBLE, 4) AS risk FROM part")
def fn_effect(spark, d):
    return rounded(part(spark, d).select("p_partkey", (1 - (1 - F.col("p_size") / 50) * (1 - 0.3)).alias("risk")))


@query("SELECT s_suppkey, round(900.0::DOUBLE / (900 + greatest(s_acctbal, 1)), 4) AS fractile FROM supplier")
def fn_critical_fractile(spark, d):
    return rounded(table(spark, d, "supplier").select("s_suppkey", S.critical_fractile(F.lit(900.0), F.greatest(F.col("s_acctbal"), F.lit(1.0))).alias("fractile")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ceil(l_quantity * 0.9::DOUBLE) AS BIGINT) AS low, CAST(ceil(l_quantity * 1.1::DOUBLE) AS BIGINT) AS high FROM lineitem")
def fn_bookings(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ceil(q * 0.9).alias("low"), F.ceil(q * 1.1).alias("high"))


@query("SELECT p_partkey, round(p_retailprice * CASE p_type WHEN 'ECONOMY' THEN 1.1::DOUBLE ELSE 1.25::DOUBLE END, 6) AS plus, round(p_retailprice * 1.18::DOUBLE, 6) AS flat FROM part")
def fn_cost_plus(spark, d):
    price = F.col("p_retailprice")
    return rounded(part(spark, d).select("p_partkey", (price * S.looked_up(F.col("p_type"), {"ECONOMY": 1.1}, 1.25)).alias("plus"), (price * 1.18).alias("flat")), 6)


@query("SELECT vec_id, round(sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)), 4) AS reach FROM embeddings")
def fn_hypot(spark, d):
    x, y = (F.col("embedding")[k].cast("double") for k in (0, 1))
    return rounded(table(spark, d, "embeddings").select("vec_id", S.hypot(x, y).alias("reach")))


@query("SELECT vec_id, round(CASE WHEN atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) < 0 THEN atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) + 2 * pi() ELSE atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) END, 4) AS turn FROM embeddings")
def fn_atan2_mod(spark, d):
    x, y = (F.col("embedding")[k].cast("double") for k in (0, 1))
    return rounded(table(spark, d, "embeddings").select("vec_id", S.angle(y, x).alias("turn")))


@query("SELECT p_partkey, least(greatest(CAST(floor(p_size / 8.0::DOUBLE) AS BIGINT), 1), 5) AS bin FROM part")
def fn_floor_div(spark, d):
    return part(spark, d).select("p_partkey", F.least(F.greatest(F.floor(F.col("p_size") / 8), F.lit(1)), F.lit(5)).cast("long").alias("bin"))


@query("SELECT p_partkey, round_even(p_size / 2.0::DOUBLE, 0) AS half FROM part")
def fn_round_digits(spark, d):
    return part(spark, d).select("p_partkey", S.even_rounded(F.col("p_size") / 2).alias("half"))


@query("SELECT s_suppkey, round(least(greatest(s_acctbal, -500), 500), 4) AS clipped, round(s_acctbal / greatest(abs(s_acctbal) - 1000, 0.001::DOUBLE), 4) AS ratio FROM supplier")
def fn_clip_symmetric(spark, d):
    b = F.col("s_acctbal")
    return rounded(table(spark, d, "supplier").select("s_suppkey", S.clipped(b, -500, 500).alias("clipped"), S.safe_ratio(b, F.abs(b) - 1000, 0.001).alias("ratio")))


@query("SELECT s_suppkey, s_acctbal <> 0 AND isfinite(s_acctbal) AS usable FROM supplier")
def fn_isfinite(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.is_usable(F.col("s_acctbal")).alias("usable"))


@query("SELECT p_partkey, round((1 + p_size / 100.0::DOUBLE) * coalesce(CASE WHEN p_size > 25 THEN 1.5::DOUBLE END, 1), 4) AS factor FROM part")
def fn_product_columns(spark, d):
    size = F.col("p_size")
    return rounded(part(spark, d).select("p_partkey", S.product([1 + size / 100, F.when(size > 25, 1.5)]).alias("factor")))


@query("WITH b AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice / p_size END AS unit FROM part) SELECT p_partkey, round(coalesce(unit, (SELECT quantile_cont(unit, 0.5) FROM b)), 4) AS unit FROM b")
def fn_fillna_derived(spark, d):
    df = part(spark, d).select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_retailprice") / F.col("p_size")).alias("unit"))
    return rounded(C.impute_medians(df, ["unit"]).select("p_partkey", "unit"))


@query("SELECT vec_id FROM embeddings WHERE NOT (embedding[1] = 0 AND embedding[2] = 0) AND abs(embedding[1]::DOUBLE) <= 0.2 AND abs(embedding[2]::DOUBLE) <= 0.2")
def bbox_filter(spark, d):
    x, y = (F.col("embedding")[k].cast("double") for k in (0, 1))
    return table(spark, d, "embeddings").where(~((x == 0) & (y == 0)) & (F.abs(x) <= 0.2) & (F.abs(y) <= 0.2)).select("vec_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 + floor(l_extendedprice / 800) AS BIGINT) AS legs, round(l_discount + l_tax, 4) AS rates, CAST(l_quantity * 900 > l_extendedprice AS INTEGER) AS dense FROM lineitem")
def engineer_transit(spark, d):
    p = F.col("l_extendedprice")
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1 + F.floor(p / 800)).alias("legs"), (F.col("l_discount") + F.col("l_tax")).alias("rates"), (F.col("l_quantity") * 900 > p).cast("int").alias("dense")))


@query("SELECT o_orderkey AS shipment_id, o_orderdate AS ship_date, CASE o_orderpriority WHEN '1-URGENT' THEN 'contract' ELSE 'standard' END AS tier, round(o_totalprice, 4) AS value FROM orders")
def build_expected_frame(spark, d):
    """A scored frame under another schema's names."""
    tier = S.looked_up(F.col("o_orderpriority"), {"1-URGENT": "contract"}, "standard")
    return rounded(orders(spark, d).select(F.col("o_orderkey").alias("shipment_id"), F.col("o_orderdate").alias("ship_date"), tier.alias("tier"), F.col("o_totalprice").alias("value")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, n.avg_q FROM lineitem JOIN (SELECT l_suppkey AS s, l_linenumber AS n, round(avg(l_quantity), 4) AS avg_q FROM lineitem GROUP BY 1, 2) n ON n.s = l_suppkey AND n.n = l_linenumber")
def join_multikey_lookup(spark, d):
    line = table(spark, d, "lineitem")
    means = line.groupBy("l_suppkey", "l_linenumber").agg(F.round(F.avg("l_quantity"), 4).alias("avg_q"))
    return line.join(means, ["l_suppkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "avg_q")


@query(f"WITH {_FORECAST} SELECT round(sum(abs(mean - actual)) / sum(actual)::DOUBLE, 4) AS wape FROM g")
def agg_wape(spark, d):
    return rounded(forecasts(spark, d).agg(M.wape(F.col("mean"), F.col("actual")).alias("wape")))


@query(f"WITH {_FORECAST} SELECT event_type, round(avg(2 * abs(mean - actual) / greatest(abs(actual) + abs(mean), 1e-9)), 4) AS smape FROM g GROUP BY 1")
def agg_smape(spark, d):
    return rounded(forecasts(spark, d).groupBy("event_type").agg(M.smape(F.col("mean"), F.col("actual")).alias("smape")))


@query(f"WITH {_FORECAST} SELECT event_type, round(sum(mean - actual) / sum(actual)::DOUBLE, 4) AS bias FROM g GROUP BY 1")
def agg_bias(spark, d):
    return rounded(forecasts(spark, d).groupBy("event_type").agg(M.bias(F.col("mean"), F.col("actual")).alias("bias")))


@query(f"WITH {_FORECAST} SELECT event_type, round(avg(greatest(0.1::DOUBLE * (actual - mean), -0.9::DOUBLE * (actual - mean))), 4) AS p10, round(avg(greatest(0.9::DOUBLE * (actual - mean), -0.1::DOUBLE * (actual - mean))), 4) AS p90 FROM g GROUP BY 1")
def agg_pinball(spark, d):
    m, a = F.col("mean"), F.col("actual")
    return rounded(forecasts(spark, d).groupBy("event_type").agg(M.pinball(m, a, 0.1).alias("p10"), M.pinball(m, a, 0.9).alias("p90")))


@query(f"WITH {_FORECAST} SELECT event_type, round(avg(CAST(actual BETWEEN mean * 0.7::DOUBLE AND mean * 1.3::DOUBLE AS INTEGER)), 4) AS coverage, round(avg(mean * 1.3::DOUBLE - mean * 0.7::DOUBLE), 4) AS width FROM g GROUP BY 1")
def agg_interval_metrics(spark, d):
    m = F.col("mean")
    return rounded(forecasts(spark, d).groupBy("event_type").agg(M.coverage(m * 0.7, m * 1.3, F.col("actual")).alias("coverage"), F.avg(m * 1.3 - m * 0.7).alias("width")))


@query(f"WITH {_ROUTED}, c AS (SELECT DISTINCT actual AS class FROM r UNION SELECT DISTINCT predicted FROM r), f AS (SELECT coalesce(2 * (SELECT count(*) FROM r WHERE actual = class AND predicted = class)::DOUBLE / nullif((SELECT count(*) FROM r WHERE actual = class) + (SELECT count(*) FROM r WHERE predicted = class), 0), 0) AS f1 FROM c) SELECT round((SELECT avg(CAST(actual = predicted AS INTEGER)) FROM r), 4) AS accuracy, round(avg(f1), 4) AS macro_f1 FROM f")
def agg_class_summary(spark, d):
    r = routed(spark, d)
    accuracy = r.agg(F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("accuracy"))
    return rounded(M.class_scores(r, "actual", "predicted").agg(F.avg("f1").alias("macro_f1")).crossJoin(F.broadcast(accuracy)).select("accuracy", "macro_f1"))


@query(f"WITH {SCORED}, c AS (SELECT greatest(p, 1 - p) AS conf, CAST((p >= 0.5) = (y = 1) AS INTEGER) AS ok FROM s), t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold), w AS (SELECT threshold, count(*) / (SELECT count(*) FROM c)::DOUBLE AS coverage, avg(ok) AS accuracy FROM t JOIN c ON conf >= threshold GROUP BY 1) SELECT threshold, round(coverage, 4) AS coverage, round(accuracy, 4) AS accuracy FROM w ORDER BY accuracy >= 0.72 DESC, CASE WHEN accuracy >= 0.72 THEN coverage END DESC NULLS LAST, threshold DESC LIMIT 1")
def agg_pick_operating(spark, d):
    """The largest coverage that reaches the target accuracy, else the last row."""
    df = scored(spark, d).withColumn("ok", ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int"))
    sweep = M.threshold_sweep(df, F.greatest(F.col("p"), 1 - F.col("p")), F.col("ok"), F.lit(0.0), [0.5, 0.6, 0.7, 0.8, 0.9])
    good = F.col("accuracy") >= 0.72
    best = sweep.orderBy(good.desc(), F.when(good, F.col("coverage")).desc_nulls_last(), F.desc("threshold")).limit(1)
    return rounded(best.select("threshold", "coverage", "accuracy"))


@query("SELECT tag, count(*) AS n, round(avg(CAST(p_size > 25 AS INTEGER)), 4) AS rate FROM (SELECT p_size, unnest(string_split(CASE WHEN p_size > 45 THEN 'none' ELSE replace(p_name, ' ', '|') END, '|')) AS tag FROM part) GROUP BY 1")
def agg_explode_taxonomy(spark, d):
    """Tags in one text, none where it is empty."""
    tags = F.when(F.col("p_size") > 45, "").otherwise(F.replace("p_name", F.lit(" "), F.lit("|")))
    tagged = part(spark, d).select("p_size", F.explode(F.split(F.when(tags == "", "none").otherwise(tags), r"\|")).alias("tag"))
    return rounded(tagged.groupBy("tag").agg(F.count("*").alias("n"), F.avg((F.col("p_size") > 25).cast("int")).alias("rate")))


@query("SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS price, quantile_cont(o_custkey, 0.5) AS customer, quantile_cont(month(o_orderdate), 0.5) AS month FROM orders")
def agg_median_row(spark, d):
    o = orders(spark, d).select(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.month("o_orderdate").alias("month"))
    return rounded(spark.createDataFrame([tuple(R.quantiles(o, c, [0.5])[0] for c in o.columns)], "price double, customer double, month double"))


@query(f"WITH {SCORED}, c AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, avg(p) AS predicted, avg(y) AS actual FROM s GROUP BY 1) SELECT month, round(predicted, 4) AS predicted, round(actual, 4) AS actual FROM c")
def agg_calibration_category(spark, d):
    return rounded(scored(spark, d).groupBy(F.month("o_orderdate").alias("month")).agg(F.avg("p").alias("predicted"), F.avg("y").alias("actual")))


@query(f"WITH {SCORED}, r AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY p DESC, o_orderkey) / (SELECT count(*) FROM s)::DOUBLE * 10) AS BIGINT) AS decile FROM s), g AS (SELECT decile, sum(value * y) AS v FROM r GROUP BY 1) SELECT decile, round(sum(v) OVER (ORDER BY decile) / (SELECT sum(v) FROM g), 4) AS capture FROM g")
def win_cum_capture(spark, d):
    g = R.deciles(scored(spark, d), [F.desc("p"), F.col("o_orderkey")]).groupBy("decile").agg(F.sum(F.col("value") * F.col("y")).alias("v"))
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # of ten rows
    return rounded(g.select("decile", (F.sum("v").over(w) / F.sum("v").over(Window.partitionBy())).alias("capture")))


@query(f"WITH {USER_DAYS} SELECT user_id, day, round(CASE WHEN count(*) OVER w >= 7 THEN avg(n) OVER w END, 4) AS mean_7 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def win_rolling_mean_full(spark, d):
    from freightloom.operators.windows import rolling_mean

    return rounded(user_days(spark, d).select("user_id", "day", rolling_mean(F.col("n"), ["user_id"], ["day"], 7).alias("mean_7")))


@query(f"WITH {SCORED}, {TIED} SELECT priority, max_by(o_orderkey, (score, -o_orderkey)) AS most, min_by(o_orderkey, (score, o_orderkey)) AS least FROM t GROUP BY 1")
def pick_lanes_extreme(spark, d):
    """The rows of the largest and the smallest score, ties to the smaller key."""
    key = F.col("o_orderkey")
    return tied(spark, d).groupBy("priority").agg(F.max_by("o_orderkey", F.struct(F.col("score"), -key)).alias("most"), F.min_by("o_orderkey", F.struct(F.col("score"), key)).alias("least"))


@query(f"WITH {SCORED}, m AS (SELECT unnest([1.0, 1.1, 1.2, 1.3]::DOUBLE[]) AS m), e AS (SELECT o_orderkey, value * m AS price, value * (m - 0.9::DOUBLE) / (1 + exp(8 * (m - 1.2::DOUBLE) - p)) AS ev FROM s CROSS JOIN m) SELECT o_orderkey, round(max_by(price, ev), 7) AS price FROM e GROUP BY 1")
def price_oracle(spark, d):
    """The best of a few prices by the true probability."""
    v, p = F.col("value"), F.col("p")
    options = F.array(*[F.struct((v * (m - 0.9) / (1 + F.exp(F.lit(8 * (m - 1.2)) - p))).alias("ev"), (v * m).alias("price")) for m in (1.0, 1.1, 1.2, 1.3)])
    return rounded(scored(spark, d).withColumn("b", F.array_max(options)).select("o_orderkey", F.col("b.price").alias("price")), 7)


@query(f"WITH {SCORED} SELECT o_orderkey, CASE WHEN p > 0.6 THEN 'upgrade' ELSE 'none' END AS action, CASE WHEN p > 0.6 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS cost, round(CASE WHEN p > 0.6 THEN p * value * 0.001::DOUBLE - 40 ELSE 0 END, 6) AS saving FROM s")
def alloc_frame(spark, d):
    """The decision frame: action, spend and expected saving of each row."""
    on = F.col("p") > 0.6
    return rounded(scored(spark, d).select("o_orderkey", F.when(on, "upgrade").otherwise("none").alias("action"), F.when(on, 40.0).otherwise(0.0).alias("cost"), F.when(on, F.col("p") * F.col("value") * 0.001 - 40).otherwise(0.0).alias("saving")), 6)


@query("SELECT n_nationkey AS zip, n_nationkey // 5 AS i, n_nationkey % 5 AS j FROM nation")
def gen_zip_coord(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("zip"), F.floor(k / 5).cast("int").alias("i"), (k % 5).alias("j"))


@query("""
SELECT o_orderkey, round(least(greatest((o_totalprice - 100000) / 100000, 0), 1) * least(greatest((month(o_orderdate) - 3) / 6.0::DOUBLE, 0), 1) * CAST(o_orderstatus <> 'P' AS INTEGER), 4) AS gate,
  round(CASE WHEN o_totalprice > 300000 THEN -0.05::DOUBLE ELSE 0.1::DOUBLE END * (month(o_orderdate) / 12.0::DOUBLE), 4) AS effect FROM orders""")
def gen_routing_gate(spark, d):
    """A product of ramps and an indicator, and an effect that changes its sign."""
    from freightloom.sources.generate import ramp

    m, v = F.month("o_orderdate"), F.col("o_totalprice")
    gate = ramp(v, 100000, 200000) * ramp(m, 3, 9) * (F.col("o_orderstatus") != "P").cast("int")
    return rounded(orders(spark, d).select("o_orderkey", gate.alias("gate"), (F.when(v > 300000, -0.05).otherwise(0.1) * (m / 12)).alias("effect")))
